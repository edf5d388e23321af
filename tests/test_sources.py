"""Sources and sinks: O2 keyed JSON, O3 log cleaning, O6 event extraction, O5 versioned publish."""

import json
import os
import tempfile

from gatewarden.sources.keyed_json import read_keyed_json
from gatewarden.sources.logs import clean_log_lines, extract_lifecycle_events
from gatewarden.sources.sinks import publish_pairing_state, read_published


def test_read_keyed_json(spark):
    files = spark.createDataFrame(
        [
            ("d", "telegram-pending.json", json.dumps({"ab12": {"user_id": "1", "user_name": "u", "created_at": 1.5}})),
            ("d", "a-pending-pending.json", json.dumps({"x": {"user_id": 2}})),
            ("d", "broken-pending.json", "{not json"),
            ("d", "slack-approved.json", json.dumps({"1": {"user_name": "z"}})),
        ],
        "deployment_id string, name string, text string",
    )
    entries, corrupt = read_keyed_json(files, "pending")
    got = sorted((r.platform, r.entry_key, r.user_id) for r in entries.collect())
    assert got == [("a-pending", "x", "2"), ("telegram", "ab12", "1")]
    assert [r.name for r in corrupt.collect()] == ["broken-pending.json"]


def test_clean_log_lines(spark):
    raw = [
        bytearray(b"ok \xff line  "),                      # invalid byte, trailing blanks
        bytearray(b"\x1b[32mgreen\x1b[0m   "),              # colour codes removed after the strip
        bytearray(b"text  \x1b[0m"),                        # blanks before a trailing colour code stay
        bytearray(b"\x1b[2Kkept\t\n"),                      # non-colour escape kept
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, bytes binary")
    got = [r.line for r in clean_log_lines(df).orderBy("i").collect()]
    import re

    ansi = re.compile(r"\x1b\[[0-9;]*m")
    assert got == [ansi.sub("", b.decode(errors="replace").rstrip()) for b in raw]


def test_extract_lifecycle_events(spark):
    lines = [
        "[gateway] exited (code 75) — supervising restart",
        "[gateway] crash-looping (6 exits in 120s) — giving up auto-restart. Fix the provider/model in the admin UI, then Start/Restart the gateway.",
        "[gateway] restarting in 8s (attempt 3)",
        "[gateway] restart cancelled (stopped/reconfigured)",
        "[gateway] restart skipped — provider/model not configured",
        "[gateway] cleared stale pid file (pid 4242)",
        "[error] Failed to start: boom",
        "[proxy] GET /api/x -> 502 body='oops'",
        "[dashboard] EXITED with code 1 — reverse proxy will return 503 until restart",
        "[xai-oauth] failed: access_denied",
        "ordinary output",
    ]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, line string")
    got = {r.i: r for r in extract_lifecycle_events(df).collect()}
    assert (got[0].event, got[0].exit_code) == ("exit", 75)
    assert (got[1].event, got[1].attempt) == ("crashed", 6)
    assert (got[2].event, got[2].delay_s, got[2].attempt) == ("respawn_scheduled", 8, 3)
    assert got[3].event == "respawn_cancelled" and got[4].event == "unready"
    assert (got[5].event, got[5].pid) == ("lock_cleared", 4242)
    assert got[6].event == "start_failed"
    assert (got[7].event, got[7].method, got[7].path, got[7].status) == ("upstream_status", "GET", "/api/x", 502)
    assert (got[8].event, got[8].exit_code) == ("dashboard_exit", 1)
    assert (got[9].event, got[9].detail) == ("oauth_failed", "access_denied")
    assert 10 not in got


def test_publish_covers_only_the_published_deployments(spark):
    root = tempfile.mkdtemp(prefix="gw-sink-")
    rows = lambda *r: spark.createDataFrame(list(r), "deployment_id string, platform string, code string")
    deps = lambda *d: spark.createDataFrame([(x,) for x in d], "deployment_id string")
    read = lambda t: sorted((r.deployment_id, r.platform, r.code) for r in read_published(spark, root, t).collect())
    assert read_published(spark, root, "pending") is None
    publish_pairing_state(rows(("A", "tg", "1"), ("A", "dc", "2"), ("B", "tg", "3")), rows(("B", "tg", "9")), deps("A", "B"), root)
    # A alone: B keeps its row, A's last dc row goes, a row of a deployment not published is ignored.
    publish_pairing_state(rows(("A", "tg", "4"), ("C", "tg", "5")), rows(), deps("A"), root)
    assert read("pending") == [("A", "tg", "4"), ("B", "tg", "3")] and read("approved") == [("B", "tg", "9")]
    # Nothing left for A at all.
    assert publish_pairing_state(rows(), rows(), deps("A"), root) == 3
    assert read("pending") == [("B", "tg", "3")]


def test_unfinished_publish_is_not_seen(spark):
    root = tempfile.mkdtemp(prefix="gw-sink-")
    rows = spark.createDataFrame([("A", "tg", "1")], "deployment_id string, platform string, code string")
    publish_pairing_state(rows, rows, rows, root)
    rows.withColumn("bucket", rows.code.cast("int")).write.partitionBy("platform", "bucket").parquet(f"{root}/pending/version=2")  # no commit
    assert read_published(spark, root, "pending").count() == 1
    assert publish_pairing_state(rows.limit(0), rows, rows, root) == 2
    assert read_published(spark, root, "pending") is None and read_published(spark, root, "approved").count() == 1


def test_publish_writes_only_its_own_buckets(spark):
    import os

    root = tempfile.mkdtemp(prefix="gw-sink-")
    kind = "deployment_id string, platform string, code string"
    many = spark.createDataFrame([(f"d{i}", "tg", str(i)) for i in range(300)], kind)
    publish_pairing_state(many, many, many, root)
    before = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs}
    one = spark.createDataFrame([("d7", "dc", "x")], kind)
    assert publish_pairing_state(one, one.limit(0), one, root) == 2
    after = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs}
    assert {f: after[f] for f in before} == before
    new = {d.split("bucket=")[1] for f in after.keys() - before.keys() for d in [os.path.dirname(f)] if "bucket=" in d and f.endswith(".parquet")}
    assert len(new) == 1
    got = {(r.deployment_id, r.platform, r.code) for r in read_published(spark, root, "pending").collect()}
    assert got == {(f"d{i}", "tg", str(i)) for i in range(300) if i != 7} | {("d7", "dc", "x")}
    assert {r.deployment_id for r in read_published(spark, root, "approved").collect()} == {f"d{i}" for i in range(300) if i != 7}


def test_concurrent_publishers_lose_nothing(spark):
    import threading

    root = tempfile.mkdtemp(prefix="gw-sink-")
    kind = "deployment_id string, platform string, code string"

    def publish(who: str) -> None:
        # Its own deployment, and one that all publish (two rows each, never mixed).
        rows = spark.createDataFrame([(who, "tg", who), ("shared", "tg", f"{who}-1"), ("shared", "tg", f"{who}-2")], kind)
        publish_pairing_state(rows, rows.limit(0), rows, root)

    threads = [threading.Thread(target=publish, args=(f"w{k}",)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = read_published(spark, root, "pending").collect()
    assert {r.code for r in got if r.deployment_id != "shared"} == {f"w{k}" for k in range(5)}
    shared = sorted(r.code for r in got if r.deployment_id == "shared")
    assert len(shared) == 2 and len({c.split("-")[0] for c in shared}) == 1


def test_compacted_state_and_uncommitted_folder(spark):
    from gatewarden.sources.sinks import committed_version, compact_published

    root, into = tempfile.mkdtemp(prefix="gw-sink-"), tempfile.mkdtemp(prefix="gw-sink-") + "/new"
    kind = "deployment_id string, platform string, code string"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    publish_pairing_state(rows(("A", "tg", "1"), ("B", "tg", "2")), rows(("B", "dc", "3")), rows(("A", "", ""), ("B", "", "")), root)
    publish_pairing_state(rows(), rows(("A", "dc", "4")), rows(("A", "", "")), root)
    # Rows and cover of a publish that never committed.
    rows(("B", "tg", "9")).selectExpr("*", "9 AS bucket").write.partitionBy("bucket").parquet(f"{root}/rows/pending/publish=p-dead")
    spark.createDataFrame([("B", 9)], "deployment_id string, bucket int").write.partitionBy("bucket").parquet(f"{root}/covered/publish=p-dead")
    want = {"pending": [("B", "tg", "2")], "approved": [("A", "dc", "4"), ("B", "dc", "3")]}
    compact_published(spark, root, into)
    for where in (root, into):
        for name, expect in want.items():
            assert sorted(map(tuple, read_published(spark, where, name).select("deployment_id", "platform", "code").collect())) == expect
    assert committed_version(spark, into) == committed_version(spark, root) == 2
    assert publish_pairing_state(rows(), rows(), rows(("B", "", "")), into) == 3
    assert read_published(spark, into, "pending") is None


def test_mixed_entries_spoil_no_others(spark):
    files = spark.createDataFrame(
        [("d", "tg-pending.json", json.dumps({"a": "oops", "b": {"user_id": "1"}, "c": None, "e": {"created_at": "x", "user_id": 2}}))],
        "deployment_id string, name string, text string",
    )
    entries, corrupt = read_keyed_json(files, "pending")
    assert sorted((r.entry_key, r.user_id, r.created_at) for r in entries.collect()) == [("a", None, None), ("b", "1", None), ("c", None, None), ("e", "2", None)]
    assert sorted(r.entry_key for r in corrupt.collect()) == ["a", "c"]


def test_emptied_file_is_replaced(spark):
    from gatewarden.sources.sinks import write_dotenv_files

    root = tempfile.mkdtemp(prefix="gw-env-")
    kind = "deployment_id string, key string, value string"
    write_dotenv_files(spark.createDataFrame([("d1", "ADMIN_PASSWORD", "secret"), ("d2", "X", "1")], kind), root)
    write_dotenv_files(spark.createDataFrame([("d1", "ADMIN_PASSWORD", "")], kind), root)
    got = {r.deployment_id: r.value for r in spark.read.text(root, wholetext=True).select("deployment_id", "value").collect()}
    assert got == {"d1": "\n", "d2": "# Other\nX=1\n"}


def test_render_write_parse_round_trip(spark):
    from pyspark.sql import functions as F

    from gatewarden.operators.settings import effective_settings, render_dotenv
    from gatewarden.sources.dotenv import parse_dotenv
    from gatewarden.sources.sinks import write_dotenv_files

    s = spark.createDataFrame(
        [("d1", "LLM_MODEL", "m"), ("d1", "X", "1=2"), ("d1", "E", ""), ("d2", "SLACK_BOT_TOKEN", "xoxb-1")],
        "deployment_id string, key string, value string",
    )
    root = tempfile.mkdtemp(prefix="gw-env-")
    write_dotenv_files(s, root)
    raw = spark.read.text(root, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"deployment_id=([^/]+)", 1).alias("deployment_id"),
        F.lit(".env").alias("path"),
        F.col("value").alias("text"),
    )
    back = effective_settings(parse_dotenv(raw)).select("deployment_id", "key", "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.filter("value <> ''").collect()))
    # the file bytes equal the rendered text
    texts = {r.deployment_id: r.text for r in raw.collect()}
    assert texts == {r.deployment_id: r.text for r in render_dotenv(s).collect()}


def test_read_dotenv_files_whole(spark):
    from gatewarden.sources.dotenv import read_dotenv_files

    root = tempfile.mkdtemp(prefix="gw-envfiles-")
    for dep, text in {"a": "A=1\n# c\nB = ' x '\n", "b": "export C=3\r\nC=4"}.items():
        os.makedirs(os.path.join(root, dep))
        with open(os.path.join(root, dep, "settings.env"), "w", newline="") as f:
            f.write(text)
    df = read_dotenv_files(spark, os.path.join(root, "*", "settings.env"), deployment_from_path=r"/([^/]+)/settings\.env$")
    got = sorted((r.deployment_id, r.line_no, r.key, r.value) for r in df.collect())
    assert got == [("a", 1, "A", "1"), ("a", 3, "B", " x "), ("b", 1, "export C", "3"), ("b", 2, "C", "4")]


def test_read_pairing_dir(spark):
    from gatewarden.sources.keyed_json import read_pairing_dir

    root = tempfile.mkdtemp(prefix="gw-pair-")
    os.makedirs(os.path.join(root, "dep1"))
    with open(os.path.join(root, "dep1", "telegram-pending.json"), "w") as f:
        f.write(json.dumps({"ab": {"user_id": "7", "user_name": "n", "created_at": 1.0}}, indent=2))
    with open(os.path.join(root, "dep1", "bad-pending.json"), "w") as f:
        f.write("{oops")
    entries, corrupt = read_pairing_dir(spark, os.path.join(root, "*"), "pending", deployment_from_path=r"/([^/]+)/[^/]+$")
    assert [(r.deployment_id, r.platform, r.entry_key, r.user_id) for r in entries.collect()] == [("dep1", "telegram", "ab", "7")]
    assert [r.name for r in corrupt.collect()] == ["bad-pending.json"]


def test_dotenv_tree_round_trip(spark):
    from gatewarden.operators.settings import render_dotenv
    from gatewarden.sources.dotenv_tree import read_dotenv_tree, write_dotenv_tree

    root = os.path.join(tempfile.mkdtemp(prefix="gw-tree-"), "new")
    kind = "deployment_id string, key string, value string"
    first = [("d1", "LLM_MODEL", "m"), ("d1", "X", "1=2 é"), ("d1", "E", ""), ("d2", "SLACK_BOT_TOKEN", "xoxb-1"), *[(f"e{i}", "K", str(i)) for i in range(30)]]
    s = spark.createDataFrame(first, kind)
    write_dotenv_tree(s, root)
    back = read_dotenv_tree(spark, root).select("deployment_id", "key", "value")
    assert sorted(map(tuple, back.collect())) == sorted(r for r in first if r[2])
    texts = {r.deployment_id: r.text for r in render_dotenv(s).collect()}
    read = lambda d: open(os.path.join(root, d, ".env"), encoding="utf-8").read()
    assert {d: read(d) for d in os.listdir(root)} == texts
    # An emptied deployment's file has no byte; others stay; no other file is left over.
    write_dotenv_tree(spark.createDataFrame([("d1", "X", ""), ("d3", "X", "1")], kind), root)
    assert read("d1") == "" and read("d2") == texts["d2"] and read("d3") == "# Other\nX=1\n"
    assert all(os.listdir(os.path.join(root, d)) == [".env"] for d in os.listdir(root))
    assert "d1" not in {r.deployment_id for r in read_dotenv_tree(spark, root).collect()}


def test_dotenv_tree_fails_loudly(spark):
    import pytest

    from gatewarden.sources.dotenv_tree import read_dotenv_tree, write_dotenv_tree

    root = tempfile.mkdtemp(prefix="gw-tree-")
    with pytest.raises(Exception, match="missing"):
        read_dotenv_tree(spark, os.path.join(root, "missing")).count()
    with pytest.raises(Exception, match="no folder name"):
        write_dotenv_tree(spark.createDataFrame([("../x", "K", "1")], "deployment_id string, key string, value string"), root)
    assert os.listdir(root) == []
    assert read_dotenv_tree(spark, root).count() == 0
