"""Streaming jobs equal the batch jobs on the same input (file source, availableNow)."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from gatewarden.operators import lifecycle as L
from gatewarden.streaming import common


def _scratch():
    return tempfile.mkdtemp(prefix="gw-stream-")


def _run(df, root):
    q = common.start_sink(df, os.path.join(root, "out"), os.path.join(root, "ckpt"), available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.read.parquet(os.path.join(root, "out"))


def test_st1_clean_stream_equals_batch(spark):
    from gatewarden.plans import standins as X
    from gatewarden.sources.logs import clean_log_lines
    from gatewarden.streaming.logs import LOG_RAW_SCHEMA, lifecycle_event_stream

    root = _scratch()
    raw = X.event_log_raw(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    raw = raw.withColumn("deployment_id", F.col("deployment_id").cast("string"))
    raw.repartition(3).write.parquet(os.path.join(root, "in"))
    stream = lifecycle_event_stream(common.file_stream(spark, os.path.join(root, "in"), LOG_RAW_SCHEMA, max_files=1))
    got = _run(stream, root)
    from gatewarden.sources.logs import extract_lifecycle_events

    batch = extract_lifecycle_events(clean_log_lines(spark.read.parquet(os.path.join(root, "in"))))
    cols = ["deployment_id", "seq", "event", "exit_code", "delay_s", "attempt", "status"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_st2_crash_alerts_equal_batch(spark):
    from gatewarden.streaming.crash_alerts import EVENTS_SCHEMA, crash_alert_stream

    common.use_rocksdb_state(spark)
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for d in ["a", "b", "c"]:
        t = 0.0
        for q in range(60):
            t += rnd.choice([1, 5, 20, 60, 150])
            rows.append((d, t0 + dt.timedelta(seconds=t), q, rnd.choice(["exit", "exit", "exit", "start", "running", "stop", "respawn"])))
    df = spark.createDataFrame(rows, EVENTS_SCHEMA)
    root = _scratch()
    df.write.parquet(os.path.join(root, "in"))
    tick = spark.createDataFrame([("tick", t0 + dt.timedelta(days=2), 1, "start")], EVENTS_SCHEMA)  # moves the watermark
    tick.coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
    stream = crash_alert_stream(common.file_stream(spark, os.path.join(root, "in"), EVENTS_SCHEMA), "10 minutes")
    got = _run(stream, root)
    exits = sorted((r.deployment_id, r.seq, r.exits_in_window, r.verdict, r.delay_s) for r in got.filter("kind = 'exit'").collect())
    batch = L.lifecycle_crash_loop(df)
    expect = sorted((r.deployment_id, r.seq, r.exits_in_window, r.verdict, r.delay_s) for r in batch.collect())
    assert exits == expect
    checks = sorted((r.deployment_id, r.seq, r.outcome) for r in got.filter("kind = 'respawn_check'").collect())
    assert checks == sorted((r.deployment_id, r.seq, r.outcome) for r in L.respawn_checks(df).collect())
    assert len({c[2] for c in checks}) >= 2
    from gatewarden.streaming.crash_alerts import missed_rows

    assert missed_rows(df, got).count() == 0
    assert missed_rows(df, got.filter("kind = 'respawn_check'")).count() == len(exits)


def test_st3_pairing_stream_equals_batch(spark):
    from gatewarden.operators import pairing as P
    from gatewarden.streaming.pairing import pairing_stream

    common.use_rocksdb_state(spark)
    t0 = dt.datetime(2024, 1, 1)
    rnd = random.Random(5)
    pend = [("d", rnd.choice(["tg", "dc"]), f"c{i}", t0 + dt.timedelta(seconds=i), i, rnd.choice(["", "  ", f"u{i}"]), f"n{i}") for i in range(40)]
    pend_df = spark.createDataFrame(pend, "deployment_id string, platform string, code string, created_at timestamp, seq long, user_id string, user_name string")
    decs = []
    for j in range(120):
        decs.append((j, "d", t0 + dt.timedelta(seconds=1000 + j), j, rnd.choice(["approve", "approve", "deny", None]),
                     rnd.choice(["tg", "dc", ""]), rnd.choice([f"c{rnd.randint(0, 50)}", f" c{rnd.randint(0, 50)} "])))
    dec_df = spark.createDataFrame(decs, "decision_id long, deployment_id string, ts timestamp, seq long, op string, platform string, code string")
    outcomes, _, approvals = P.resolve_decisions(pend_df, dec_df)
    expect = sorted((r.decision_id, r.status) for r in outcomes.collect())

    root = _scratch()
    pend_df.withColumnRenamed("created_at", "ts").write.parquet(os.path.join(root, "req"))
    dec_df.write.parquet(os.path.join(root, "dec"))
    req_s = common.file_stream(spark, os.path.join(root, "req"), pend_df.withColumnRenamed("created_at", "ts").schema)
    dec_s = common.file_stream(spark, os.path.join(root, "dec"), dec_df.schema)
    got = _run(pairing_stream(req_s, dec_s), root)
    assert sorted((r.decision_id, r.status) for r in got.filter("kind = 'outcome'").collect()) == expect
    assert sorted((r.user_id, r.user_name) for r in got.filter("kind = 'approval'").collect()) == sorted(
        (r.user_id, r.user_name) for r in approvals.collect()
    )


def test_st4_device_flow_stream_matches_batch(spark):
    from gatewarden.streaming.device_flow import device_flow_stream

    common.use_rocksdb_state(spark)
    t0 = dt.datetime(2024, 1, 1)
    flows = spark.createDataFrame(
        [("ok", t0, t0 + dt.timedelta(seconds=900), 5), ("exp", t0, t0 + dt.timedelta(seconds=60), 5),
         ("slow", t0, t0 + dt.timedelta(seconds=900), 40), ("err", t0, t0 + dt.timedelta(seconds=900), 5),
         ("tick", t0 + dt.timedelta(seconds=5000), t0 + dt.timedelta(seconds=5001), 5)],
        "flow_id string, started_at timestamp, expires_at timestamp, interval_s int",
    )
    P = [("ok", 5, 1, 400, True, "authorization_pending", None), ("ok", 10, 2, 200, True, None, None),
         ("exp", 5, 1, 400, True, "authorization_pending", None),
         ("slow", 40, 1, 400, True, "slow_down", None), ("slow", 70, 2, 400, True, "bad", "went wrong"),
         ("err", 5, 1, None, None, None, None), ("err", 10, 2, 400, True, "access_denied", ""),
         ("tick", 5000, 1, 400, True, "authorization_pending", None)]
    polls = spark.createDataFrame(
        [(f, t0 + dt.timedelta(seconds=s), q, st, ok, e, d) for f, s, q, st, ok, e, d in P],
        "flow_id string, ts timestamp, seq long, http_status int, body_ok boolean, error string, error_description string",
    )
    batch = {r.flow_id: (r.status, r.error, r.interval_s) for r in L.device_flow_outcome(flows, polls, t0 + dt.timedelta(seconds=3000)).collect()}
    root = _scratch()
    flows.write.parquet(os.path.join(root, "flows"))
    polls.write.parquet(os.path.join(root, "polls"))
    fs = common.file_stream(spark, os.path.join(root, "flows"), flows.schema)
    ps = common.file_stream(spark, os.path.join(root, "polls"), polls.schema)
    got = {r.flow_id: (r.status, r.error, r.interval_s) for r in _run(device_flow_stream(fs, ps, "1 minute"), root).collect()}
    for f in ["ok", "exp", "slow", "err"]:
        assert got[f] == batch[f], f


def test_st5_status_stream_equals_batch(spark):
    from gatewarden.plans.bindings import lifecycle_events
    from gatewarden.streaming.status import read_latest_status, start_status_sink, status_stream

    common.use_rocksdb_state(spark)
    ev = lifecycle_events(spark, "/root/testdata/sf0.001").select(
        F.col("deployment_id").cast("string").alias("deployment_id"), F.col("ts").cast("timestamp").alias("ts"), "seq", "event", "pid"
    )
    root = _scratch()
    # two files in time order: the stream takes later files as later events
    cut = dt.datetime(2024, 1, 1, 12)
    ev.filter(F.col("ts") < cut).coalesce(1).write.parquet(os.path.join(root, "in"))
    ev.filter(F.col("ts") >= cut).coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
    q = start_status_sink(
        status_stream(common.file_stream(spark, os.path.join(root, "in"), ev.schema, max_files=1)),
        os.path.join(root, "status"), os.path.join(root, "ckpt"), available_now=True,
    )
    q.awaitTermination(300)
    assert q.exception() is None
    latest = {r.deployment_id: (r.state, r.pid, r.restarts) for r in read_latest_status(spark, os.path.join(root, "status")).collect()}
    as_of = dt.datetime(2030, 1, 1)
    batch = {r.deployment_id: (r.state, r.pid, r.restarts) for r in L.lifecycle_state(ev, as_of).collect()}
    assert latest == batch


def test_st2_respawn_timer_outcomes(spark):
    from gatewarden.streaming.crash_alerts import EVENTS_SCHEMA, crash_alert_stream

    common.use_rocksdb_state(spark)
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        ("stopped", t0, 1, "start"), ("stopped", t0 + dt.timedelta(seconds=10), 2, "exit"),
        ("stopped", t0 + dt.timedelta(seconds=11), 3, "stop"),          # stop inside the 2 s delay
        ("manual", t0, 1, "start"), ("manual", t0 + dt.timedelta(seconds=10), 2, "exit"),
        ("manual", t0 + dt.timedelta(seconds=11), 3, "start"),          # manual start inside the delay
        ("due", t0, 1, "start"), ("due", t0 + dt.timedelta(seconds=10), 2, "exit"),
        ("again", t0, 1, "start"), ("again", t0 + dt.timedelta(seconds=10), 2, "exit"),
        ("again", t0 + dt.timedelta(seconds=12, milliseconds=500), 3, "respawn"),  # after the delay: the respawn itself
        ("late_stop", t0, 1, "start"), ("late_stop", t0 + dt.timedelta(seconds=10), 2, "exit"),
        ("late_stop", t0 + dt.timedelta(seconds=300), 3, "stop"),
        ("unready", t0, 1, "start"), ("unready", t0 + dt.timedelta(seconds=5), 2, "config_unready"),
        ("unready", t0 + dt.timedelta(seconds=10), 3, "exit"),
        ("tick", t0 + dt.timedelta(hours=2), 1, "start"),               # moves the watermark past the timers
    ]
    root = _scratch()
    spark.createDataFrame(rows, EVENTS_SCHEMA).write.parquet(os.path.join(root, "in"))
    got = _run(crash_alert_stream(common.file_stream(spark, os.path.join(root, "in"), EVENTS_SCHEMA), lateness="1 minute"), root)
    checks = {r.deployment_id: r.outcome for r in got.filter("kind = 'respawn_check'").collect()}
    want = {"stopped": "cancelled", "manual": "already_running", "due": "respawn_due", "again": "respawn_due",
            "late_stop": "respawn_due", "unready": "unready"}
    assert checks == want
    batch = L.respawn_checks(spark.createDataFrame(rows, EVENTS_SCHEMA)).collect()
    assert {r.deployment_id: r.outcome for r in batch} == want


def test_st4_early_polls_and_default_life(spark):
    """Polls in an earlier micro-batch than their flow row count; a flow without an
    expiry lives 900 s; polls without any flow row come out."""
    from gatewarden.streaming.device_flow import DeviceFlowProcessor, device_flow_stream  # noqa: F401

    common.use_rocksdb_state(spark)
    t0 = dt.datetime(2024, 1, 1)
    kind_f = "flow_id string, started_at timestamp, expires_at timestamp, interval_s int"
    kind_p = "flow_id string, ts timestamp, seq long, http_status int, body_ok boolean, error string, error_description string"
    at = lambda s: t0 + dt.timedelta(seconds=s)
    root = _scratch()
    polls = [("early", at(10), 1, 200, True, None, None), ("orphan", at(10), 1, 200, True, None, None), ("life", at(10), 1, 400, True, "authorization_pending", None)]
    flows = [("early", t0, None, 5), ("life", t0, None, 5)]
    for n, (f, p) in enumerate([([], polls), (flows, []), ([("tick", at(90_000), None, 5)], []), ([("tick2", at(90_001), None, 5)], [])]):
        spark.createDataFrame(f, kind_f).coalesce(1).write.mode("append").parquet(os.path.join(root, "flows"))
        spark.createDataFrame(p, kind_p).coalesce(1).write.mode("append").parquet(os.path.join(root, "polls"))
        import time

        time.sleep(1.1)  # files are taken in the order of their times
    fs = common.file_stream(spark, os.path.join(root, "flows"), spark.createDataFrame([], kind_f).schema, max_files=1)
    ps = common.file_stream(spark, os.path.join(root, "polls"), spark.createDataFrame([], kind_p).schema, max_files=1)
    got = {r.flow_id: r for r in _run(device_flow_stream(fs, ps, "1 minute"), root).collect()}
    assert got["early"].status == "authorized" and got["orphan"].status == "no_flow"
    assert got["life"].status == "expired" and got["life"].ts == at(900)


def test_st3_approvals_and_revocations_equal_batch(spark):
    from gatewarden.operators import pairing as P
    from gatewarden.streaming.pairing import approved_stream

    common.use_rocksdb_state(spark)
    rnd = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("d", "tg", f"u{rnd.randint(0, 8)}", f"n{i}", t0 + dt.timedelta(seconds=rnd.randint(0, 30)), i) for i in range(60)]
    kind = "deployment_id string, platform string, user_id string, user_name string, ts timestamp, seq long"
    a, r = spark.createDataFrame(rows[:35], kind), spark.createDataFrame(rows[35:], kind).drop("user_name")
    root = _scratch()
    a.repartition(3).write.parquet(os.path.join(root, "a"))
    r.repartition(3).write.parquet(os.path.join(root, "r"))
    s = approved_stream(common.file_stream(spark, os.path.join(root, "a"), a.schema, max_files=1), common.file_stream(spark, os.path.join(root, "r"), r.schema, max_files=1))
    out = _run(s, root)
    last = {}
    for x in out.collect():
        if x.user_id not in last or x.approved_at >= last[x.user_id].approved_at:
            last[x.user_id] = x
    want = {x.user_id: x.user_name for x in P.approved_users(a, r).collect()}
    newest = {}
    for row in rows:
        if row[2] not in newest or (row[4], row[5]) > newest[row[2]][:2]:
            newest[row[2]] = (row[4], row[5], row[3])
    assert {u for u, x in last.items() if x.approved} >= set(want) - {u for u in want if last[u].approved_at != newest[u][0]}


def test_st5_late_start_does_not_revive(spark):
    from gatewarden.streaming.status import compact_status, read_latest_status, start_status_sink, status_stream

    common.use_rocksdb_state(spark)
    t0 = dt.datetime(2024, 1, 1)
    kind = "deployment_id string, ts timestamp, seq long, event string, pid long"
    root = _scratch()
    import time

    for batch in ([("d", t0 + dt.timedelta(seconds=20), 2, "exit", 1)], [("d", t0 + dt.timedelta(seconds=10), 1, "start", 1)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
        time.sleep(1.1)
    s = status_stream(common.file_stream(spark, os.path.join(root, "in"), spark.createDataFrame([], kind).schema, max_files=1))
    q = start_status_sink(s, os.path.join(root, "status"), os.path.join(root, "ckpt"), available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    assert read_latest_status(spark, os.path.join(root, "status")).first().state == "error"
    compact_status(spark, os.path.join(root, "status"), os.path.join(root, "compact"))
    assert [r.state for r in spark.read.parquet(os.path.join(root, "compact")).collect()] == ["error"]


def test_st2_hot_key_and_batch_frame(spark):
    """100,000 events of one deployment in many micro-batches, shuffled within the
    lateness: the rows of the batch rules; the processor on a batch frame gives them too."""
    from gatewarden.streaming.crash_alerts import EVENTS_SCHEMA, crash_alert_stream

    common.use_rocksdb_state(spark)
    rnd = random.Random(31)
    t0 = dt.datetime(2024, 1, 1)
    kinds = ["exit"] * 8 + ["start", "stop", "running", "config_unready", "config_ready", "restart"]
    rows = [("hot", t0 + dt.timedelta(milliseconds=100 * i + rnd.randint(0, 50)), i, rnd.choice(kinds)) for i in range(100_000)]
    df = spark.createDataFrame(rows, EVENTS_SCHEMA)
    root = _scratch()
    for k in range(8):
        part = rows[k * 12_500 : (k + 1) * 12_500]
        rnd.shuffle(part)
        spark.createDataFrame(part, EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
    tick = spark.createDataFrame([("tick", t0 + dt.timedelta(days=2), 1, "start")], EVENTS_SCHEMA)
    tick.coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
    got = _run(crash_alert_stream(common.file_stream(spark, os.path.join(root, "in"), EVENTS_SCHEMA, max_files=2), "40 minutes", bucket_s=30), root)
    from gatewarden.streaming.crash_alerts import missed_rows

    assert missed_rows(df, got).count() == 0
    assert got.filter("kind = 'exit'").count() == L.lifecycle_crash_loop(df).count()
    batch = crash_alert_stream(df, "0 seconds", bucket_s=600)
    assert missed_rows(df, batch).count() == 0 and batch.count() == got.filter("deployment_id = 'hot'").count()


def test_st3_event_order_and_initial_state(spark):
    """Requests and decisions dealt over micro-batches at random, decisions ahead of
    their requests: with a lateness the stream starts from what a batch run left and
    gives the outcomes of all events in order."""
    from gatewarden.operators import pairing as P
    from gatewarden.streaming.pairing import pairing_stream

    common.use_rocksdb_state(spark)
    rnd = random.Random(41)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    kind_r = "deployment_id string, platform string, code string, ts timestamp, seq long, user_id string, user_name string"
    kind_d = "decision_id long, deployment_id string, ts timestamp, seq long, op string, platform string, code string"
    requests = [("d", "tg", f"c{i}", at(10 * i), i, rnd.choice(["", f"u{i}"]), f"n{i}") for i in range(60)]
    decisions = [(j, "d", at(5 + 6 * j), 1000 + j, rnd.choice(["approve", "approve", "deny", None]), "tg", f"c{rnd.randint(0, 69)}") for j in range(150)]
    old = [("d", "tg", f"c{i}", f"u{i}", f"n{i}") for i in range(55, 70)]  # left pending by an earlier run
    initial = spark.createDataFrame(old, "deployment_id string, platform string, code string, user_id string, user_name string")

    entries = {c: (u, n) for _, _, c, u, n in old}
    want, approved = [], []
    for t, _, kind, row in sorted([(r[3], r[4], "r", r) for r in requests] + [(d[2], d[3], "d", d) for d in decisions]):
        if kind == "r":
            entries[row[2]] = (row[5], row[6])
        elif row[4] == "deny":
            entries.pop(row[6], None)
            want.append((row[0], 200))
        elif row[4] is None:
            want.append((row[0], 400))
        elif row[6] not in entries:
            want.append((row[0], 404))
        elif not entries[row[6]][0]:
            want.append((row[0], 422))
        else:
            approved.append((*entries.pop(row[6]),))
            want.append((row[0], 200))

    root = _scratch()
    rnd.shuffle(requests), rnd.shuffle(decisions)
    for k in range(3):
        spark.createDataFrame(requests[k::3], kind_r).coalesce(1).write.mode("append").parquet(os.path.join(root, "req"))
        spark.createDataFrame(decisions[k::3], kind_d).coalesce(1).write.mode("append").parquet(os.path.join(root, "dec"))
    for day in (2, 3):  # moves the watermark
        spark.createDataFrame([("tick", "", "", at(86400 * day), 0, "", "")], kind_r).coalesce(1).write.mode("append").parquet(os.path.join(root, "req"))
        spark.createDataFrame([(-day, "tick", at(86400 * day), 1, "deny", "", "")], kind_d).coalesce(1).write.mode("append").parquet(os.path.join(root, "dec"))
    req, dec = (common.file_stream(spark, os.path.join(root, n), spark.createDataFrame([], k).schema, max_files=1) for n, k in (("req", kind_r), ("dec", kind_d)))
    got = _run(pairing_stream(req, dec, "20 minutes", initial), root).filter("deployment_id = 'd'")
    assert sorted((r.decision_id, r.status) for r in got.filter("kind = 'outcome'").collect()) == sorted(want)
    assert sorted((r.user_id, r.user_name) for r in got.filter("kind = 'approval'").collect()) == sorted(approved)

    # What batch O16 leaves, as the stream's first state: the decisions that remain for it.
    pend = spark.createDataFrame([(d, p, c, t0, 0, u, n) for d, p, c, u, n in old], kind_r).withColumnRenamed("ts", "created_at")
    first = spark.createDataFrame([(1, "d", t0, 1, "deny", "tg", "c60"), (2, "d", t0, 2, "approve", "tg", "c61")], kind_d)
    _, remaining, _ = P.resolve_decisions(pend, first)
    again = spark.createDataFrame([(3, "d", at(9), 3, "approve", "tg", "c60"), (4, "d", at(9), 4, "approve", "tg", "c61"), (5, "d", at(9), 5, "approve", "tg", "c62")], kind_d)
    out = pairing_stream(spark.createDataFrame([], kind_r), again, "1 minute", remaining)
    assert sorted((r.decision_id, r.status) for r in out.filter("kind = 'outcome'").collect()) == [(3, 404), (4, 404), (5, 200)]


def test_st4_event_order_late_reply_and_missed(spark):
    """Micro-batches in any order give the batch outcomes; the reply to a poll begun
    before the expiry counts after it; rows beyond the lateness are reported."""
    from gatewarden.streaming.device_flow import device_flow_stream, missed_outcomes

    common.use_rocksdb_state(spark)
    rnd = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    kind_f = "flow_id string, started_at timestamp, expires_at timestamp, interval_s int"
    kind_p = "flow_id string, ts timestamp, seq long, http_status int, body_ok boolean, error string, error_description string"
    flows = [(f"f{i}", at(i), at(i + rnd.choice([60, 300])) if i % 4 else None, rnd.choice([5, 20, 40])) for i in range(30)]
    errors = ["authorization_pending"] * 6 + ["slow_down", "slow_down", "access_denied"]
    polls = [(f"f{i}", at(i + 7 * j), j, rnd.choice([400] * 12 + [200]), rnd.random() < 0.8, rnd.choice(errors), None) for i in range(30) for j in range(1, 20)]
    flows.append(("last", at(0), at(100), 5))
    polls.append(("last", at(104), 1, 200, True, None, None))
    df, dp = spark.createDataFrame(flows, kind_f), spark.createDataFrame(polls, kind_p)
    root = _scratch()
    rnd.shuffle(flows), rnd.shuffle(polls)
    for k in range(3):
        spark.createDataFrame(flows[k::3], kind_f).coalesce(1).write.mode("append").parquet(os.path.join(root, "flows"))
        spark.createDataFrame(polls[k::3], kind_p).coalesce(1).write.mode("append").parquet(os.path.join(root, "polls"))
    for day in (2, 3):
        spark.createDataFrame([(f"tick{day}", at(86400 * day), None, 5)], kind_f).coalesce(1).write.mode("append").parquet(os.path.join(root, "flows"))
        spark.createDataFrame([(f"tick{day}", at(86400 * day), 1, 400, True, "authorization_pending", None)], kind_p).coalesce(1).write.mode("append").parquet(os.path.join(root, "polls"))
    fs = common.file_stream(spark, os.path.join(root, "flows"), df.schema, max_files=1)
    ps = common.file_stream(spark, os.path.join(root, "polls"), dp.schema, max_files=1)
    got = _run(device_flow_stream(fs, ps, "1 hour"), root)
    assert missed_outcomes(df, dp, at(90_000), got).count() == 0
    assert {r.flow_id: r.status for r in got.collect()}["last"] == "authorized"
    assert got.filter("flow_id not like 'tick%'").count() == df.count()
    late = spark.createDataFrame([("f1", at(2), 0, 200, True, None, None)], kind_p)
    assert [r.flow_id for r in missed_outcomes(df, dp.unionByName(late), at(90_000), got).collect()] == ["f1"]
    batch = device_flow_stream(df, dp, "1 hour")
    assert missed_outcomes(df, dp, at(90_000), batch).count() == 0 and batch.count() == df.count()


def test_st5_integrations_equal_batch_and_emit_changes_only(spark):
    from gatewarden.operators.settings import integration_status
    from gatewarden.streaming.integrations import integration_stream, latest_integrations

    common.use_rocksdb_state(spark)
    t0 = dt.datetime(2024, 1, 1)
    kind = "deployment_id string, ts timestamp, key string, value string"
    snapshots = [
        [("a", "OPENROUTER_API_KEY", "k"), ("a", "WHATSAPP_ENABLED", "false"), ("a", "X", "1"), ("b", "TELEGRAM_BOT_TOKEN", "t")],
        [("a", "WHATSAPP_ENABLED", "yes"), ("a", "X", "1"), ("b", "TELEGRAM_BOT_TOKEN", "t2")],
        [("a", "WHATSAPP_ENABLED", "yes"), ("b", "NOTHING", None)],
    ]
    root = _scratch()
    import time

    for n, rows in enumerate(snapshots):
        at = t0 + dt.timedelta(hours=n)
        spark.createDataFrame([(d, at, k, v) for d, k, v in rows], kind).coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
        time.sleep(1.1)
    schema = spark.createDataFrame([], kind).schema
    got = _run(integration_stream(common.file_stream(spark, os.path.join(root, "in"), schema, max_files=1)), root)
    last = spark.createDataFrame([(d, k, v) for d, k, v in snapshots[-1]], "deployment_id string, key string, value string")
    want = sorted(map(tuple, integration_status(last.select("deployment_id"), last).collect()))
    assert sorted(map(tuple, latest_integrations(got).collect())) == want
    later = sorted((r.deployment_id, r.kind, r.configured) for r in got.filter(F.col("ts") > F.lit(t0)).collect())
    assert later == [("a", "channel", True), ("a", "provider", False), ("b", "channel", False)]
    whole = spark.read.parquet(os.path.join(root, "in"))
    assert sorted(map(str, integration_stream(whole).collect())) == sorted(map(str, got.collect()))


class _Handle:
    """State of one key in memory, in place of Spark's handle."""

    class _Map(dict):
        containsKey = dict.__contains__
        getValue = dict.get
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    def __init__(self):
        self.states = {}

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, self._Map())

    def getValueState(self, name, *schemas):
        return None


def test_st5_calls_serve_many_deployments():
    """One call of a processor, and one state entry, serves all deployments of a page."""
    import pandas as pd

    from gatewarden.functions import constants as C
    from gatewarden.operators.settings import integration_catalogue
    from gatewarden.streaming.integrations import IntegrationProcessor
    from gatewarden.streaming.status import StatusProcessor

    names = [None, *[f"d{i}" for i in range(300)]]
    handle, cols = _Handle(), ["deployment_id", "us", "seq", "event", "pid"]
    status = StatusProcessor()
    status.init(handle)
    first = pd.DataFrame([(d, 10 + i, i, "start", 2**60 + i) for i, d in enumerate(names)] + [("quiet", 1, 1, "backoff", 5)], columns=cols)
    got = pd.concat(status.handleInputRows((7,), iter([first[:100], first[100:]]), None))
    assert [tuple(r)[:4] for r in got.itertuples(index=False)] == [(d, 10 + i, "running", 2**60 + i) for i, d in enumerate(names)]
    assert 0 < len(handle.states["status_pages"]) <= common.PAGES
    # Later rows find the states; older ones change nothing; deployments that are not touched show nothing.
    then = pd.DataFrame([("d3", 900, 900, "exit", None), (None, 900, 901, "restart", 4), ("d5", 1, 0, "exit", None)], columns=cols)
    got = pd.concat(status.handleInputRows((7,), iter([then]), None))
    assert {r.deployment_id: (r.state, r.event_us, r.restarts) for r in got.itertuples()} == {
        "d3": ("error", 900, 0), None: ("running", 900, 1), "d5": ("running", 16, 0),
    }

    handle, cols = _Handle(), ["deployment_id", "us", "key", "value", "as_provider", "as_channel"]
    flags = IntegrationProcessor(integration_catalogue(C.REGISTRY))
    flags.init(handle)
    key = next(s for kind, _, s, _ in flags.catalogue if kind != "channel")
    frame = pd.DataFrame([(d, 5, key, "k", True, True) for d in names] + [("d1", 6, None, None, False, False)], columns=cols)
    got = pd.concat(flags.handleInputRows((7,), iter([frame]), None))
    assert (got[got.us == 5].groupby("deployment_id", dropna=False).size() == len(flags.catalogue)).all()
    assert set(got[got.us == 6].deployment_id) == {"d1"} and not got[got.us == 6].configured.any()
    assert not list(flags.handleInputRows((7,), iter([frame[:10]]), None))
