"""Lifecycle jobs: crash loop (O20/O21), tail (O19), state (O22/O23), locks (O24), device flow."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gatewarden.operators import lifecycle as L
from gatewarden.operators.scans import ScanSpec, micros, ordered_scan, ordered_scan_single_window

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(s):
    return T0 + dt.timedelta(seconds=s)


def events_df(spark, rows):
    """rows: (dep, seconds, seq, event)"""
    return spark.createDataFrame(
        [(d, ts(s), q, e) for d, s, q, e in rows], "deployment_id string, ts timestamp, seq long, event string"
    )


def crash(spark, rows, **kw):
    ev = events_df(spark, rows)
    res = L.respawn_delay(L.crash_loop(ev, F.col("event") == "exit", F.col("event") == "start", **kw))
    return sorted((r.deployment_id, r.seq, r.exits_in_window, r.verdict, r.delay_s) for r in res.collect())


def brute_crash(rows, window_s=120, max_exits=5):
    """The supervisor's own loop: prune exits older than the window, append, count."""
    out = []
    by_dep = {}
    for d, s, q, e in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        recent = by_dep.setdefault(d, [])
        if e == "start":
            recent.clear()
        elif e == "exit":
            recent[:] = [t for t in recent if s - t < window_s]
            recent.append(s)
            n = len(recent)
            v = "crashed" if n > max_exits else "respawn"
            delay = int(min(2.0 * 2 ** (n - 1), 30.0)) if v == "respawn" else None
            out.append((d, q, n, v, delay))
    return sorted(out)


def test_five_exits_then_sixth_crashes(spark):
    rows = [("a", i * 10, i, "exit") for i in range(6)]
    got = crash(spark, rows)
    assert [g[2] for g in got] == [1, 2, 3, 4, 5, 6]
    assert [g[3] for g in got] == ["respawn"] * 5 + ["crashed"]
    assert [g[4] for g in got] == [2, 4, 8, 16, 30, None]


def test_exactly_window_apart_not_counted_together(spark):
    got = crash(spark, [("a", 0, 1, "exit"), ("a", 120, 2, "exit"), ("a", 239.999, 3, "exit")])
    assert [g[2] for g in got] == [1, 1, 2]


def test_equal_timestamps_counted_one_at_a_time(spark):
    got = crash(spark, [("a", 5, 1, "exit"), ("a", 5, 2, "exit"), ("a", 5, 3, "exit")])
    assert [g[2] for g in got] == [1, 2, 3]


def test_manual_start_resets_budget(spark):
    got = crash(spark, [("a", 0, 1, "exit"), ("a", 1, 2, "exit"), ("a", 2, 3, "start"), ("a", 3, 4, "exit")])
    assert [g[2] for g in got] == [1, 2, 1]


def test_bucket_boundaries_and_small_buckets(spark):
    rnd = random.Random(7)
    rows = []
    for d in "abc":
        t = 0.0
        for q in range(120):
            t += rnd.choice([0, 0.5, 3, 20, 60, 119.5, 120, 400])
            rows.append((d, round(t, 3), q, rnd.choice(["exit"] * 5 + ["start"])))
    expect = brute_crash(rows)
    assert crash(spark, rows) == expect
    # bucket narrower than the window is widened to the window; wider buckets too
    assert crash(spark, rows, bucket_s=1) == expect
    assert crash(spark, rows, bucket_s=86400) == expect


def test_lifecycle_crash_loop_ignores_exit_during_stop_and_live_start(spark):
    rows = [
        ("a", 0, 1, "start"), ("a", 1, 2, "running"),
        ("a", 10, 3, "exit"),            # counted: 1
        ("a", 12, 4, "respawn"),
        ("a", 20, 5, "exit"),            # counted: 2
        ("a", 22, 6, "respawn"),
        ("a", 25, 7, "start"),           # start on a live process: no reset
        ("a", 30, 8, "exit"),            # counted: 3
        ("a", 31, 9, "stop"),
        ("a", 32, 10, "exit"),           # exit during a deliberate stop: ignored
        ("a", 40, 11, "restart"),        # restart always resets
        ("a", 50, 12, "exit"),           # counted: 1
    ]
    res = L.lifecycle_crash_loop(events_df(spark, rows)).collect()
    assert sorted((r.seq, r.exits_in_window) for r in res) == [(3, 1), (5, 2), (8, 3), (12, 1)]


def test_ordered_scan_equals_single_window(spark):
    rnd = random.Random(3)
    data = []
    for d in range(4):
        for q in range(300):
            data.append((d, ts(rnd.randint(0, 20000)), q, rnd.choice([None, 1, 2, 3]), rnd.random() < 0.3))
    df = spark.createDataFrame(data, "k int, ts timestamp, seq int, v int, flag boolean").withColumn("t", micros("ts"))
    specs = [
        ScanSpec("s", "sum", F.col("v")),
        ScanSpec("m", "max", F.col("v")),
        ScanSpec("l", "last", F.when(F.col("flag"), F.col("seq"))),
        ScanSpec("le", "last", F.when(F.col("flag"), F.col("seq")), exclusive=True),
        ScanSpec("se", "sum", F.col("v"), exclusive=True),
    ]
    a = ordered_scan(df, ["k"], "t", ["t", "seq"], specs, bucket_s=600)
    b = ordered_scan_single_window(df, ["k"], ["t", "seq"], specs)
    ra = sorted(((r.k, r.seq, r.s, r.m, r.l, r.le, r.se) for r in a.collect()), key=lambda x: (x[0], x[1]))
    rb = sorted(((r.k, r.seq, r.s, r.m, r.l, r.le, r.se) for r in b.collect()), key=lambda x: (x[0], x[1]))
    assert ra == rb and len(ra) == 1200


def test_tail_per_source(spark):
    rows = [("a", "gateway", ts(i), i) for i in range(7)] + [("a", "gateway", ts(6), 99)] + [("b", "dashboard", ts(1), 1)]
    df = spark.createDataFrame(rows, "deployment_id string, source string, ts timestamp, seq long")
    got = sorted((r.deployment_id, r.seq, r.newest_rank) for r in L.tail_per_source(df, n=3).collect())
    assert got == [("a", 5, 3), ("a", 6, 2), ("a", 99, 1), ("b", 1, 1)]


def test_tail_plans_window_group_limit(spark):
    df = spark.createDataFrame([("a", "g", ts(1), 1)], "deployment_id string, source string, ts timestamp, seq long")
    plan = L.tail_per_source(df, n=500)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_lifecycle_state_transitions(spark):
    rows = [
        ("run", 0, 1, "start", 11), ("run", 100, 2, "start", 12),    # second start on a live process: no-op
        ("err", 0, 1, "start", 21), ("err", 50, 2, "exit", None),
        ("stp", 0, 1, "start", 31), ("stp", 10, 2, "stop", None),
        ("rst", 0, 1, "start", 41), ("rst", 500, 2, "restart", 42),
        ("crs", 0, 1, "exit", None), ("crs", 1, 2, "crashed", None),
        ("unr", 0, 1, "exit", None), ("unr", 2, 2, "unready", None),
        ("late", 0, 1, "start", 51), ("late", 5000, 2, "stop", None),  # after as_of
    ]
    df = spark.createDataFrame(
        [(d, ts(s), q, e, p) for d, s, q, e, p in rows],
        "deployment_id string, ts timestamp, seq long, event string, pid long",
    )
    deps = spark.createDataFrame([(d,) for d in ["run", "err", "stp", "rst", "crs", "unr", "late", "none"]], "deployment_id string")
    res = {r.deployment_id: r for r in L.lifecycle_state(df, ts(1000), deployments=deps).collect()}
    assert (res["run"].state, res["run"].pid, res["run"].uptime_s) == ("running", 11, 1000)
    assert (res["err"].state, res["err"].uptime_s) == ("error", None)
    assert res["stp"].state == "stopped"
    assert (res["rst"].state, res["rst"].pid, res["rst"].uptime_s, res["rst"].restarts) == ("running", 42, 500, 1)
    assert res["crs"].state == "crashed"
    assert res["unr"].state == "stopped"
    assert (res["late"].state, res["late"].uptime_s) == ("running", 1000)
    assert (res["none"].state, res["none"].restarts) == ("stopped", 0)


def test_stale_locks(spark):
    locks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "deployment_id string, pid long")
    exits = spark.createDataFrame([("a", 1), ("a", 1), ("c", 2)], "deployment_id string, pid long")
    got = sorted(tuple(r) for r in L.stale_locks(locks, exits).select("deployment_id", "pid", "stale").collect())
    assert got == [("a", 1, True), ("a", 2, False), ("b", 1, False)]
    assert sorted(tuple(r) for r in L.cleared_locks(locks, exits).collect()) == [("a", 2), ("b", 1)]


def test_device_flow_outcomes(spark):
    flows = spark.createDataFrame(
        [
            ("ok", ts(0), ts(900), 5), ("slow", ts(0), ts(900), 5), ("forty", ts(0), ts(900), 40),
            ("exp", ts(0), ts(100), 5), ("bad", ts(0), ts(900), 5), ("err1", ts(0), ts(900), 5),
            ("err2", ts(0), ts(900), 5), ("late", ts(0), ts(100), 5),
        ],
        "flow_id string, started_at timestamp, expires_at timestamp, interval_s int",
    )
    P = [
        ("ok", 5, 1, 200, True, None, None),
        ("slow", 5, 1, 400, True, "slow_down", None), ("slow", 15, 2, 400, True, "slow_down", None),
        ("slow", 30, 3, None, None, None, None), ("slow", 45, 4, 400, True, "authorization_pending", None),
        ("forty", 40, 1, 400, True, "slow_down", None), ("forty", 70, 2, 400, True, "authorization_pending", None),
        ("exp", 5, 1, 400, True, "authorization_pending", None), ("exp", 99, 2, 400, True, "authorization_pending", None),
        ("bad", 5, 1, 200, False, None, None),
        ("err1", 5, 1, 400, True, "access_denied", "User said no"),
        ("err2", 5, 1, 400, True, "expired_token", ""),
        ("late", 104, 1, 200, True, None, None),  # loop entered at 99 < expiry: the reply still counts
    ]
    polls = spark.createDataFrame(
        [(f, ts(s), q, st, ok, e, d) for f, s, q, st, ok, e, d in P],
        "flow_id string, ts timestamp, seq long, http_status int, body_ok boolean, error string, error_description string",
    )
    res = {r.flow_id: (r.status, r.error, r.interval_s) for r in L.device_flow_outcome(flows, polls, ts(1000)).collect()}
    assert res["ok"] == ("authorized", None, 5)
    assert res["slow"] == ("pending", None, 15) or res["slow"][0] == "expired"
    assert res["forty"][2] == 30  # a slow-down lowers an interval that began above 30
    assert res["exp"] == ("expired", None, 5)
    assert res["bad"] == ("error", "Invalid token response from xAI", 5)
    assert res["err1"] == ("error", "User said no", 5)
    assert res["err2"] == ("error", "expired_token", 5)
    assert res["late"][0] == "authorized"


def test_lifecycle_from_log_events_and_state_ignores_non_state_events(spark):
    typed = spark.createDataFrame(
        [
            ("a", ts(0), 1, "start"),
            ("a", ts(10), 2, "exit"),
            ("a", ts(10), 3, "respawn_scheduled"),
            ("a", ts(12), 4, "start"),              # the supervised respawn
            ("a", ts(20), 5, "exit"),
            ("a", ts(20), 6, "respawn_scheduled"),
            ("a", ts(21), 7, "respawn_cancelled"),  # a stop won the race
            ("a", ts(30), 8, "start"),              # manual start: resets the budget
            ("a", ts(40), 9, "exit"),
            ("a", ts(40), 10, "lock_cleared"),
        ],
        "deployment_id string, ts timestamp, seq long, event string",
    ).withColumn("delay_s", F.when(F.col("event") == "respawn_scheduled", 2))
    lc = L.lifecycle_from_log_events(typed)
    assert [r.event for r in lc.orderBy("seq").collect()] == ["start", "exit", "respawn", "exit", "start", "exit"]
    res = sorted((r.seq, r.exits_in_window) for r in L.lifecycle_crash_loop(lc).collect())
    assert res == [(2, 1), (5, 2), (9, 1)]
    st = L.lifecycle_state(typed, ts(100)).first()
    assert st.state == "error"  # the trailing lock clean-up does not blank the state


def test_fused_log_crash_loop_equals_adapter_then_crash_loop(spark):
    rnd = random.Random(11)
    kinds = ["start", "exit", "exit", "respawn_scheduled", "respawn_cancelled", "crashed", "unready", "start_failed", "lock_cleared"]
    rows = [(rnd.choice("ab"), rnd.randrange(0, 2000), q, rnd.choice(kinds)) for q in range(400)]
    typed = events_df(spark, rows).withColumn("delay_s", F.when(F.col("event") == "respawn_scheduled", (F.col("seq") % 4).cast("int")))
    cols = ["deployment_id", "seq", "exits_in_window", "verdict", "delay_s"]
    composed = L.lifecycle_crash_loop(L.lifecycle_from_log_events(typed, bucket_s=50), bucket_s=200)
    fused = L.crash_loop_from_log_events(typed, bucket_s=200)
    want = sorted(tuple(r) for r in composed.select(*cols).collect())
    got = sorted(tuple(r) for r in fused.select(*cols).collect())
    assert got == want
    assert any(r[3] == "crashed" for r in got) and any(r[3] == "respawn" for r in got)
    assert L.lifecycle_from_log_events(typed).filter(F.col("event") == "respawn").count() > 0


def test_start_inside_the_backoff_is_manual(spark):
    typed = spark.createDataFrame(
        [
            ("a", ts(0), 1, "exit", None), ("a", ts(0), 2, "respawn_scheduled", 2), ("a", ts(1), 3, "start", None), ("a", ts(5), 4, "exit", None),
            ("b", ts(0), 1, "exit", None), ("b", ts(0), 2, "respawn_scheduled", 2), ("b", ts(2), 3, "start", None), ("b", ts(5), 4, "exit", None),
        ],
        "deployment_id string, ts timestamp, seq long, event string, delay_s int",
    )
    got = {(r.deployment_id, r.seq): r.exits_in_window for r in L.crash_loop_from_log_events(typed).collect()}
    assert got == {("a", 1): 1, ("a", 4): 1, ("b", 1): 1, ("b", 4): 2}


def test_flow_without_expiry_has_the_default_life(spark):
    flows = spark.createDataFrame([("f", ts(0), None, 5)], "flow_id string, started_at timestamp, expires_at timestamp, interval_s int")
    polls = spark.createDataFrame(
        [("f", ts(1000), 1, 200, True, None, None)],
        "flow_id string, ts timestamp, seq long, http_status int, body_ok boolean, error string, error_description string",
    )
    assert L.device_flow_outcome(flows, polls, ts(2000)).first().status == "expired"
    assert L.device_flow_outcome(flows, polls, ts(800)).first().status == "pending"


def _typed(spark, rows):
    kind = "deployment_id string, ts timestamp, seq long, event string, delay_s int, pid long"
    return spark.createDataFrame([(d, ts(s), q, e, w, p) for d, s, q, e, w, p in rows], kind)


def test_state_on_log_events(spark):
    rows = [
        ("up", 0, 1, "start", None, 11),
        ("again", 0, 1, "start", None, 21), ("again", 60, 2, "start", None, 22),  # a stop in between leaves no line
        ("failed", 0, 1, "start", None, 31), ("failed", 1, 2, "start_failed", None, None),
        ("failing", 95, 1, "start", None, 41), ("failing", 105, 2, "start_failed", None, None),
        ("back", 0, 1, "start", None, 51), ("back", 10, 2, "exit", None, None), ("back", 10, 3, "respawn_scheduled", 2, None),
        ("back", 12, 4, "start", None, 52),
        ("waits", 0, 1, "start", None, 61), ("waits", 10, 2, "exit", None, None), ("waits", 10, 3, "respawn_scheduled", 2, None),
        ("gone", 0, 1, "start", None, 71), ("gone", 10, 2, "crashed", None, None),
    ]
    want = {
        "up": ("running", 11, 100, 0), "again": ("running", 22, 40, 0), "failed": ("error", None, None, 0),
        "failing": ("starting", None, None, 0), "back": ("running", 52, 88, 1), "waits": ("error", None, None, 0),
        "gone": ("crashed", None, None, 0),
    }
    typed = _typed(spark, rows)
    for got in (L.lifecycle_state(L.lifecycle_from_log_events(typed), ts(100)), L.lifecycle_state_from_log_events(typed, ts(100))):
        assert {r.deployment_id: (r.state, r.pid, r.uptime_s, r.restarts) for r in got.collect()} == want


def test_fused_state_equals_adapter_then_state(spark):
    rnd = random.Random(23)
    kinds = ["start", "start", "exit", "respawn_scheduled", "respawn_cancelled", "crashed", "unready", "start_failed", "lock_cleared"]
    rows = [(f"d{rnd.randrange(60)}", rnd.randrange(0, 2000), q, rnd.choice(kinds), 2 * (q % 4), q) for q in range(900)]
    typed = _typed(spark, rows)
    composed = L.lifecycle_state(L.lifecycle_from_log_events(typed, bucket_s=70), ts(1500), bucket_s=300)
    fused = L.lifecycle_state_from_log_events(typed, ts(1500), bucket_s=50)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, composed.collect()))
    assert len({r.state for r in fused.collect()}) >= 4


def test_next_scan_equals_single_window(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), rnd.randrange(0, 400), q, rnd.choice([None, q])) for q in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, v long")
    specs = [ScanSpec("n", "next", F.col("v")), ScanSpec("ne", "next", F.col("v"), exclusive=True), ScanSpec("l", "last", F.col("v"), exclusive=True)]
    cut = ordered_scan(df.withColumn("t", F.col("t") * 1_000_000), ["k"], "t", ["t", "seq"], specs, bucket_s=7)
    whole = ordered_scan_single_window(df, ["k"], ["t", "seq"], specs)
    cols = ["k", "seq", "n", "ne", "l"]
    assert sorted(map(str, cut.select(cols).collect())) == sorted(map(str, whole.select(cols).collect()))


def test_starting_and_stopping_only_from_their_own_events(spark):
    rows = [
        ("a", 0, 1, "start"), ("a", 5, 2, "stopping"), ("b", 0, 1, "starting"), ("c", 0, 1, "start"), ("c", 5, 2, "stop"), ("c", 6, 3, "exit"),
        ("d", 0, 1, "starting"), ("d", 3, 2, "running"), ("e", 0, 1, "start"), ("e", 5, 2, "stop"), ("e", 9, 3, "start"), ("f", 0, 1, "stop"),
    ]
    got = {r.deployment_id: (r.state, r.uptime_s) for r in L.lifecycle_state(events_df(spark, rows), ts(10)).collect()}
    assert got == {"a": ("stopping", None), "b": ("starting", None), "c": ("stopped", None), "d": ("running", 7), "e": ("running", 1), "f": ("stopped", None)}
