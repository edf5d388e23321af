"""Hot keys: one deployment holding a third of all rows.

The results must stay exact, and the work of the hot deployment must be
split: no (key, bucket) group of the bucketed plans may hold more than a
small share of the hot key's rows.
"""

import datetime as dt
import random

from pyspark.sql import functions as F

from gatewarden.operators import lifecycle as L
from gatewarden.operators.scans import ScanSpec, bucket_of, micros, ordered_scan, ordered_scan_single_window

T0 = dt.datetime(2024, 1, 1)


def skewed_events(spark, n=6000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        dep = "hot" if i % 3 == 0 else f"d{rnd.randint(0, 400)}"
        rows.append((dep, T0 + dt.timedelta(seconds=rnd.randint(0, 30 * 86400)), i, rnd.choice(["exit", "exit", "start"])))
    return spark.createDataFrame(rows, "deployment_id string, ts timestamp, seq long, event string"), rows


def test_crash_loop_hot_key_exact_and_split(spark):
    from test_lifecycle import brute_crash

    df, rows = skewed_events(spark)
    secs = [(d, (t - T0).total_seconds(), q, e) for d, t, q, e in rows]
    expect = brute_crash(secs, window_s=3600)
    res = L.respawn_delay(L.crash_loop(df, F.col("event") == "exit", F.col("event") == "start", window_s=3600, bucket_s=3600))
    got = sorted((r.deployment_id, r.seq, r.exits_in_window, r.verdict, r.delay_s) for r in res.collect())
    assert got == expect
    # the hot deployment is spread over many (key, bucket) groups
    b = df.filter("deployment_id = 'hot'").withColumn("__t", micros("ts")).select(bucket_of("__t", 3600 * 1_000_000).alias("b"))
    sizes = [r["count"] for r in b.groupBy("b").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 0.02 * sum(sizes)


def test_ordered_scan_hot_key_matches_single_window(spark):
    df, _ = skewed_events(spark, n=4000, seed=2)
    df = df.withColumn("t", micros("ts"))
    specs = [ScanSpec("n", "sum", F.when(F.col("event") == "exit", 1).otherwise(0)),
             ScanSpec("last_start", "last", F.when(F.col("event") == "start", F.col("seq")))]
    a = sorted(tuple(r) for r in ordered_scan(df, ["deployment_id"], "t", ["t", "seq"], specs, bucket_s=6 * 3600)
               .select("deployment_id", "seq", "n", "last_start").collect())
    b = sorted(tuple(r) for r in ordered_scan_single_window(df, ["deployment_id"], ["t", "seq"], specs)
               .select("deployment_id", "seq", "n", "last_start").collect())
    assert a == b


def test_tail_above_window_group_limit_threshold(spark):
    df, rows = skewed_events(spark, n=3000, seed=3)
    lines = df.select("deployment_id", F.lit("gateway").alias("source"), "ts", "seq")
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        got = sorted((r.deployment_id, r.seq, r.newest_rank) for r in L.tail_per_source(lines, n=50).collect())
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)
    by = {}
    for d, t, q, _ in rows:
        by.setdefault(d, []).append((t, q))
    expect = []
    for d, v in by.items():
        for rank, (t, q) in enumerate(sorted(v, reverse=True)[:50], start=1):
            expect.append((d, q, rank))
    assert got == sorted(expect)


def _largest_tasks(spark, df):
    """Rows that the largest of the final tasks counted, and all of them."""
    out = df.select("*", F.spark_partition_id().alias("__p"))
    sizes = [r["count"] for r in out.groupBy("__p").count().collect()]
    return max(sizes), sum(sizes)


def test_crash_loop_window_of_ten_days_splits_a_hot_key(spark):
    """The window holds a third of the hot key's rows: buckets narrower than it give the
    same counts as one window per key, and no task holds more than a share of the key."""
    from test_lifecycle import brute_crash

    ten_days = 10 * 86400
    df, rows = skewed_events(spark, n=4000, seed=7)
    # Ties of time, exits exactly a window apart, resets at the same moment.
    more = [("hot", T0 + dt.timedelta(seconds=s), 10_000 + i, e) for i, (s, e) in enumerate([(5, "exit"), (5, "start"), (5, "exit"), (5 + ten_days, "exit"), (5 + ten_days, "exit")])]
    df = df.unionByName(spark.createDataFrame(more, df.schema))
    secs = [(d, (t - T0).total_seconds(), q, e) for d, t, q, e in rows + more]
    kinds = (F.col("event") == "exit", F.col("event") == "start")
    expect = brute_crash(secs, window_s=ten_days)
    res = L.respawn_delay(L.crash_loop(df, *kinds, window_s=ten_days, hot_rows=50))
    assert sorted((r.deployment_id, r.seq, r.exits_in_window, r.verdict, r.delay_s) for r in res.collect()) == expect
    wide = L.crash_loop(df, *kinds, window_s=ten_days, hot_rows=10**9)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, res.drop("delay_s").collect()))

    hot = df.filter("deployment_id = 'hot'")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        most, total = _largest_tasks(spark, L.crash_loop(hot, *kinds, window_s=ten_days, hot_rows=50))
        assert most < 0.12 * total
        unsplit, _ = _largest_tasks(spark, L.crash_loop(hot, *kinds, window_s=ten_days, hot_rows=10**9))
        assert unsplit > 2 * most  # a third of the key's span is one task
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_crash_loop_timestamp_ntz_and_null_key_when_split(spark):
    df, _ = skewed_events(spark, n=900, seed=8)
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("deployment_id", F.when(F.col("deployment_id") != "hot", F.lit("x")))
    kinds = (F.col("event") == "exit", F.col("event") == "start")
    a = L.crash_loop(df, *kinds, window_s=5 * 86400, hot_rows=20)
    b = L.crash_loop(df, *kinds, window_s=5 * 86400, hot_rows=10**9)
    assert a.schema == b.schema
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.filter("deployment_id is null").count() > 0
