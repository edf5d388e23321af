"""Lifecycle jobs: log tails, crash-loop guard, backoff, state, locks, device flows.

Input conventions (see FIXTURES.md): ``lifecycle_events`` has a key column
(default ``deployment_id``), an event time ``ts`` (TIMESTAMP or
TIMESTAMP_NTZ, UTC), a per-key sequence ``seq`` that breaks ties, and an
``event`` string from the vocabulary below.

Event vocabulary (typed by :func:`gatewarden.sources.logs.extract_lifecycle_events`
or written by the caller):

==============  =============================================================
``start``       boot / Start button: a child is spawned; a no-op on a live process
``starting``    a spawn has begun (only from sources that tell it apart from ``start``)
``running``     child spawned
``start_failed``spawn failed
``stop``        deliberate stop: the child is gone when it returns
``stopping``    a stop has begun, the child still lives (as ``starting``)
``stopped``     stop finished
``restart``     Restart button: stop, then a start that always runs
``exit``        unexpected exit of the current child
``respawn``     supervised respawn (does *not* reset the crash budget)
``crashed``     crash-loop guard gave up
``unready``     respawn skipped, configuration incomplete
==============  =============================================================
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from .scans import DEFAULT_BUCKET_S, ScanSpec, as_timestamp, bucket_of, micros, ordered_scan

# ---------------------------------------------------------------------------
# O19 tail_per_source
# ---------------------------------------------------------------------------


#: Buckets of each key in the first level of a tail.
TAIL_BUCKETS = 32


def tail_per_source(
    lines: DataFrame,
    n: int = C.GATEWAY_LOG_LINES,
    keys: Sequence[str] = ("deployment_id", "source"),
    ts: str = "ts",
    seq: str = "seq",
) -> DataFrame:
    """Ring buffer: the newest ``n`` lines per key, with ``newest_rank`` (1 = newest).

    In two levels for every ``n``: the newest ``n`` of each (key, hash bucket of the
    row), then of each key.  The last task of a hot key reads at most
    ``TAIL_BUCKETS * n`` rows, however many partitions the input has.  For ``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default) Catalyst also
    limits every map partition before each shuffle (``WindowGroupLimit``).
    """
    keys = list(keys)
    order = [F.col(ts).desc(), F.col(seq).desc()]
    bucket = F.pmod(F.xxhash64(F.col(ts), F.col(seq)), F.lit(TAIL_BUCKETS))
    per_bucket = Window.partitionBy(*keys, bucket).orderBy(*order)
    src = lines.withColumn("__rn", F.row_number().over(per_bucket)).filter(F.col("__rn") <= n).drop("__rn")
    w = Window.partitionBy(*keys).orderBy(*order)
    return src.withColumn("newest_rank", F.row_number().over(w)).filter(F.col("newest_rank") <= n)


# ---------------------------------------------------------------------------
# O20 crash_loop + O21 respawn_delay
# ---------------------------------------------------------------------------


# Rows of one key in one window beyond which one task should not hold them.
HOT_ROWS = 2_000_000
# So many hot keys at most are broadcast; more are joined.
MAX_BROADCAST_KEYS = 100_000


def crash_loop(
    events: DataFrame,
    is_exit: Column,
    is_reset: Column,
    key: str = "deployment_id",
    ts: str = "ts",
    seq: str = "seq",
    window_s: float = C.CRASH_WINDOW_S,
    max_exits: int = C.CRASH_MAX_EXITS,
    bucket_s: int = DEFAULT_BUCKET_S,
    hot_rows: int = HOT_ROWS,
    to_count: DataFrame | None = None,
) -> DataFrame:
    """Rolling count of unexpected exits, one output row per exit.

    ``exits_in_window`` counts the exits of the same key whose time is
    *strictly* less than ``window_s`` before this one, this one included,
    in (ts, seq) order, and only those after the latest budget reset
    (``is_reset``) that precedes it.  ``verdict`` is ``crashed`` when the
    count exceeds ``max_exits`` (the 6th exit with the defaults), else
    ``respawn``.

    With ``Cnt`` = running number of exits in (ts, seq) order,
    ``exits_in_window = Cnt(self) - max(Cnt(last reset), Cnt(ts - window))``.
    Keys are cut into time buckets, so no task holds a whole key.  Buckets at
    least a window wide need one shuffle and no carry (:func:`_counts_in_wide`).
    Where a window is wider than ``bucket_s``, keys with more than ``hot_rows``
    rows in one window are counted first, and those keys get buckets narrower
    than the window (:func:`_counts_in_narrow`).  ``to_count`` gives a cheaper
    superset of the exits and resets to count where ``events`` is costly.
    """
    w_us = int(round(window_s * 1_000_000))
    base = events.filter(is_exit | is_reset).select(
        F.col(key).alias("__key"),
        F.col(ts).alias("__ts"),
        F.col(seq).alias("__seq"),
        micros(ts).alias("__t"),
        F.when(is_exit, F.lit(1)).otherwise(F.lit(0)).alias("__exit"),
    )
    wide_us = max(int(bucket_s) * 1_000_000, w_us)
    hot, most = None, 0
    if w_us > int(bucket_s) * 1_000_000:
        rows = base if to_count is None else to_count.select(F.col(key).alias("__key"), micros(ts).alias("__t"))
        hot, most = _hot_keys(rows, wide_us, hot_rows)
    if hot is None:
        counted = _counts_in_wide(base, w_us, wide_us)
    else:
        narrow_us = max(wide_us // -(-4 * most // hot_rows), 1)
        same = F.col("__key").eqNullSafe(F.col("__hot"))
        cold = _counts_in_wide(base.join(hot, same, "left_anti"), w_us, wide_us)
        counted = cold.unionByName(_counts_in_narrow(base.join(hot, same, "left_semi"), w_us, narrow_us))
    out = counted.select(F.col("__key").alias(key), F.col("__ts").alias(ts), F.col("__seq").alias(seq), F.col("__n").alias("exits_in_window"))
    return out.withColumn(
        "verdict", F.when(F.col("exits_in_window") > max_exits, F.lit("crashed")).otherwise(F.lit("respawn"))
    )


def _hot_keys(base: DataFrame, width_us: int, hot_rows: int) -> tuple[DataFrame | None, int]:
    """Keys with more than ``hot_rows`` rows in a bucket, and the most rows of any."""
    groups = base.groupBy("__key", bucket_of("__t", width_us).alias("__b")).agg(F.count(F.lit(1)).alias("__rows"))
    hot = groups.filter(F.col("__rows") > hot_rows).groupBy(F.col("__key").alias("__hot")).agg(F.max("__rows").alias("__rows"))
    n, most = hot.agg(F.count(F.lit(1)), F.max("__rows")).first()
    if not n:
        return None, 0
    return (F.broadcast(hot.select("__hot")) if n <= MAX_BROADCAST_KEYS else hot.select("__hot")), most


def _counts_in_wide(base: DataFrame, w_us: int, b_us: int) -> DataFrame:
    """Counts with buckets at least a window wide: one shuffle on (key, bucket).

    The rows an exit needs lie in its own bucket or in the last window of the
    previous one; those rows are copied into the next bucket as history (a W/B
    fraction of the input).  A reset older than that history cannot matter: its
    count is below ``Cnt(ts - window)``.  Inside a bucket the three counts are
    window columns over one sort: a ROWS running count, a RANGE count up to
    ``ts - window`` (inclusive, so exits exactly ``window_s`` earlier drop out),
    and the last reset's running count.
    """
    bkt = bucket_of("__t", b_us)
    own = F.struct(bkt.alias("b"), F.lit(True).alias("own"))
    hist = F.struct((bkt + 1).alias("b"), F.lit(False).alias("own"))
    copies = F.when(F.col("__t") >= (bkt + 1) * F.lit(b_us) - F.lit(w_us), F.array(own, hist)).otherwise(F.array(own))
    x = base.select("*", F.explode(copies).alias("__c")).select(
        "__key", "__ts", "__seq", "__t", "__exit", F.col("__c.b").alias("__b"), F.col("__c.own").alias("__own")
    )
    w_rows = (
        Window.partitionBy("__key", "__b")
        .orderBy("__t", "__seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    w_before = Window.partitionBy("__key", "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, -w_us)
    x = x.withColumn("__cnt", F.sum("__exit").over(w_rows)).withColumn(
        "__cnt_w", F.coalesce(F.sum("__exit").over(w_before), F.lit(0))
    )
    x = x.withColumn("__cnt_r", F.last(F.when(F.col("__exit") == 0, F.col("__cnt")), ignorenulls=True).over(w_rows))
    n = (F.col("__cnt") - F.greatest(F.coalesce("__cnt_r", F.lit(0)), F.col("__cnt_w"))).cast("bigint")
    return x.filter(F.col("__own") & (F.col("__exit") == 1)).select("__key", "__ts", "__seq", n.alias("__n"))


def _counts_in_narrow(base: DataFrame, w_us: int, b_us: int) -> DataFrame:
    """Counts with buckets of any width, for keys whose windows hold too many rows.

    An exit leaves the windows ``w_us`` after it: a second row at that moment,
    ahead of the events of the same moment, lands in the one bucket where the
    window's far end falls, so ``Cnt(ts - window)`` is a running count of such
    rows and needs no look at the buckets in between.  Each bucket counts its own
    rows; a table of one row per (key, bucket) carries the counts of whole
    earlier buckets and the last reset's count, and is joined back.
    """
    kind = dict(base.dtypes)["__ts"]
    exit_ = F.col("__exit") == 1
    # step: 0 an exit leaves the window, 1 an event.
    event = F.struct(F.col("__t").alias("t"), F.lit(1).alias("step"))
    leaves = F.struct((F.col("__t") + F.lit(w_us)).alias("t"), F.lit(0).alias("step"))
    x = base.select("__key", "__seq", "__exit", F.explode(F.when(exit_, F.array(event, leaves)).otherwise(F.array(event))).alias("__e"))
    x = x.select("__key", "__seq", "__exit", F.col("__e.t").alias("__t"), F.col("__e.step").alias("__step"))
    x = x.withColumn("__b", bucket_of("__t", b_us))
    rows = (
        Window.partitionBy("__key", "__b")
        .orderBy("__t", "__step", "__seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    x = x.withColumns(
        {
            "__in": F.sum(F.col("__exit") * F.col("__step")).over(rows),
            "__out": F.sum(1 - F.col("__step")).over(rows),
        }
    )
    x = x.withColumn("__at", F.last(F.when((F.col("__step") == 1) & ~exit_, F.col("__in")), ignorenulls=True).over(rows))
    # All three only grow along a bucket: their largest is their last.
    totals = x.groupBy("__key", "__b").agg(F.max("__in").alias("__i"), F.max("__out").alias("__o"), F.max("__at").alias("__r"))
    earlier = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns({f"__c{c}": F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)) for c in "io"})
    carry = carry.withColumn("__cr", F.coalesce(F.max(F.col("__ci") + F.col("__r")).over(earlier), F.lit(0)))
    carry = carry.select(F.col("__key").alias("__ck"), F.col("__b").alias("__cb"), "__ci", "__co", "__cr")
    x = x.filter((F.col("__step") == 1) & exit_)
    x = x.join(carry, F.col("__key").eqNullSafe(F.col("__ck")) & (F.col("__b") == F.col("__cb")))
    reset = F.coalesce(F.col("__ci") + F.col("__at"), F.col("__cr"))
    n = (F.col("__ci") + F.col("__in") - F.greatest(reset, F.col("__co") + F.col("__out"))).cast("bigint")
    return x.select("__key", F.timestamp_micros("__t").cast(kind).alias("__ts"), "__seq", n.alias("__n"))


def respawn_delay(
    crash_rows: DataFrame,
    base_s: float = C.RESPAWN_BASE_DELAY_S,
    cap_s: float = C.RESPAWN_MAX_DELAY_S,
) -> DataFrame:
    """``delay_s`` = min(base * 2^(n-1), cap) in whole seconds; null when the guard gave up."""
    d = F.least(F.lit(base_s) * F.pow(F.lit(2.0), F.col("exits_in_window") - 1), F.lit(cap_s))
    return crash_rows.withColumn(
        "delay_s", F.when(F.col("verdict") == "respawn", d.cast("bigint")).otherwise(F.lit(None).cast("bigint"))
    )


def lifecycle_crash_loop(
    events: DataFrame,
    key: str = "deployment_id",
    window_s: float = C.CRASH_WINDOW_S,
    max_exits: int = C.CRASH_MAX_EXITS,
    bucket_s: int = DEFAULT_BUCKET_S,
) -> DataFrame:
    """O20+O21 on the lifecycle vocabulary.

    An ``exit`` counts unless a deliberate ``stop`` is in flight (the latest
    of stop / start / restart / respawn / running up to it is a stop).
    A ``start`` resets the budget only if the process was not live just
    before it (the latest of start / running / respawn / restart versus
    stop / stopped / exit / start_failed / crashed / unready); ``restart``
    always resets; ``respawn`` never does.  Both lookups are skew-safe
    ordered scans, the liveness one exclusive of the current row.
    """
    ev = events.withColumn("__t", micros("ts"))
    ev = ordered_scan(ev, [key], "__t", ["__t", "seq"], _crash_specs(), bucket_s)
    return _crash_from_scanned(ev, events, key, window_s, max_exits, bucket_s)


def _crash_specs() -> list[ScanSpec]:
    """Running control (last stop/go, inclusive) and liveness (exclusive)."""
    control = F.when(F.col("event") == "stop", F.lit("stop")).when(
        F.col("event").isin("start", "restart", "respawn", "running"), F.lit("go")
    )
    return [ScanSpec("__ctl", "last", control), ScanSpec("__live_before", "last", _after(LIVE_AFTER), exclusive=True)]


def _crash_from_scanned(ev: DataFrame, unscanned: DataFrame, key: str, window_s: float, max_exits: int, bucket_s: int) -> DataFrame:
    is_exit = (F.col("event") == "exit") & ~F.coalesce(F.col("__ctl") == "stop", F.lit(False))
    is_reset = (F.col("event") == "restart") | (
        (F.col("event") == "start") & ~F.coalesce(F.col("__live_before"), F.lit(False))
    )
    to_count = unscanned.filter(F.col("event").isin("exit", "restart", "start"))
    res = crash_loop(ev, is_exit, is_reset, key=key, window_s=window_s, max_exits=max_exits, bucket_s=bucket_s, to_count=to_count)
    return respawn_delay(res.drop("__ctl", "__live_before"))


# ---------------------------------------------------------------------------
# O22 lifecycle_state, O23 restart_counts
# ---------------------------------------------------------------------------

# Vocabulary of the respawn rules: what an event makes of liveness, of the last
# deliberate control and of the configuration's readiness.
LIVE_AFTER = {
    "start": True, "running": True, "respawn": True, "restart": True,
    "stop": False, "stopped": False, "exit": False, "start_failed": False, "crashed": False, "unready": False,
}
CONTROL_AFTER = {
    "stop": "stop", "stopping": "stop",
    "start": "go", "restart": "go", "respawn": "go", "running": "go", "starting": "go",
}
READY_AFTER = {"config_ready": True, "config_unready": False}
# A stop is in flight until something is spawned again: exits up to then belong to it.
STOP_IN_FLIGHT_AFTER = {
    "stop": True, "stopping": True, "stopped": True,
    "start": False, "restart": False, "respawn": False, "running": False, "starting": False,
}
# Events that spawn a child; those that end one are the rest of LIVE_AFTER.
SPAWNING = tuple(e for e, live in LIVE_AFTER.items() if live)
STATE_EVENTS = (*LIVE_AFTER, "starting", "stopping")
# The state after each event; a start of a live process and an exit during a stop change nothing.
STATE_AFTER = {
    "start": "running", "restart": "running", "respawn": "running", "running": "running",
    "starting": "starting", "stopping": "stopping",
    "stop": "stopped", "stopped": "stopped", "unready": "stopped",
    "exit": "error", "start_failed": "error", "crashed": "crashed",
}


def _after(table: dict[str, object]) -> Column:
    out = F.lit(None)
    for event, value in table.items():
        out = F.when(F.col("event") == event, F.lit(value)).otherwise(out)
    return out


def respawn_checks(
    events: DataFrame,
    key: str = "deployment_id",
    window_s: float = C.CRASH_WINDOW_S,
    max_exits: int = C.CRASH_MAX_EXITS,
    bucket_s: int = DEFAULT_BUCKET_S,
) -> DataFrame:
    """What becomes of each respawn when its delay ends: (key, ts, seq of the exit,
    due, outcome).

    ``cancelled`` if the last control up to then is a stop, else
    ``already_running`` if the process is live, else ``unready`` if the
    configuration is incomplete, else ``respawn_due``.  The checks join the
    events as rows of their due time (after events of the same moment) and one
    ordered scan carries the three last values to them.
    """
    plain = events.select(key, F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "event")
    exits = lifecycle_crash_loop(plain, key, window_s, max_exits, bucket_s).filter(F.col("verdict") == "respawn")
    due = F.timestamp_micros(micros("ts") + F.col("delay_s") * F.lit(1_000_000))
    none = F.lit(None)
    checks = exits.select(key, due.alias("ts"), F.lit(2**63 - 1).alias("seq"), none.cast("string").alias("event"), F.col("ts").alias("__xt"), F.col("seq").alias("__xs"))
    rows = plain.withColumns({"__xt": none.cast("timestamp"), "__xs": none.cast("bigint")}).unionByName(checks).withColumn("__t", micros("ts"))
    specs = [
        ScanSpec("__live", "last", _after(LIVE_AFTER)),
        ScanSpec("__ctl", "last", _after(CONTROL_AFTER)),
        ScanSpec("__ready", "last", _after(READY_AFTER)),
    ]
    rows = ordered_scan(rows, [key], "__t", ["__t", "seq"], specs, bucket_s).filter(F.col("__xs").isNotNull())
    outcome = (
        F.when(F.coalesce(F.col("__ctl") == "stop", F.lit(False)), "cancelled")
        .when(F.coalesce(F.col("__live"), F.lit(False)), "already_running")
        .when(~F.coalesce(F.col("__ready"), F.lit(True)), "unready")
        .otherwise("respawn_due")
    )
    return rows.select(key, F.col("__xt").alias("ts"), F.col("__xs").alias("seq"), F.col("ts").alias("due"), outcome.alias("outcome"))


def _state_specs() -> list[ScanSpec]:
    """Liveness and a stop in flight, just before each event."""
    return [
        ScanSpec("__alive", "last", _after(LIVE_AFTER), exclusive=True),
        ScanSpec("__stop", "last", _after(STOP_IN_FLIGHT_AFTER), exclusive=True),
    ]


def _state_from_scanned(
    ev: DataFrame, as_of_c: Column, key: str, spawned: Column, deployments: DataFrame | None
) -> DataFrame:
    """One row per key from scanned events up to ``as_of``; ``spawned`` tells a spawning
    event that is known to have succeeded (true) or failed (false) from one that is not known."""
    e = F.col("event")
    alive, stopping = (F.coalesce(F.col(c), F.lit(False)) for c in ("__alive", "__stop"))
    failed, sure = F.coalesce(~spawned, F.lit(False)), F.coalesce(spawned, F.lit(False))
    after = (
        F.when(e.isin(*SPAWNING) & failed, "starting")
        .when((e == "start") & alive & ~sure, None)
        .when((e == "exit") & stopping, None)
        .otherwise(_after(STATE_AFTER))
    )
    begins = ~failed & (sure | (e == "restart") | (e.isin(*SPAWNING) & ~alive))
    order = F.struct("__t", "seq")
    res = ev.groupBy(key).agg(
        F.max_by(after, F.when(after.isNotNull(), order)).alias("state"),
        F.max(F.when(begins, F.struct("__t", "seq", "__pid"))).alias("__run"),
        F.count_if(e.isin("restart", "respawn")).cast("bigint").alias("restarts"),
    )
    running = F.col("state") == "running"
    uptime = F.floor((F.unix_micros(as_of_c) - F.col("__run.__t")) / F.lit(1_000_000)).cast("bigint")
    out = res.select(
        F.col(key),
        F.coalesce("state", F.lit("stopped")).alias("state"),
        F.when(running, F.col("__run.__pid")).cast("bigint").alias("pid"),
        F.when(running, uptime).alias("uptime_s"),
        "restarts",
    )
    if deployments is not None:
        out = deployments.select(key).distinct().join(out, on=key, how="left").select(
            key,
            F.coalesce("state", F.lit("stopped")).alias("state"),
            "pid",
            "uptime_s",
            F.coalesce("restarts", F.lit(0).cast("bigint")).alias("restarts"),
        )
    return out


def _pid_of(events: DataFrame) -> Column:
    return (F.col("pid") if "pid" in events.columns else F.lit(None)).cast("bigint").alias("__pid")


def lifecycle_state(
    events: DataFrame,
    as_of: str | Column,
    key: str = "deployment_id",
    deployments: DataFrame | None = None,
    bucket_s: int = DEFAULT_BUCKET_S,
) -> DataFrame:
    """State per key at ``as_of``: state, pid, uptime_s, restarts.

    One skew-safe ordered scan gives every event the liveness and the stop in
    flight just before it; one aggregation, partial map-side, does the rest:

    * the last event that changes the state gives it: ``running`` from a spawning
      event, ``stopped`` from a stop (``starting`` and ``stopping`` only from events
      of that name, or from a spawn known to fail later); a start of a live process
      and the exit of a stopped one change nothing;
    * a run begins where a spawning event finds the process dead, at a ``restart``,
      or at a spawn that is known (column ``spawned``, see
      :func:`lifecycle_from_log_events`); ``pid`` (if the input has one) is the pid
      of the last such event, ``uptime_s`` the whole seconds from it to ``as_of``,
      both shown only while running;
    * ``restarts`` counts restart + respawn events.
    """
    as_of_c = as_timestamp(as_of)
    # Typed log events also carry respawn schedules, cancellations, lock clean-ups, proxy errors ...
    ev = events.filter((F.col("ts").cast("timestamp") <= as_of_c) & F.col("event").isin(*STATE_EVENTS))
    spawned = F.col("spawned") if "spawned" in events.columns else F.lit(None).cast("boolean")
    ev = ev.select(key, "ts", "seq", "event", _pid_of(events), spawned.alias("__spawned"))
    ev = ordered_scan(ev.withColumn("__t", micros("ts")), [key], "__t", ["__t", "seq"], _state_specs(), bucket_s)
    return _state_from_scanned(ev, as_of_c, key, F.col("__spawned"), deployments)


def lifecycle_from_log_events(typed: DataFrame, key: str = "deployment_id", bucket_s: int = DEFAULT_BUCKET_S) -> DataFrame:
    """O6 output -> lifecycle vocabulary for O20-O23.

    The supervisor writes the same start line for every spawn; a start that
    follows ``restarting in Ns`` (with no start, exit or cancellation in
    between) by at least those N seconds is a supervised ``respawn``, which
    keeps the crash budget.  An earlier start was made by hand.
    Schedules and cancellations themselves change no state and are dropped;
    the other typed events keep their names (start, start_failed, exit,
    crashed, unready).

    The line is written only once no child lives, before the spawn; neither a
    stop nor the spawn's success has a line.  ``spawned`` (of start and respawn,
    else null) tells by looking ahead: false where the next event is the failure.
    :func:`lifecycle_state` takes a spawned start as a new run even where the
    stop before it left no line, and a failing one as ``starting``.  Both looks,
    back and ahead, are columns of one ordered scan.
    """
    ev = typed.filter(F.col("event").isin(*_ADAPTER_EVENTS)).withColumn("__t", micros("ts"))
    ev = ordered_scan(ev, [key], "__t", ["__t", "seq"], [_respawn_marker_spec(), _spawn_spec()], bucket_s)
    return _apply_respawn(_with_spawned(ev)).drop("__t")


_ADAPTER_EVENTS = ("start", "start_failed", "exit", "crashed", "unready", "respawn_scheduled", "respawn_cancelled")


def _respawn_marker_spec() -> ScanSpec:
    """When the last scheduled respawn is due (-1 where it no longer is), strictly before each row."""
    due = F.col("__t") + F.coalesce(F.col("delay_s"), F.lit(0)).cast("bigint") * F.lit(1_000_000)
    marker = F.when(F.col("event") == "respawn_scheduled", due).when(
        F.col("event").isin("start", "exit", "respawn_cancelled", "unready"), F.lit(-1).cast("bigint")
    )
    return ScanSpec("__prev", "last", marker, exclusive=True)


def _spawn_spec() -> ScanSpec:
    """The event after each row."""
    return ScanSpec("__ahead", "next", F.col("event"), exclusive=True)


def _with_spawned(ev: DataFrame) -> DataFrame:
    fails = F.coalesce(F.col("__ahead") == "start_failed", F.lit(False))
    return ev.withColumn("spawned", F.when(F.col("event") == "start", ~fails)).drop("__ahead")


def _apply_respawn(ev: DataFrame) -> DataFrame:
    on_time = (F.col("__prev") >= 0) & (F.col("__t") >= F.col("__prev"))
    event = F.when((F.col("event") == "start") & on_time, F.lit("respawn")).otherwise(F.col("event"))
    return ev.filter(~F.col("event").isin("respawn_scheduled", "respawn_cancelled")).withColumn("event", event).drop("__prev")


def lifecycle_state_from_log_events(
    typed: DataFrame,
    as_of: str | Column,
    key: str = "deployment_id",
    deployments: DataFrame | None = None,
    bucket_s: int = DEFAULT_BUCKET_S,
) -> DataFrame:
    """:func:`lifecycle_from_log_events` then :func:`lifecycle_state`, in one ordered
    scan instead of two stacked ones: the adapter's two markers and the state's two
    are scanned together over the typed events.  Lines later than ``as_of`` serve the
    look ahead and nothing else."""
    as_of_c = as_timestamp(as_of)
    ev = typed.filter(F.col("event").isin(*_ADAPTER_EVENTS))
    ev = ev.select(key, "ts", "seq", "event", "delay_s", _pid_of(typed)).withColumn("__t", micros("ts"))
    specs = [_respawn_marker_spec(), _spawn_spec(), *_state_specs()]
    ev = ordered_scan(ev, [key], "__t", ["__t", "seq"], specs, bucket_s)
    ev = _apply_respawn(_with_spawned(ev.filter(F.col("ts").cast("timestamp") <= as_of_c)))
    return _state_from_scanned(ev, as_of_c, key, F.col("spawned"), deployments)


def crash_loop_from_log_events(
    typed: DataFrame,
    key: str = "deployment_id",
    window_s: float = C.CRASH_WINDOW_S,
    max_exits: int = C.CRASH_MAX_EXITS,
    bucket_s: int = DEFAULT_BUCKET_S,
) -> DataFrame:
    """:func:`lifecycle_from_log_events` then :func:`lifecycle_crash_loop`, in
    one ordered scan instead of two stacked ones.

    The crash loop's control and liveness markers are the same for ``start``
    and ``respawn`` (both "go", both live), and the schedule / cancellation
    rows the adapter drops carry neither marker.  So the adapter's marker and
    the crash loop's two are scanned together over the typed events, which
    are parsed from text and so are computed twice here instead of four times.
    """
    ev = typed.filter(F.col("event").isin(*_ADAPTER_EVENTS)).withColumn("__t", micros("ts"))
    ev = ordered_scan(ev, [key], "__t", ["__t", "seq"], [_respawn_marker_spec(), *_crash_specs()], bucket_s)
    return _crash_from_scanned(_apply_respawn(ev), typed, key, window_s, max_exits, bucket_s)


def restart_counts(events: DataFrame, key: str = "deployment_id") -> DataFrame:
    """Restart and supervised respawn add one; a plain start does not."""
    return events.groupBy(key).agg(
        F.count_if(F.col("event").isin("restart", "respawn")).cast("bigint").alias("restarts")
    )


# ---------------------------------------------------------------------------
# O24 stale_locks
# ---------------------------------------------------------------------------


def stale_locks(locks: DataFrame, exits: DataFrame, keys: Sequence[str] = ("deployment_id", "pid")) -> DataFrame:
    """Flag each lock whose pid is one that died (``stale``); live locks stay.

    Exits are reduced to distinct (key, pid) first (map-side), then a left
    outer join on (key, pid): both sides hash-partition on a near-unique pid,
    so no key is hot.
    """
    keys = list(keys)
    dead = exits.select(*keys).dropDuplicates().withColumn("__dead", F.lit(True))
    return locks.join(dead, on=keys, how="left").withColumn(
        "stale", F.coalesce(F.col("__dead"), F.lit(False))
    ).drop("__dead")


def cleared_locks(locks: DataFrame, exits: DataFrame, keys: Sequence[str] = ("deployment_id", "pid")) -> DataFrame:
    """Locks that remain after clearing: ``left_anti`` against the dead pids."""
    return locks.join(exits.select(*keys), on=list(keys), how="left_anti")


# ---------------------------------------------------------------------------
# O26 device_flow_outcome
# ---------------------------------------------------------------------------


def device_flow_outcome(
    flows: DataFrame,
    polls: DataFrame,
    as_of: str | Column,
    bucket_s: int = DEFAULT_BUCKET_S,
) -> DataFrame:
    """Outcome of each device-code flow at ``as_of``.

    flows(flow_id, started_at, expires_at, interval_s); polls(flow_id, ts,
    seq, http_status, body_ok, error, error_description).

    * a flow without an expiry lives ``DEVICE_FLOW_LIFE_S`` from its start;
    * interval starts at max(given, 5); after k >= 1 slow-downs it is
      min(init + 5k, 30);
    * a poll happens only if the loop check before its sleep was before
      expiry: ``ts - interval_in_effect < expires_at``;
    * terminal polls: 200 with a readable body (authorized), 200 with an
      unreadable body, or any other status whose error is neither
      ``authorization_pending`` nor ``slow_down``; a null status (transport
      error) and pending replies are not terminal;
    * the first terminal poll wins; with none, ``expired`` once
      ``as_of >= expires_at``, else ``pending``.
    """
    as_of_c = as_timestamp(as_of)
    fl = flows.select(
        "flow_id",
        F.coalesce(
            F.col("expires_at").cast("timestamp"),
            F.timestamp_micros(micros("started_at") + F.lit(C.DEVICE_FLOW_LIFE_S * 1_000_000)),
        ).alias("expires_at"),
        F.greatest(F.coalesce(F.col("interval_s"), F.lit(C.DEVICE_FLOW_MIN_INTERVAL_S)), F.lit(C.DEVICE_FLOW_MIN_INTERVAL_S)).alias("__init"),
    )
    is_slow = (F.col("http_status").isNotNull()) & (F.col("http_status") != 200) & (F.coalesce(F.col("error"), F.lit("")) == "slow_down")
    p = polls.filter(F.col("ts").cast("timestamp") <= as_of_c).withColumn("__t", micros("ts"))
    p = p.withColumn("__slow", F.when(is_slow, 1).otherwise(0))
    p = ordered_scan(p, ["flow_id"], "__t", ["__t", "seq"], [ScanSpec("__slow_incl", "sum", F.col("__slow"))], bucket_s)
    p = p.join(fl, on="flow_id", how="inner")

    def interval_after(k: Column) -> Column:
        return F.when(k <= 0, F.col("__init")).otherwise(
            F.least(F.col("__init") + F.lit(C.DEVICE_FLOW_SLOWDOWN_STEP_S) * k, F.lit(C.DEVICE_FLOW_MAX_INTERVAL_S))
        )

    slow_before = F.col("__slow_incl") - F.col("__slow")
    p = p.withColumn("__int_before", interval_after(slow_before)).withColumn(
        "__int_after", interval_after(F.col("__slow_incl"))
    )
    allowed = (F.col("__t") - F.col("__int_before").cast("bigint") * F.lit(1_000_000)) < micros("expires_at")
    err = F.coalesce(F.col("error"), F.lit(""))
    terminal = F.col("http_status").isNotNull() & (
        (F.col("http_status") == 200) | ~err.isin("authorization_pending", "slow_down")
    )
    status = F.when(
        F.col("http_status") == 200,
        F.when(F.coalesce(F.col("body_ok"), F.lit(False)), F.lit("authorized")).otherwise(F.lit("error")),
    ).otherwise(F.lit("error"))
    err_text = F.when(
        F.col("http_status") == 200,
        F.when(F.coalesce(F.col("body_ok"), F.lit(False)), F.lit(None).cast("string")).otherwise(
            F.lit(C.DEVICE_FLOW_BAD_BODY_ERROR)
        ),
    ).otherwise(
        F.coalesce(
            F.nullif(F.col("error_description"), F.lit("")),
            F.nullif(F.col("error"), F.lit("")),
            F.lit(C.DEVICE_FLOW_TERMINAL_ERROR),
        )
    )
    p = p.filter(allowed)
    order = F.struct("__t", "seq")
    term_val = F.struct(status.alias("status"), err_text.alias("error"), F.col("__int_before").alias("interval_s"))
    # One aggregation: the first terminal poll and the interval after the last poll.
    agg = p.groupBy("flow_id").agg(
        F.min_by(F.when(terminal, term_val), F.when(terminal, order)).alias("__term"),
        F.max_by("__int_after", order).alias("__last_int"),
    )
    out = fl.join(agg, on="flow_id", how="left").select(
        "flow_id",
        F.coalesce(
            F.col("__term.status"),
            F.when(as_of_c >= F.col("expires_at").cast("timestamp"), F.lit("expired")).otherwise(F.lit("pending")),
        ).alias("status"),
        F.col("__term.error").alias("error"),
        F.coalesce(F.col("__term.interval_s"), F.col("__last_int"), F.col("__init")).cast("bigint").alias("interval_s"),
    )
    return out
