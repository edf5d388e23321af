"""Stand-in bindings: each operator run over the driver's tables.

The driver's tables hold no gateway data, so every operator is bound to a
tables; nothing is sampled, capped or filtered by id.  Parameters (windows,
as-of times, TTLs) are arguments with the defaults used by the oracle SQL in
:mod:`gatewarden.plans.oracle`.

Output conventions for the oracle compare: times are BIGINT epoch
microseconds (``*_us``), counts BIGINT, every computed column aliased.
Integer columns that can be null are rendered as strings in both engines
(Spark hands nullable integers to pandas as floats, DuckDB as nullable
integers; strings compare the same either way).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators.scans import ScanSpec, micros, ordered_scan
from .tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


# Shared stand-in parameters (the oracle SQL spells the same values).
AS_OF = "2024-01-31 00:00:00"
CRASH_WINDOW_H = 240
CRASH_MAX = 5
TAIL_N = 50


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lifecycle events: click=start, error=exit, purchase=stop, signup=restart.

    ``pid`` is the event id of the event that spawns a process.
    """
    ev = _events(spark, sf_dir)
    event = (
        F.when(F.col("event_type") == "click", "start")
        .when(F.col("event_type") == "error", "exit")
        .when(F.col("event_type") == "purchase", "stop")
        .when(F.col("event_type") == "signup", "restart")
    )
    return ev.select(
        F.col("user_id").alias("deployment_id"),
        "ts",
        F.col("event_id").alias("seq"),
        event.alias("event"),
        F.col("event_id").alias("pid"),
    ).filter(F.col("event").isNotNull())


# ---------------------------------------------------------------------------
# Lifecycle
# ---------------------------------------------------------------------------


@query("crash_loop")
def crash_loop_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (O20+O21): dep = user, exit = error, budget reset = signup, 240 h, max 5."""
    ev = _events(spark, sf_dir).select(
        F.col("user_id").alias("deployment_id"), "ts", F.col("event_id").alias("seq"), "event_type"
    )
    res = L.crash_loop(
        ev,
        is_exit=F.col("event_type") == "error",
        is_reset=F.col("event_type") == "signup",
        window_s=CRASH_WINDOW_H * 3600,
        max_exits=CRASH_MAX,
    )
    res = L.respawn_delay(res)
    return res.select(
        "deployment_id", "seq", micros("ts").alias("ts_us"), "exits_in_window", "verdict", F.col("delay_s").cast("string").alias("delay_s")
    )


@query("lifecycle_crash_loop")
def lifecycle_crash_loop_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O20+O21 on the lifecycle vocabulary (click=start, error=exit, purchase=stop,
    signup=restart): exits during a stop are ignored, a start on a live process
    keeps the budget; 240 h, max 5."""
    res = L.lifecycle_crash_loop(lifecycle_events(spark, sf_dir), window_s=CRASH_WINDOW_H * 3600, max_exits=CRASH_MAX)
    return res.select(
        "deployment_id", "seq", micros("ts").alias("ts_us"), "exits_in_window", "verdict", F.col("delay_s").cast("string").alias("delay_s")
    )


def squeezed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle stand-in with views as readiness events (unready below 10): the
    delays are stretched to hours so that events fall into them."""
    ev = lifecycle_events(spark, sf_dir).select("deployment_id", "ts", "seq", "event")
    views = _events(spark, sf_dir).filter("event_type = 'view'").select(
        F.col("user_id").alias("deployment_id"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("value") < 10, "config_unready").otherwise("config_ready").alias("event"),
    )
    # An hour of events counts as a second: epoch 2024 stays the origin.
    squeezed = F.timestamp_micros(F.floor(micros("ts") / 3600).cast("bigint"))
    return ev.unionByName(views).withColumn("ts", squeezed)


@query("respawn_checks")
def respawn_checks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2's respawn checks in batch, on the squeezed lifecycle stand-in."""
    res = L.respawn_checks(squeezed_events(spark, sf_dir), window_s=CRASH_WINDOW_H, max_exits=CRASH_MAX)
    return res.select("deployment_id", "seq", micros("due").alias("due_us"), "outcome")


@query("tail_per_source")
def tail_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 50 events per user as the log ring buffer."""
    ev = _events(spark, sf_dir).select(
        F.col("user_id").alias("deployment_id"), F.lit("gateway").alias("source"), "ts", F.col("event_id").alias("seq")
    )
    res = L.tail_per_source(ev, n=TAIL_N)
    return res.select("deployment_id", "seq", micros("ts").alias("ts_us"), F.col("newest_rank").cast("bigint"))


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the whole vocabulary: click = start (start_failed above 45), error = exit
    (crashed above 40), purchase = stop, signup = restart, view = running below 5, starting
    below 10, stopping below 40, else stopped."""
    et, v = F.col("event_type"), F.col("value")
    event = (
        F.when(et == "click", F.when(v > 45, "start_failed").otherwise("start"))
        .when(et == "error", F.when(v > 40, "crashed").otherwise("exit"))
        .when(et == "purchase", "stop")
        .when(et == "signup", "restart")
        .otherwise(F.when(v < 5, "running").when(v < 10, "starting").when(v < 40, "stopping").otherwise("stopped"))
    )
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("deployment_id"), "ts", F.col("event_id").alias("seq"), event.alias("event"), F.col("event_id").alias("pid")
    )


@query("lifecycle_state")
def lifecycle_state_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O22 at 2024-01-31, over the events up to then as seen by each hour of the day
    as a deployment of its own (so that all six states occur)."""
    ev = state_events(spark, sf_dir).withColumn("deployment_id", F.col("deployment_id") * 24 + F.hour("ts"))
    res = L.lifecycle_state(ev, AS_OF)
    return res.select(
        "deployment_id", "state", F.col("pid").cast("string").alias("pid"), F.col("uptime_s").cast("string").alias("uptime_s"), "restarts"
    )


@query("lifecycle_state_from_logs")
def lifecycle_state_from_logs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 -> O6 -> lifecycle adapter -> O22 on the rendered log lines, with some proxy
    lines as failed spawns: of each hour of the day as a deployment of its own."""
    from ..sources.logs import clean_log_lines, extract_lifecycle_events
    from . import standins as X

    typed = extract_lifecycle_events(clean_log_lines(X.event_log_raw(spark, sf_dir)))
    failed = (F.col("event") == "upstream_status") & (F.col("status") == 404)
    typed = typed.withColumn("event", F.when(failed, F.lit("start_failed")).otherwise(F.col("event")))
    typed = typed.withColumn("deployment_id", F.col("deployment_id") * 24 + F.hour("ts"))
    # The log tells no pid of a live child; the sequence number of the line stands for it.
    res = L.lifecycle_state_from_log_events(typed.withColumn("pid", F.col("seq")), AS_OF)
    return res.select(
        "deployment_id", "state", F.col("pid").cast("string").alias("pid"), F.col("uptime_s").cast("string").alias("uptime_s"), "restarts"
    )


@query("restart_counts")
def restart_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O23 over the lifecycle stand-in (signup = restart)."""
    return L.restart_counts(lifecycle_events(spark, sf_dir))


@query("stale_locks")
def stale_locks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every start writes a lock (pid = its event id); an exit kills the
    pid of the latest start before it; locks of dead pids are stale."""
    # A start's pid died iff the next start/exit event after it is an exit:
    # one reverse-order scan (next event = last event scanning backwards).
    ev = lifecycle_events(spark, sf_dir).filter(F.col("event").isin("start", "exit"))
    ev = ev.withColumn("__rt", -micros("ts")).withColumn("__rseq", -F.col("seq"))
    ev = ordered_scan(
        ev, ["deployment_id"], "__rt", ["__rt", "__rseq"],
        [ScanSpec("next_event", "last", F.col("event"), exclusive=True)],
    )
    starts = ev.filter(F.col("event") == "start")
    locks = starts.select("deployment_id", "pid")
    dead = starts.filter(F.col("next_event") == "exit").select("deployment_id", "pid")
    return L.stale_locks(locks, dead).select("deployment_id", "pid", "stale")


@query("cleared_locks")
def cleared_locks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O24, remainder form: the locks left after clearing the dead pids."""
    ev = lifecycle_events(spark, sf_dir).filter(F.col("event").isin("start", "exit"))
    ev = ev.withColumn("__rt", -micros("ts")).withColumn("__rseq", -F.col("seq"))
    ev = ordered_scan(
        ev, ["deployment_id"], "__rt", ["__rt", "__rseq"],
        [ScanSpec("next_event", "last", F.col("event"), exclusive=True)],
    )
    starts = ev.filter(F.col("event") == "start")
    dead = starts.filter(F.col("next_event") == "exit").select("deployment_id", "pid")
    return L.cleared_locks(starts.select("deployment_id", "pid"), dead)


@query("crash_loop_from_logs")
def crash_loop_from_logs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 -> O6 -> lifecycle adapter -> O20/O21 on the rendered log lines:
    a start line after "restarting in" is a supervised respawn (no reset)."""
    from ..sources.logs import clean_log_lines, extract_lifecycle_events
    from . import standins as X

    typed = extract_lifecycle_events(clean_log_lines(X.event_log_raw(spark, sf_dir)))
    res = L.crash_loop_from_log_events(typed, window_s=CRASH_WINDOW_H * 3600, max_exits=CRASH_MAX)
    return res.select(
        "deployment_id", "seq", micros("ts").alias("ts_us"), "exits_in_window", "verdict", F.col("delay_s").cast("string").alias("delay_s")
    )


def device_flows_and_polls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One flow per user, started at its first event, 10 days of life (no
    expiry given for every seventh, which then lives 900 s);
    polls: view = pending, click = slow_down, purchase = 200, error = denied
    (with a description when value > 25)."""
    ev = _events(spark, sf_dir)
    flows = ev.groupBy(F.col("user_id").alias("flow_id")).agg(F.min("ts").alias("started_at"))
    flows = flows.select(
        "flow_id",
        "started_at",
        F.when(F.col("flow_id") % 7 != 0, F.col("started_at").cast("timestamp") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"),
        F.lit(5).alias("interval_s"),
    )
    et = F.col("event_type")
    polls = ev.select(
        F.col("user_id").alias("flow_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(et == "purchase", 200).otherwise(400).alias("http_status"),
        F.lit(True).alias("body_ok"),
        F.when(et == "view", "authorization_pending")
        .when(et == "click", "slow_down")
        .when(et == "error", "access_denied")
        .alias("error"),
        F.when((et == "error") & (F.col("value") > 25), "The user denied the request").alias("error_description"),
    )
    return flows, polls


@query("device_flow_outcome")
def device_flow_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O26 on the flows and polls of all users."""
    res = L.device_flow_outcome(*device_flows_and_polls(spark, sf_dir), AS_OF)
    return res.select(F.col("flow_id").cast("bigint"), "status", "error", "interval_s")


# The remaining domains register themselves on import.
from . import bindings_fleet, bindings_streams  # noqa: E402,F401
