"""Stand-in bindings of the streaming jobs: each job's processor over whole batch
frames of the driver's tables, in event order (``BUCKET_S`` of event time at a time
where a key is too large to sort)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import micros
from ..streaming import crash_alerts, device_flow, integrations, logs, pairing, status
from ..streaming.common import use_rocksdb_state
from . import standins as X
from .bindings import CRASH_MAX, CRASH_WINDOW_H, device_flows_and_polls, query, squeezed_events, state_events
from .tables import table

BUCKET_S = 86400


def _named(df: DataFrame) -> DataFrame:
    """Keys of the streams are strings, times TIMESTAMP."""
    return df.withColumns({"deployment_id": F.col("deployment_id").cast("string"), "ts": F.col("ts").cast("timestamp")})


@query("st1_lifecycle_events")
def st1_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the log stream's rows, on the rendered log lines."""
    out = logs.lifecycle_event_stream(_named(X.event_log_raw(spark, sf_dir)))
    text = [F.col(c).cast("string").alias(c) for c in ("exit_code", "delay_s", "attempt", "status")]
    return out.select(F.col("deployment_id").cast("long").alias("deployment_id"), "seq", "event", *text, "method", "path")


@query("st2_crash_alerts")
def st2_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: exits and settled respawn checks of the stand-in of ``respawn_checks``."""
    use_rocksdb_state(spark)
    events = _named(squeezed_events(spark, sf_dir)).select("deployment_id", "ts", "seq", "event")
    out = crash_alerts.crash_alert_stream(events, "0 seconds", window_s=CRASH_WINDOW_H, max_exits=CRASH_MAX, bucket_s=BUCKET_S)
    shown = F.coalesce("outcome", "verdict")
    return out.select(F.col("deployment_id").cast("long").alias("deployment_id"), "seq", "kind", shown.alias("result"), F.col("exits_in_window").cast("string").alias("exits"))


def pairing_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One code per user: signup = request (without a user id below 20), click = approve,
    error = deny, purchase = an unreadable decision, view = approve without a code."""
    ev = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    user, et = F.col("user_id").cast("string"), F.col("event_type")
    base = [F.lit("d").alias("deployment_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq")]
    requests = ev.filter(et == "signup").select(
        *base, F.lit("telegram").alias("platform"), user.alias("code"),
        F.when(F.col("value") < 20, F.lit(" ")).otherwise(user).alias("user_id"), F.concat(F.lit("n"), F.col("event_id")).alias("user_name"),
    )
    decisions = ev.filter(et != "signup").select(
        *base, F.col("event_id").alias("decision_id"), F.lit("telegram").alias("platform"),
        F.when(et.isin("click", "view"), "approve").when(et == "error", "deny").alias("op"),
        F.when(et == "view", F.lit(" ")).otherwise(F.concat(F.lit(" "), user)).alias("code"),
    )
    return requests, decisions


@query("st3_pairing")
def st3_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: outcomes and approvals of requests and decisions in event order."""
    use_rocksdb_state(spark)
    out = pairing.pairing_stream(*pairing_events(spark, sf_dir), "0 seconds", bucket_s=BUCKET_S)
    return out.select("kind", "decision_id", "code", F.col("status").cast("long").alias("status"), "user_id", "user_name")


@query("st4_device_flow")
def st4_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: the outcome of every flow of the stand-in of ``device_flow_outcome``."""
    use_rocksdb_state(spark)
    flows, polls = device_flows_and_polls(spark, sf_dir)
    flows = flows.withColumns({"flow_id": F.col("flow_id").cast("string"), "started_at": F.col("started_at").cast("timestamp")})
    polls = polls.withColumns({"flow_id": F.col("flow_id").cast("string"), "ts": F.col("ts").cast("timestamp")})
    out = device_flow.device_flow_stream(flows, polls, "0 seconds", bucket_s=BUCKET_S)
    return out.select(F.col("flow_id").cast("long").alias("flow_id"), "status", "error", "interval_s")


@query("st5_status")
def st5_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: latest status of each hour of the day as a deployment, over all events."""
    use_rocksdb_state(spark)
    ev = _named(state_events(spark, sf_dir).withColumn("deployment_id", F.col("deployment_id") * 24 + F.hour("ts")))
    out = status.status_stream(ev)
    return out.select(
        F.col("deployment_id").cast("long").alias("deployment_id"), "state", F.col("pid").cast("string").alias("pid"),
        micros("run_started_at").cast("string").alias("run_us"), "restarts",
    )


@query("st5_integrations")
def st5_integrations_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, O25 half: two snapshots of each customer, the second after some cleared all
    values; every integration's newest flag and how often it was emitted."""
    use_rocksdb_state(spark)
    first = X.customer_settings(spark, sf_dir).select("deployment_id", F.lit("2024-01-01").alias("ts"), "key", "value")
    second = X.emptied_settings(spark, sf_dir).select("deployment_id", F.lit("2024-01-02").alias("ts"), "key", "value")
    changes = integrations.integration_stream(_named(first.unionByName(second)))
    newest = changes.groupBy("deployment_id", "kind", "name").agg(
        F.max_by("configured", "ts").alias("configured"), F.count(F.lit(1)).alias("changes")
    )
    return newest.select(F.col("deployment_id").cast("long").alias("deployment_id"), "kind", "name", "configured", "changes")
