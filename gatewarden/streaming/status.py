"""ST5: latest lifecycle status per deployment, kept by a stream.

A stateful processor, called once for a shard of deployments, folds lifecycle events
into (state, pid, run start, restarts) of each deployment exactly like the batch
:func:`gatewarden.operators.lifecycle.lifecycle_state`, and emits the new
status of every deployment touched by a micro-batch.  An event older than the
last one applied changes no state (its restart still counts).  The sink is a
``foreachBatch`` keyed overwrite: each batch's rows go to their own
``batch_id=`` partition (overwritten on replay, so a retried batch after an
executor loss writes the same rows once); readers take the newest row per
deployment with :func:`read_latest_status`, and :func:`compact_status` replaces
the history by those rows in a new folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import LIVE_AFTER, SPAWNING, STATE_AFTER, STATE_EVENTS, STOP_IN_FLIGHT_AFTER
from .common import HeldRows, PagedStates, micros_col, shard_of

_COLS = ["deployment_id", "event_us", "state", "pid", "run_us", "restarts"]
_SCHEMA = "deployment_id string, event_us long, state string, pid long, run_us long, restarts long"
#: state, time and seq of the last event applied, live, stop in flight, run start, run pid, restarts
_NEW = (None, None, None, False, False, None, None, 0)


def _next_state(event: str, live: bool, stop_in_flight: bool) -> str | None:
    """State that an event leads to, None where it changes nothing."""
    if (event == "start" and live) or (event == "exit" and stop_in_flight):
        return None
    return STATE_AFTER[event]


class StatusProcessor(StatefulProcessor):
    def __init__(self, bucket_s: float = 3600):
        self.bucket_s = bucket_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = HeldRows(handle, "held", self.bucket_s)
        self.states = PagedStates(handle, "status")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.states.load()
        now: dict[str | None, list] = {}

        def new() -> Iterator[tuple]:
            for frame in rows:
                pids = frame["pid"] if "pid" in frame.columns else [None] * len(frame)
                for dep, us, seq, event, pid in zip(frame["deployment_id"], frame["us"], frame["seq"], frame["event"], pids):
                    if dep not in now:
                        now[dep] = list(self.states.get(dep) or _NEW)
                    # Schedules, cancellations, lock clean-ups change no state.
                    if event in STATE_EVENTS:
                        yield int(us), int(seq), dep, event, None if pd.isna(pid) else int(pid)

        for ripe in self.held.in_order(new()):
            for us, seq, dep, e, pid in ripe:
                st = now[dep]
                state, last_us, last_seq, live, stopping, run_us, run_pid, restarts = st
                restarts += e in ("restart", "respawn")
                if last_us is not None and (us, seq) < (last_us, last_seq):
                    st[7] = restarts
                    continue
                if e == "restart" or (e in SPAWNING and not live):
                    run_us, run_pid = us, pid
                state = _next_state(e, live, stopping) or state
                st[:] = state, us, seq, LIVE_AFTER.get(e, live), STOP_IN_FLIGHT_AFTER.get(e, stopping), run_us, run_pid, restarts
        out: list[tuple] = []
        for dep, st in now.items():
            state, last_us, _, _, _, run_us, run_pid, restarts = st
            if last_us is None:
                continue
            self.states.put(dep, st)
            shown = state == "running"
            out.append((dep, last_us, state or "stopped", run_pid if shown else None, run_us if shown else None, restarts))
        self.states.save()
        if out:
            # Objects: whole numbers stay whole beside nulls.
            yield pd.DataFrame(out, columns=_COLS, dtype=object)

    def close(self) -> None:
        pass


def status_stream(events: DataFrame) -> DataFrame:
    """lifecycle events (deployment_id, ts, seq, event[, pid]) -> one status row per touched deployment and batch."""
    cols = ["seq", "event"] + (["pid"] if "pid" in events.columns else [])
    out = (
        events.select(shard_of("deployment_id").alias("shard"), "deployment_id", micros_col("ts").alias("us"), *cols)
        .groupBy("shard")
        .transformWithStateInPandas(statefulProcessor=StatusProcessor(), outputStructType=_SCHEMA, outputMode="Append", timeMode="None")
    )
    return out.select(
        "deployment_id", F.timestamp_micros("event_us").alias("event_ts"), "state", "pid", F.timestamp_micros("run_us").alias("run_started_at"), "restarts"
    )


def start_status_sink(status: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """foreachBatch keyed overwrite: batch rows land in ``batch_id=<id>`` (idempotent on replay)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    w = status.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def read_latest_status(spark: SparkSession, path: str) -> DataFrame:
    """The newest status row per deployment (event time, then batch)."""
    s = spark.read.parquet(path)
    latest = s.groupBy("deployment_id").agg(
        F.max_by(F.struct("state", "pid", "run_started_at", "restarts", "event_ts"), F.struct("event_ts", "batch_id")).alias("l")
    )
    return latest.select("deployment_id", "l.*")


def compact_status(spark: SparkSession, path: str, into: str) -> None:
    """Write the newest rows of ``path`` to the new folder ``into``, as one batch that
    later batches follow; readers and the sink move there, the old folder can go."""
    last = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    read_latest_status(spark, path).withColumn("batch_id", F.lit(last).cast("long")).write.partitionBy("batch_id").parquet(into)
