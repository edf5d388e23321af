"""ST4: device-code flows as a stream, with an event-time timer at expiry.

Keyed by flow id.  A ``flow`` row starts the flow (its expiry, initial
interval); ``poll`` rows are replies.  Rows wait until the watermark passes them
and apply in event order.  The first terminal reply emits the outcome (authorized
/ error); with none, ``expired`` comes once the watermark has passed ``expires_at``
and the one interval in which the reply to a last poll may still come.  Interval rules as in the batch
job: max(given, 5) at start, +5 per slow-down capped at 30; a reply counts
only if the loop check before its sleep was before expiry; a flow without an
expiry lives ``DEVICE_FLOW_LIFE_S``.

The two sources progress on their own, so replies that come before their flow
row wait in state for it.  A flow's state goes one default life after its end;
replies whose flow row has not come within a flow's life end as ``no_flow`` rows.
Rows later than ``lateness`` never reach the stream; :func:`missed_outcomes`
recomputes a closed range and returns what the stream lacks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C
from ..operators.lifecycle import device_flow_outcome
from .common import HeldRows, is_batch, micros_of, timestamp_of

OUTPUT_SCHEMA = "flow_id string, ts timestamp, status string, error string, interval_s long"
_COLS = ["flow_id", "ts", "status", "error", "interval_s"]


LIFE_US = C.DEVICE_FLOW_LIFE_S * 1_000_000


def _plain(x):
    """A cell of a frame as JSON can hold it."""
    return None if x is None or pd.isna(x) else x.item() if hasattr(x, "item") else x


class DeviceFlowProcessor(StatefulProcessor):
    def __init__(self, bucket_s: float = 1):
        self.bucket_s = bucket_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = HeldRows(handle, "held", self.bucket_s)
        self.flow = handle.getValueState("flow", "expires_us long, interval_s long, done boolean")
        # Replies before their flow row, in order.
        self.early = handle.getValueState("early", "rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = (
            (micros_of(r.ts), int(r.seq), r.kind, None if pd.isna(r.expires_at) else micros_of(r.expires_at), _plain(r.interval_s),
             _plain(r.http_status), _plain(r.body_ok), _plain(r.error), _plain(r.error_description))
            for frame in rows
            for r in frame.itertuples(index=False)
        )
        if is_batch(timerValues):
            yield from self._advance(key[0], self.held.in_order(new), None)
        else:
            self.held.add(new)
            self.held.wake(self._deadline())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.fired()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        until = self.held.whole_until(now)
        yield from self._advance(key[0], self.held.drain(until), until)
        self.held.wake(self._deadline())

    def _deadline(self) -> int | None:
        """When the flow is to end, then when its state goes, or when early replies stop waiting."""
        if self.flow.exists():
            expires, interval, done = self.flow.get()
            return expires + interval * 1_000_000 + (LIFE_US if done else 0)
        early = json.loads(self.early.get()[0]) if self.early.exists() else []
        return early[-1][0] + LIFE_US if early else None

    def _advance(self, fid: str, ripe: Iterator[list], until: int | None) -> Iterator[pd.DataFrame]:
        """Apply the ripe rows, then what is due before ``until`` (all where None)."""
        flow = list(self.flow.get()) if self.flow.exists() else None
        early = json.loads(self.early.get()[0]) if self.early.exists() else []
        out: list[tuple] = []

        def reply(t, status, body_ok, error, description) -> None:
            expires, interval, done = flow
            if done or status is None or t - interval * 1_000_000 >= expires:
                return  # over, no reply at all, or the loop had stopped before it
            error, ts = error or "", timestamp_of(t)
            if status == 200:
                out.append((fid, ts, "authorized" if body_ok else "error", None if body_ok else C.DEVICE_FLOW_BAD_BODY_ERROR, interval))
                flow[2] = True
            elif error == "slow_down":
                flow[1] = min(interval + C.DEVICE_FLOW_SLOWDOWN_STEP_S, C.DEVICE_FLOW_MAX_INTERVAL_S)
            elif error != "authorization_pending":
                out.append((fid, ts, "error", description or error or C.DEVICE_FLOW_TERMINAL_ERROR, interval))
                flow[2] = True

        for rows in ripe:
            for t, seq, kind, expires, interval, *answer in rows:
                if kind == "flow":
                    flow = [t + LIFE_US if expires is None else expires, max(interval or 0, C.DEVICE_FLOW_MIN_INTERVAL_S), False]
                    for held in early:
                        reply(*held)
                    early = []
                elif flow is None:
                    early.append([t, *answer])
                else:
                    reply(t, *answer)
        if flow is not None:
            expires, interval, done = flow
            # A reply to a poll that began before the expiry may come an interval later.
            if not done and (until is None or expires + interval * 1_000_000 < until):
                out.append((fid, timestamp_of(expires), "expired", None, interval))
                flow[2] = True
            if until is None or (flow[2] and expires + interval * 1_000_000 + LIFE_US < until):
                flow = None
        if early and (until is None or early[-1][0] + LIFE_US < until):
            out += [(fid, timestamp_of(x[0]), "no_flow", None, None) for x in early]
            early = []
        self._keep(self.flow, tuple(flow) if flow else None)
        self._keep(self.early, (json.dumps(early),) if early else None)
        if out:
            yield pd.DataFrame(out, columns=_COLS)

    @staticmethod
    def _keep(state, value: tuple | None) -> None:
        if value is not None:
            state.update(value)
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def device_flow_stream(flows: DataFrame, polls: DataFrame, lateness: str, bucket_s: float = 1) -> DataFrame:
    """flows(flow_id, started_at, expires_at, interval_s) and polls(flow_id, ts,
    seq, http_status, body_ok, error, error_description) streams -> outcomes.
    Batch frames give every flow's outcome, ``expired`` for those without a reply."""
    f = flows.select(
        "flow_id", F.col("started_at").alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("flow").alias("kind"),
        "expires_at", F.col("interval_s").cast("long").alias("interval_s"),
        F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("boolean").alias("body_ok"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("error_description"),
    )
    p = polls.select(
        "flow_id", "ts", "seq", F.lit("poll").alias("kind"), F.lit(None).cast("timestamp").alias("expires_at"),
        F.lit(None).cast("long").alias("interval_s"), "http_status", "body_ok", "error", "error_description",
    )
    return (
        f.unionByName(p)
        .withWatermark("ts", lateness)
        .groupBy("flow_id")
        .transformWithStateInPandas(
            statefulProcessor=DeviceFlowProcessor(bucket_s), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="EventTime"
        )
    )


def missed_outcomes(flows: DataFrame, polls: DataFrame, as_of, emitted: DataFrame) -> DataFrame:
    """Outcomes of the batch rule at ``as_of`` over a closed range, late rows included,
    that the stream did not emit as they are."""
    settled = device_flow_outcome(flows, polls, as_of).filter(F.col("status") != "pending")
    cols = ["flow_id", "status", "error", "interval_s"]
    return settled.select(*cols).exceptAll(emitted.select(*cols))
