"""ST2: crash-loop guard and respawn backoff as a live stream (O20 + O21 + timers).

Keyed by deployment with ``transformWithStateInPandas``.  Rows wait in an event-time
queue (:class:`gatewarden.streaming.common.HeldRows`) until the watermark passes
their bucket of time and are then applied in event order, so the order of arrival
within ``lateness`` does not matter.  A deployment has one timer, and a timer's work
is in proportion to what is ripe.  Every counted exit
emits a row with ``exits_in_window``, ``verdict`` and ``delay_s``; every respawn
emits a ``respawn_check`` row for the moment its delay ends: ``cancelled`` (a
stop came first), ``already_running``, ``unready`` (configuration incomplete) or
``respawn_due``.  A check is settled before any event later than its moment.

:func:`gatewarden.operators.lifecycle.lifecycle_crash_loop` and
:func:`gatewarden.operators.lifecycle.respawn_checks` give the same rows in
batch.  Rows later than ``lateness`` never reach the stream;
:func:`missed_rows` recomputes a closed range and returns what the stream lacks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C
from ..operators.lifecycle import CONTROL_AFTER, LIVE_AFTER, READY_AFTER, lifecycle_crash_loop, respawn_checks
from .common import HeldRows, RecentTimes, is_batch, micros_of, timestamp_of

EVENTS_SCHEMA = "deployment_id string, ts timestamp, seq long, event string"
OUTPUT_SCHEMA = (
    "deployment_id string, ts timestamp, seq long, kind string, exits_in_window long, "
    "verdict string, delay_s long, outcome string"
)
_COLS = ["deployment_id", "ts", "seq", "kind", "exits_in_window", "verdict", "delay_s", "outcome"]


class CrashLoopProcessor(StatefulProcessor):
    def __init__(self, window_s: float = C.CRASH_WINDOW_S, max_exits: int = C.CRASH_MAX_EXITS,
                 base_s: float = C.RESPAWN_BASE_DELAY_S, cap_s: float = C.RESPAWN_MAX_DELAY_S, bucket_s: float = 1):
        self.window_us = int(window_s * 1_000_000)
        self.max_exits = max_exits
        self.base_s, self.cap_s, self.bucket_s = base_s, cap_s, bucket_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = HeldRows(handle, "held", self.bucket_s)
        self.exits = RecentTimes(handle, "exits", self.window_us)
        # pending: [due, micros, seq] of the respawns to come, by due time; within the longest delay.
        self.folded = handle.getValueState("folded", "live boolean, control string, ready boolean, pending string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = ((micros_of(r.ts), int(r.seq), r.event) for frame in rows for r in frame.itertuples(index=False))
        if is_batch(timerValues):
            yield from self._advance(key[0], self.held.in_order(new), None)
        else:
            self.held.add(new)
            self.held.wake(self._next_due())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.fired()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        until = self.held.whole_until(now)
        yield from self._advance(key[0], self.held.drain(until), until)
        self.held.wake(self._next_due())

    def _next_due(self) -> int | None:
        pending = json.loads(self.folded.get()[3]) if self.folded.exists() else []
        return pending[0][0] if pending else None

    def _advance(self, dep: str, ripe: Iterator[list], until: int | None) -> Iterator[pd.DataFrame]:
        """Apply the ripe rows and settle the checks due before ``until`` (all where None)."""
        live, control, ready, pending = self.folded.get() if self.folded.exists() else (False, None, True, "[]")
        pending = [tuple(p) for p in json.loads(pending)]
        self.exits.load()
        out: list[tuple] = []

        def settle(moment: int | None) -> None:
            outcome = "cancelled" if control == "stop" else "already_running" if live else "respawn_due" if ready else "unready"
            while pending and (moment is None or pending[0][0] < moment):
                _, t, seq = heapq.heappop(pending)
                out.append((dep, timestamp_of(t), seq, "respawn_check", None, None, None, outcome))

        for rows in ripe:
            for t, seq, event in rows:
                settle(t)
                if event == "restart" or (event == "start" and not live):
                    self.exits.clear()
                if event == "exit" and control != "stop":
                    n = self.exits.add(t)
                    verdict = "crashed" if n > self.max_exits else "respawn"
                    delay = int(min(self.base_s * 2 ** (n - 1), self.cap_s)) if verdict == "respawn" else None
                    out.append((dep, timestamp_of(t), seq, "exit", n, verdict, delay, None))
                    if delay is not None:
                        heapq.heappush(pending, (t + delay * 1_000_000, t, seq))
                live, control, ready = LIVE_AFTER.get(event, live), CONTROL_AFTER.get(event, control), READY_AFTER.get(event, ready)
            if out:
                yield pd.DataFrame(out, columns=_COLS)
                out.clear()
        settle(until)
        self.exits.save()
        self.folded.update((live, control, ready, json.dumps(sorted(pending))))
        if out:
            yield pd.DataFrame(out, columns=_COLS)

    def close(self) -> None:
        pass


def crash_alert_stream(
    events: DataFrame, lateness: str, window_s: float = C.CRASH_WINDOW_S, max_exits: int = C.CRASH_MAX_EXITS, bucket_s: float = 1
) -> DataFrame:
    """Streaming O20+O21 with respawn checks.  ``lateness`` bounds how late an event
    may arrive; results come that much and ``bucket_s`` later.  On a batch frame it
    gives all rows at once."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("deployment_id")
        .transformWithStateInPandas(
            statefulProcessor=CrashLoopProcessor(window_s, max_exits, bucket_s=bucket_s),
            outputStructType=OUTPUT_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def missed_rows(events: DataFrame, emitted: DataFrame, window_s: float = C.CRASH_WINDOW_S, max_exits: int = C.CRASH_MAX_EXITS) -> DataFrame:
    """Rows of the batch rules over ``events`` (a closed range, late rows included)
    that the stream did not emit as they are."""
    none = lambda t: F.lit(None).cast(t)
    exits = lifecycle_crash_loop(events, window_s=window_s, max_exits=max_exits).select(
        "deployment_id", "ts", "seq", F.lit("exit").alias("kind"), "exits_in_window", "verdict", "delay_s", none("string").alias("outcome")
    )
    checks = respawn_checks(events, window_s=window_s, max_exits=max_exits).select(
        "deployment_id", "ts", "seq", F.lit("respawn_check").alias("kind"), none("long").alias("exits_in_window"),
        none("string").alias("verdict"), none("long").alias("delay_s"), "outcome",
    )
    return exits.unionByName(checks).exceptAll(emitted.select(*_COLS))
