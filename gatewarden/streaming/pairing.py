"""ST3: pairing requests and approve/deny decisions as a stream (O16 + O17 inputs).

Keyed by (deployment_id, platform, code) with ``transformWithStateInPandas``:
the state is the pending entry of that code (if any) and, where a lateness is
given, the rows that the watermark has not passed yet.  Requests, approvals
and denials are applied in (ts, seq) order, the way the admin endpoints
apply them: approve of an unknown or already resolved code is 404, of an
entry without a user id 422 (the entry stays), else 200 and the entry moves
to the approved list (an ``approval`` row); deny is always 200.  Like the
gateway, no TTL is applied to the state: the TTL only hides requests (O8).
Approval rows feed :func:`gatewarden.operators.pairing.approved_users`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import py_strip
from .common import HeldRows, is_batch, micros_of, timestamp_of

INPUT_SCHEMA = (
    "deployment_id string, platform string, code string, ts timestamp, seq long, kind string, "
    "decision_id long, user_id string, user_name string"
)
OUTPUT_SCHEMA = (
    "deployment_id string, platform string, code string, ts timestamp, seq long, kind string, "
    "decision_id long, status int, user_id string, user_name string"
)
_COLS = ["deployment_id", "platform", "code", "ts", "seq", "kind", "decision_id", "status", "user_id", "user_name"]


class PairingProcessor(StatefulProcessor):
    def __init__(self, ordered: bool = False, bucket_s: float = 1):
        self.ordered, self.bucket_s = ordered, bucket_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "user_id string, user_name string")
        self.held = HeldRows(handle, "held", self.bucket_s)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """The pending entry that a batch run left for this code."""
        for r in initialState.itertuples(index=False):
            self.entry.update((r.user_id or "", r.user_name or ""))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = (
            (micros_of(r.ts), int(r.seq), r.kind, None if pd.isna(r.decision_id) else int(r.decision_id), r.user_id, r.user_name)
            for frame in rows
            for r in frame.itertuples(index=False)
        )
        if self.ordered and not is_batch(timerValues):
            self.held.add(new)
            self.held.wake()
        else:
            yield from self._apply(key, self.held.in_order(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.fired()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        yield from self._apply(key, self.held.drain(self.held.whole_until(now)))
        self.held.wake()

    def _apply(self, key, ripe: Iterator[list]) -> Iterator[pd.DataFrame]:
        dep, platform, code = key
        entry = self.entry.get() if self.entry.exists() else None
        for rows in ripe:
            out = []
            for t, seq, kind, decision, user_id, user_name in rows:
                ts = timestamp_of(t)
                if kind == "request":
                    entry = (user_id or "", user_name or "")
                    continue
                if kind == "approve":
                    if entry is None:
                        status = 404
                    elif not (entry[0] or "").strip():
                        status = 422
                    else:
                        status = 200
                        out.append((dep, platform, code, ts, seq, "approval", decision, 200, entry[0].strip(), entry[1]))
                        entry = None
                else:
                    status, entry = 200, None
                out.append((dep, platform, code, ts, seq, "outcome", decision, status, None, None))
            if out:
                yield pd.DataFrame(out, columns=_COLS)
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(tuple(entry))

    def close(self) -> None:
        pass


def pairing_stream(
    requests: DataFrame, decisions: DataFrame, lateness: str | None = None, initial: DataFrame | None = None, bucket_s: float = 1
) -> DataFrame:
    """requests(deployment_id, platform, code, ts, user_id, user_name, seq) and
    decisions(decision_id, deployment_id, ts, seq, op, platform, code) streams
    -> outcome and approval rows (append).

    With ``lateness`` rows wait until the watermark passes them and apply in event
    order, whatever order they and their micro-batches come in; without it each
    micro-batch is taken as later than the ones before.  ``initial``
    (deployment_id, platform, code, user_id, user_name; one row for each code) is
    the pending table to start from, such as what is left of
    :func:`gatewarden.operators.pairing.resolve_decisions`.  On batch frames all rows
    apply in event order."""
    r = requests.select(
        "deployment_id", "platform", "code", "ts", "seq", F.lit("request").alias("kind"),
        F.lit(None).cast("long").alias("decision_id"), "user_id", "user_name",
    )
    d = decisions.select(
        "deployment_id", F.coalesce("platform", F.lit("")).alias("platform"), py_strip(F.coalesce("code", F.lit(""))).alias("code"),
        "ts", "seq", F.coalesce("op", F.lit("invalid")).alias("kind"), "decision_id",
        F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("user_name"),
    )
    # What no entry can change is answered at once; it needs no state and no shuffle.
    nothing = (F.col("kind") == "approve") & ((F.col("platform") == "") | (F.col("code") == ""))
    refused = d.filter(nothing | ~F.col("kind").isin("approve", "deny")).select(
        "deployment_id", "platform", "code", "ts", "seq", F.lit("outcome").alias("kind"), "decision_id", F.lit(400).alias("status"), "user_id", "user_name"
    )
    rows = r.unionByName(d.filter(~nothing & F.col("kind").isin("approve", "deny")))
    if lateness is not None:
        rows = rows.withWatermark("ts", lateness)
    k = ["deployment_id", "platform", "code"]
    decided = rows.groupBy(*k).transformWithStateInPandas(
        statefulProcessor=PairingProcessor(lateness is not None, bucket_s),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="None" if lateness is None else "EventTime",
        initialState=None if initial is None else initial.select(*k, "user_id", "user_name").groupBy(*k),
    )
    return decided.unionByName(refused)


APPROVED_SCHEMA = "deployment_id string, platform string, user_id string, user_name string, approved_at timestamp, approved boolean"
_APPROVED_COLS = ["deployment_id", "platform", "user_id", "user_name", "approved_at", "approved"]


class ApprovedProcessor(StatefulProcessor):
    """Latest approval or revocation of a user by (ts, seq); O17 as a stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, seq long, user_name string, approved boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        for frame in rows:
            for r in frame.itertuples(index=False):
                if last is None or (pd.Timestamp(r.ts), r.seq) >= (pd.Timestamp(last[0]), last[1]):
                    last = (pd.Timestamp(r.ts).to_pydatetime(), int(r.seq), r.user_name, bool(r.approved))
        self.last.update(last)
        yield pd.DataFrame([(*key, last[2], last[0], last[3])], columns=_APPROVED_COLS)

    def close(self) -> None:
        pass


def approved_stream(approvals: DataFrame, revocations: DataFrame) -> DataFrame:
    """approvals(deployment_id, platform, user_id, user_name, ts, seq) and
    revocations(deployment_id, platform, user_id, ts, seq) streams -> the newest
    state of each touched user; the batch form is
    :func:`gatewarden.operators.pairing.approved_users`."""
    a = approvals.select("deployment_id", "platform", "user_id", "user_name", "ts", "seq", F.lit(True).alias("approved"))
    r = revocations.select(
        "deployment_id", "platform", "user_id", F.lit(None).cast("string").alias("user_name"), "ts", "seq", F.lit(False).alias("approved")
    )
    return (
        a.unionByName(r)
        .groupBy("deployment_id", "platform", "user_id")
        .transformWithStateInPandas(
            statefulProcessor=ApprovedProcessor(), outputStructType=APPROVED_SCHEMA, outputMode="Append", timeMode="None"
        )
    )
