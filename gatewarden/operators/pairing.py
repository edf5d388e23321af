"""Pairing jobs: pending list with TTL, approve/deny resolution, approved users.

Key of a pending request: (deployment_id, platform, code).  ``code`` is an
opaque handle: stripped on input but never case-folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import py_strip
from .scans import as_timestamp, micros

# ---------------------------------------------------------------------------
# O8 pending_requests
# ---------------------------------------------------------------------------


def pending_requests(pending: DataFrame, as_of: str | Column, ttl_s: float = C.PAIRING_TTL_S) -> DataFrame:
    """Requests visible at ``as_of``: ``as_of - created_at <= ttl`` (inclusive).

    A missing ``created_at`` counts as ``as_of`` (never ages).  The TTL only
    hides a request; it does not expire it (approve has no TTL check).
    ``age_minutes`` is truncated toward zero.
    """
    now = micros(as_timestamp(as_of))
    created = F.coalesce(micros("created_at"), now)
    age_us = now - created
    return pending.filter(age_us <= F.lit(int(ttl_s * 1_000_000))).select(
        *[c for c in ("deployment_id",) if c in pending.columns],
        "platform",
        "code",
        F.coalesce("user_id", F.lit("")).alias("user_id"),
        F.coalesce("user_name", F.lit("")).alias("user_name"),
        (age_us / F.lit(60_000_000)).cast("bigint").alias("age_minutes"),
    )


# ---------------------------------------------------------------------------
# O16 resolve_decisions
# ---------------------------------------------------------------------------


def resolve_decisions(pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply approve / deny decisions to a pending snapshot.

    decisions(decision_id, deployment_id, ts, seq, op, platform, code).
    Returns ``(outcomes, remaining_pending, approvals)``:

    * outcomes(decision_id, status): 400 missing platform or code; approve:
      404 unknown (or already resolved) code, 422 entry without user_id (the
      entry stays), else 200; deny: always 200;
    * the first *effective* decision per code (deny, or approve of an entry
      with a user_id), in (ts, seq) order, resolves it; later approves are 404;
    * remaining_pending: entries no effective decision touched (``left_anti``);
    * approvals(deployment_id, platform, user_id, user_name, ts, seq) for
      input to :func:`approved_users`.

    Aggregations and equi-joins only.  The first effective decision per code
    is ``least(first valid deny, first valid approve if the entry has a
    user_id)``: both minima come from the decisions alone (partially
    aggregated map-side, one row per code), so the decisions are joined once,
    to a one-row-per-code table, and never to themselves.
    """
    k = ["deployment_id", "platform", "code"]
    p = pending.select(
        *k,
        py_strip(F.coalesce("user_id", F.lit(""))).alias("__uid"),
        F.coalesce("user_name", F.lit("")).alias("__uname"),
    )
    d = decisions.select(
        "decision_id",
        "deployment_id",
        "ts",
        "seq",
        "op",
        "platform",
        py_strip(F.coalesce("code", F.lit(""))).alias("code"),
    )
    # Approve validates its fields; deny does not; an unreadable body (op not
    # approve/deny) is 400 for either.
    missing = (F.coalesce(F.length("platform"), F.lit(0)) == 0) | (F.length("code") == 0)
    bad = ~F.coalesce(F.col("op").isin("approve", "deny"), F.lit(False)) | ((F.col("op") == "approve") & missing)
    o = F.struct("ts", "seq")
    firsts = d.groupBy(*k).agg(
        F.min(F.when(~bad & (F.col("op") == "deny"), o)).alias("__fd"),
        F.min(F.when(~bad & (F.col("op") == "approve"), o)).alias("__fa"),
    )
    has_uid = F.col("__uid").isNotNull() & (F.length("__uid") > 0)
    per_code = firsts.join(p, on=k, how="left").select(
        *k, "__uid", "__uname", F.least(F.col("__fd"), F.when(has_uid, F.col("__fa"))).alias("__first")
    )
    dj = d.join(per_code, on=k, how="left")
    exists = F.col("__uid").isNotNull()
    resolved_before = F.col("__first").isNotNull() & (o > F.col("__first"))
    status = (
        F.when(bad, F.lit(400))
        .when(F.col("op") == "deny", F.lit(200))
        .when(~exists | resolved_before, F.lit(404))
        .when(F.length("__uid") == 0, F.lit(422))
        .otherwise(F.lit(200))
    )
    outcomes = dj.select("decision_id", status.alias("status"), *k, "op", "ts", "seq", "__uid", "__uname", "__first")
    approvals = outcomes.filter(
        (F.col("op") == "approve") & (F.col("status") == 200) & (F.struct("ts", "seq") == F.col("__first"))
    ).select(
        "deployment_id",
        "platform",
        F.col("__uid").alias("user_id"),
        F.col("__uname").alias("user_name"),
        "ts",
        "seq",
    )
    resolved = per_code.filter(F.col("__first").isNotNull()).select(*k)
    remaining = pending.join(resolved, on=k, how="left_anti")
    return outcomes.select("decision_id", "status"), remaining, approvals


# ---------------------------------------------------------------------------
# O17 approved_users
# ---------------------------------------------------------------------------


def approved_users(approvals: DataFrame, revocations: DataFrame) -> DataFrame:
    """Change fold: per (dep, platform, user_id) the latest op by (ts, seq) wins;
    approve upserts name and time, revoke deletes (unknown user: no-op).
    ``max_by`` is partially aggregated map-side, so a hot user costs one row
    per map task."""
    k = ["deployment_id", "platform", "user_id"]
    a = approvals.select(*k, F.lit("approve").alias("op"), F.coalesce("user_name", F.lit("")).alias("user_name"), "ts", "seq")
    r = revocations.select(*k, F.lit("revoke").alias("op"), F.lit(None).cast("string").alias("user_name"), "ts", "seq")
    ops = a.unionByName(r)
    last = ops.groupBy(*k).agg(F.max_by(F.struct("op", "user_name", "ts"), F.struct("ts", "seq")).alias("__l"))
    return last.filter(F.col("__l.op") == "approve").select(
        *k, F.col("__l.user_name").alias("user_name"), F.col("__l.ts").alias("approved_at")
    )
