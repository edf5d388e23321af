"""Skew-safe ordered scans (running sum / max / last and next non-null per key).

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to
one task.  When one deployment (or session, or flow) holds a third of all
rows that task holds a third of the data.  The scans here split each key
into time buckets instead:

1. rows are partitioned by ``(key, bucket)`` and scanned locally
   (one window pass, spread over many tasks even for a hot key);
2. one summary row per ``(key, bucket)`` is aggregated from the input rows
   (partial aggregation map-side, so only summary rows are shuffled; the
   input's scan is read twice, so callers do not stack scans);
3. the carry of all earlier buckets is a window over the *summary* table,
   whose size is bounded by the time span / bucket width, not by the data;
4. the carry is joined back on ``(key, bucket)``: only the summary side is
   shuffled, the big side keeps its partitioning.

The result equals the single-window scan exactly (tests compare both).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_S = 3600


@dataclass(frozen=True)
class ScanSpec:
    """One running column: ``kind`` in {"sum", "max", "last", "next"}.

    ``last`` is the last non-null value of ``expr`` up to and including the
    current row (``exclusive=True``: strictly before it), ``next`` the first one
    from the current row on (strictly after it).  ``sum`` of an all-null prefix
    is 0.
    """

    name: str
    kind: str
    expr: Column
    exclusive: bool = False


def micros(ts: str | Column) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def as_timestamp(v) -> Column:
    """A time parameter (Column, string or datetime) as a TIMESTAMP column."""
    return v.cast("timestamp") if isinstance(v, Column) else F.lit(v).cast("timestamp")


def bucket_of(time_us: str, width_us: int) -> Column:
    """Exact integer floor division of a BIGINT microsecond column (no doubles)."""
    w = int(width_us)
    return F.expr(f"(`{time_us}` - pmod(`{time_us}`, {w}L)) div {w}L")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    time_us: str,
    order: Sequence[str | Column],
    specs: Sequence[ScanSpec],
    bucket_s: int = DEFAULT_BUCKET_S,
) -> DataFrame:
    """Add one column per spec: an inclusive running aggregate per ``keys``.

    ``time_us`` names a BIGINT epoch-microsecond column; ``order`` must start
    with it and make the order total within a key (ties broken by a sequence).
    """
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    bucket_us = int(bucket_s) * 1_000_000
    bkt = "__bkt"
    x = df.withColumn(bkt, bucket_of(time_us, bucket_us))
    x = x.withColumns({f"__v{i}": s.expr for i, s in enumerate(specs)})

    w_base = Window.partitionBy(*[F.col(k) for k in keys], F.col(bkt)).orderBy(*order_cols)
    # Looking ahead is looking back in reverse order: a second sort of the same
    # partitions (a frame to the end of the partition would be quadratic).
    w_ahead = Window.partitionBy(*[F.col(k) for k in keys], F.col(bkt)).orderBy(*[o.desc() for o in order_cols])
    local_cols = {}
    for i, s in enumerate(specs):
        v = F.col(f"__v{i}")
        w_local = (w_ahead if s.kind == "next" else w_base).rowsBetween(Window.unboundedPreceding, -1 if s.exclusive else Window.currentRow)
        if s.kind == "sum":
            local_cols[f"__l{i}"] = F.coalesce(F.sum(v).over(w_local), F.lit(0))
        elif s.kind == "max":
            local_cols[f"__l{i}"] = F.max(v).over(w_local)
        elif s.kind in ("last", "next"):
            local_cols[f"__l{i}"] = F.last(v, ignorenulls=True).over(w_local)
        else:
            raise ValueError(f"unknown scan kind {s.kind!r}")
    local = x.withColumns(local_cols)

    # One summary row per (key, bucket): what the bucket contributes.  It is
    # aggregated from the input rows (partial aggregation map-side, so only
    # summary rows are shuffled); the input's own scan is read a second time.
    # Callers avoid stacking scans on scan outputs, which would multiply that.
    order_struct = F.struct(*order_cols)
    summary_aggs = []
    for i, s in enumerate(specs):
        v = F.col(f"__v{i}")
        if s.kind == "sum":
            summary_aggs.append(F.sum(v).alias(f"__s{i}"))
        elif s.kind == "max":
            summary_aggs.append(F.max(v).alias(f"__s{i}"))
        elif s.kind == "next":
            summary_aggs.append(F.min_by(v, F.when(v.isNotNull(), order_struct)).alias(f"__s{i}"))
        else:  # last: the last non-null value of the bucket
            summary_aggs.append(F.max_by(v, F.when(v.isNotNull(), order_struct)).alias(f"__s{i}"))
    summary = x.groupBy(*keys, bkt).agg(*summary_aggs)

    per_key = Window.partitionBy(*[F.col(k) for k in keys])
    w_prev = per_key.orderBy(F.col(bkt)).rowsBetween(Window.unboundedPreceding, -1)
    w_next = per_key.orderBy(F.col(bkt).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for i, s in enumerate(specs):
        sc = F.col(f"__s{i}")
        if s.kind == "sum":
            c = F.coalesce(F.sum(sc).over(w_prev), F.lit(0))
        elif s.kind == "max":
            c = F.max(sc).over(w_prev)
        else:
            c = F.last(sc, ignorenulls=True).over(w_next if s.kind == "next" else w_prev)
        carry_cols.append(c.alias(f"__c{i}"))
    carry = summary.select(*keys, bkt, *carry_cols)

    joined = local.join(carry, on=[*keys, bkt], how="inner")
    out_cols = {}
    for i, s in enumerate(specs):
        lc, cc = F.col(f"__l{i}"), F.col(f"__c{i}")
        if s.kind == "sum":
            out_cols[s.name] = lc + cc
        elif s.kind == "max":
            out_cols[s.name] = F.greatest(lc, cc)
        else:
            out_cols[s.name] = F.coalesce(lc, cc)
    out = joined.withColumns(out_cols)
    drop = [bkt] + [f"__{p}{i}" for i in range(len(specs)) for p in ("v", "l", "c")]
    return out.drop(*drop)


def ordered_scan_single_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    specs: Sequence[ScanSpec],
) -> DataFrame:
    """Reference form of :func:`ordered_scan` (one window per key); tests only."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    cols = {}
    for s in specs:
        along = [o.desc() for o in order_cols] if s.kind == "next" else order_cols
        w = Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1 if s.exclusive else 0)
        if s.kind == "sum":
            cols[s.name] = F.coalesce(F.sum(s.expr).over(w), F.lit(0))
        elif s.kind == "max":
            cols[s.name] = F.max(s.expr).over(w)
        else:
            cols[s.name] = F.last(s.expr, ignorenulls=True).over(w)
    return df.withColumns(cols)
