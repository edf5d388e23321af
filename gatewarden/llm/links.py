"""Groups of near copies from candidate buckets, without all pairs of a bucket.

Rows that share a bucket are candidates.  First each bucket's members are tested
against one centre, the member that shares most rows over all its buckets (the
original of a large group of edited copies, as copies lose buckets with every
edit), which joins most of a group at once.  Then only members of one bucket
that are still in different components are tested against each other.  Every
candidate pair is thus tested or already connected, so the components are those
that testing all pairs would give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, likely_in

Pairs = Callable[[DataFrame], DataFrame]

#: Index rows of a bucket beyond which its rows are dealt into finer buckets.
HOT_INDEX = 32


def shared_buckets(members: DataFrame) -> DataFrame:
    """(bucket, node, index, centre) of buckets that hold an index row and another node.

    One aggregation finds these buckets (most hold a single node and go no
    further); their members then come from a second pass over the input, where a
    filter of bounded size drops most others before they are shuffled."""
    found = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("index").alias("any"))
    found = cut(found.filter(F.col("any") & (F.col("lo") < F.col("hi"))).select("bucket"))
    m = likely_in(members, "bucket", found, found.count()).groupBy("bucket", "node").agg(F.max("index").alias("index"))
    m = cut(m.join(found, "bucket"))
    score = m.join(m.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").groupBy("node").agg(F.sum("n").alias("score"))
    best = m.filter("index").join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("low"))).alias("best"))
    return m.join(best, "bucket").select("bucket", "node", "index", (-F.col("best.low")).alias("centre"))


def ordered(pairs: DataFrame) -> DataFrame:
    """(x, y) -> distinct (a, b) with a < b."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter(F.col("a") < F.col("b")).distinct()


def apart(rows: DataFrame) -> DataFrame:
    """(x, y): index rows with the rows of their bucket that are in another component."""
    left = rows.filter("index").select("bucket", F.col("node").alias("x"), F.col("c").alias("cx"))
    right = rows.select(F.col("bucket").alias("rb"), F.col("node").alias("y"), F.col("c").alias("cy"))
    return left.join(right, (F.col("bucket") == F.col("rb")) & (F.col("cx") != F.col("cy"))).select("x", "y")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold an index row and several components, with the
    number of index rows beside."""
    per = rows.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count_if("index").alias("n_index"))
    return rows.join(per.filter("lo < hi AND n_index > 0").select("bucket", "n_index"), "bucket")


def link_components(
    members: DataFrame, verify: Pairs, cross: Pairs | None = None, narrow: Pairs | None = None, meet: Pairs | None = None
) -> tuple[DataFrame, DataFrame]:
    """(components, links): components (node, component) without single nodes, links
    the verified pairs (a, b) that were tested.

    members: bucket, node (long), index (true where other rows may meet this one).
    verify: pairs (a, b) -> those that hold.  cross, where given, finds the links
    among groups (centre, node, component) whose members differ in component, in
    place of one join on the bucket.  narrow, where given, deals rows (bucket, node,
    index, c) of buckets with more than ``HOT_INDEX`` index rows into finer buckets in
    which every pair that can hold meets again.  meet, where given, pairs the rows
    (bucket, node, index, c) of buckets itself (default: :func:`apart`, every index row
    with every row of another component).
    """
    meet = meet or apart
    m = cut(shared_buckets(members))
    stars = cut(ordered(m.select(F.col("centre").alias("x"), F.col("node").alias("y"))))
    links = cut(verify(stars))
    parts = connected_components(links)
    named = m.join(parts, "node", "left").withColumn("c", F.coalesce("component", "node")).select("bucket", "node", "index", "centre", "c")
    if cross is not None:
        groups = named.select("centre", "node", F.col("c").alias("component")).distinct()
        more = cut(cross(groups))
    else:
        rest = _mixed(named.select("bucket", "node", "index", "c"))
        if narrow is None:
            pairs = meet(rest)
        else:
            rest = cut(rest)
            cold, hot = rest.filter(F.col("n_index") <= HOT_INDEX), rest.filter(F.col("n_index") > HOT_INDEX).drop("n_index")
            finer = cut(narrow(hot).groupBy("bucket", "node", "c").agg(F.max("index").alias("index")))
            pairs = meet(cold.drop("n_index").unionByName(_mixed(finer).drop("n_index")))
        more = cut(verify(cut(ordered(pairs).join(stars, ["a", "b"], "left_anti"))))
    links = links.unionByName(more)
    return connected_components(links), links
