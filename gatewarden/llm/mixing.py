"""Mixing sources to target weights by entropy balancing (operator 8).

Every document may be taken 0, 1 or 2 times.  Among all rates in (0, 2) that meet
each source's token target, the ones nearest in entropy to "every document once"
are an exponential tilt of the two-copy binomial,

    rate(d) = 2 / (1 + exp(-lambda[source] * tokens(d) / scale[source])),

and the lambdas maximise a concave dual with one token constraint per source.
Its Hessian is diagonal, so a Newton step needs two sums per source: the tokens
taken and their derivative.  Rates depend on (source, tokens) alone, so all sums
run over the counts of those cells, never over the documents again.

Rates become whole copies per cell: cells run from long to short texts, and the
running sum of expected copies is rounded, which leaves an error of about one
long text per source; a few repair rounds then move copies of the cell that
closes most of what is left.  A cell's copies go to its documents in hash order.

Defined results: null text or text without words has size 0 and takes 0 words;
a null source is a source of its own, the last one; a source without words has
target 0; sources at the limit of twice their size are taken twice in full.
Repeated rows are rows of their own.  An empty table gives an empty result.
Only built-in expressions run; nothing but a convergence number reaches the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, gapless_rank, same

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
MAX_STEPS = 40
TOLERANCE = 1e-7
REPAIRS = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Weights repeat over the sources in code point order, null last.  The targets
    are min(cap * size, weight * level) with one level for all; it is found from
    the sources in the order in which they reach their cap."""
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * cap).withColumn("at", F.col("limit") / F.col("w"))
    order = everything.orderBy("at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_w = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", rest / open_w)
    # The first source whose cap lies above its level sets the level for the rest.
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(everything)["level"]
    return s.withColumn("target", F.when(F.col("at") <= F.coalesce(level, F.lit(float("inf"))), F.col("limit")).otherwise(F.col("w") * level)).select(
        "source", "source_size", "target"
    )


def _rate(lam: Column, x: Column) -> Column:
    return F.lit(float(MAX_COPIES)) / (F.lit(1.0) + F.exp(F.least(F.greatest(-lam * x, F.lit(-700.0)), F.lit(700.0))))


def solve(cells: DataFrame, goals: DataFrame, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Multipliers (source key s, lam) by safeguarded Newton steps on the dual.

    cells: s, size, n; goals: s, source_size, target, mean_size.  One step is one
    join and one aggregation over the cells; a step that would leave the bracket
    of its source halves it instead."""
    state = goals.filter((F.col("target") < F.col("source_size") * MAX_COPIES) & (F.col("target") > 0)).select(
        "s", "target", "mean_size", F.lit(0.0).alias("lam"), F.lit(-4096.0).alias("lo"), F.lit(4096.0).alias("hi"), F.lit(1.0).alias("off")
    )
    state = cut(state)
    for _ in range(max_steps):
        x = F.col("size") / F.col("mean_size")
        r = _rate(F.col("lam"), x)
        sums = (
            cells.filter("size > 0")
            .join(state, "s")
            .groupBy("s")
            .agg(
                F.sum(F.col("n") * F.col("size") * r).alias("g"),
                F.sum(F.col("n") * F.col("size") * x * r * (F.lit(1.0) - r / MAX_COPIES)).alias("h"),
                *[F.first(c).alias(c) for c in ("target", "mean_size", "lam", "lo", "hi")],
            )
        )
        gap = F.col("target") - F.col("g")
        step = sums.withColumn("off", F.abs(gap) / F.col("target")).withColumn("lo", F.when(gap > 0, F.col("lam")).otherwise(F.col("lo")))
        step = step.withColumn("hi", F.when(gap > 0, F.col("hi")).otherwise(F.col("lam")))
        newton = F.col("lam") + gap / F.greatest(F.col("h"), F.lit(1e-12))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        moved = F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(step.withColumn("lam", F.when(F.col("off") <= tolerance, F.col("lam")).otherwise(moved)).select(state.columns))
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    # A fixed grid, so that the order of floating-point sums cannot show in copies.
    return state.select("s", F.round("lam", 9).alias("lam"))


def _cell_copies(cells: DataFrame, goals: DataFrame, lams: DataFrame, repairs: int = REPAIRS) -> DataFrame:
    """cells with k, the copies to take of each cell (0 to 2 n)."""
    full = F.col("target") >= F.col("source_size") * MAX_COPIES
    rate = F.when(full, float(MAX_COPIES)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean_size")))
    c = cells.join(goals, "s").join(lams, "s", "left").withColumn("e", F.round(F.col("n") * F.when(F.col("size") > 0, rate).otherwise(1.0), 6))
    order = Window.partitionBy("s").orderBy(F.desc("size"))
    run = F.sum(F.col("e").cast("decimal(28,6)")).over(order)
    c = c.withColumn("run", F.floor(run + F.lit(0.5))).withColumn("k", F.col("run") - F.coalesce(F.lag("run").over(order), F.lit(0)))
    c = c.withColumn("k", F.least(F.greatest(F.col("k").cast("long"), F.lit(0)), F.col("n") * MAX_COPIES))
    c = cut(c.select("s", "size", "n", "source_size", "target", "k"))
    whole = Window.partitionBy("s")
    for _ in range(repairs):
        c = c.withColumn("left", F.round(F.col("target") - F.sum(F.col("k") * F.col("size")).over(whole)).cast("long"))
        spare = F.when(F.col("left") > 0, F.col("n") * MAX_COPIES - F.col("k")).otherwise(F.col("k"))
        move = F.when(F.col("size") > 0, F.least(spare, F.floor(F.abs(F.col("left")) / F.col("size")).cast("long"))).otherwise(F.lit(0).cast("long"))
        c = c.withColumn("move", move)
        best = F.max(F.struct((F.col("move") * F.col("size")).alias("a"), F.col("size").alias("z"))).over(whole)
        c = c.withColumn("best", best["z"]).withColumn(
            "k", F.when(F.col("size") == F.col("best"), F.col("k") + F.signum(F.col("left").cast("double")).cast("long") * F.col("move")).otherwise(F.col("k"))
        )
    return cut(c.select("s", "size", "n", "source_size", "target", "k"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, row (hash of the text), size, source_size, target, copies,
    taken for every row."""
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("row"), word_count(text).alias("size"))
    base = cut(base)
    s = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    cells = cut(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("s", s))
    per = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goals = targets(per.select("source", "source_size"), weights).join(per.select(F.col("source").alias("src"), "docs"), same(F.col("source"), F.col("src")))
    goals = cut(goals.select(s.alias("s"), "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean_size")))
    cells = cells.select("s", "size", "n")
    chosen = _cell_copies(cells, goals, solve(cells, goals))
    ranked = gapless_rank(
        base.withColumn("s", s), ["s", "size"], ["doc_id", "row"], "place", counts=cells.select("s", "size", F.col("n").alias("__n"))
    ).withColumnRenamed("size", "z")
    out = ranked.join(chosen.withColumnRenamed("s", "cs"), (F.col("s") == F.col("cs")) & (F.col("z") == F.col("size")))
    whole, rest = F.floor(F.col("k") / F.col("n")).cast("long"), F.col("k") % F.col("n")
    out = out.withColumn("copies", whole + F.when(F.col("place") < rest, 1).otherwise(0))
    return out.select("doc_id", "source", "row", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each row as often as it is taken (0, 1 or 2 times); columns as
    given.  Rows alike in doc_id, source and text are taken as often as they are
    together, all from one of them."""
    tag = uuid.uuid4().hex
    keys = [f"i{tag}", f"s{tag}", f"r{tag}"]
    got = mix(docs, id_col, text_col, source_col, weights).groupBy("doc_id", "source", "row")
    got = got.agg(F.sum("copies").cast("int").alias(f"c{tag}"), F.count(F.lit(1)).alias(f"n{tag}"))
    got = cut(got.filter(F.col(f"c{tag}") > 0).toDF(*keys, f"c{tag}", f"n{tag}"))
    own = [F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.xxhash64(F.col(f"`{text_col}`"))]
    d = docs.join(got, (own[0].eqNullSafe(F.col(keys[0]))) & (own[1].eqNullSafe(F.col(keys[1]))) & (own[2] == F.col(keys[2])))
    single = F.col(f"n{tag}") == 1
    d = d.filter(single).unionByName(d.filter(~single).dropDuplicates(keys))
    d = d.withColumn(f"t{tag}", F.explode(F.array_repeat(F.lit(1), F.col(f"c{tag}"))))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])
