"""Quality rules: robust multivariate outliers per language and source (operator 9).

Each whole text gives base counts and a vector of transformed statistics in which
clean texts differ too: mean word length, share of characters that are no letters,
share of capitals, share of words met before in their block of ``BLOCK`` words; and
the share of repeated lines, which most texts do not have.  Per
(language, source) a minimum-covariance-determinant estimate of centre and
scatter is found by concentration steps: from medians and median deviations,
take the half-plus share ((n + d + 1) / 2 of n) of vectors with the smallest
Mahalanobis distances, estimate anew, and repeat until the determinant stops
falling.  The vectors within the 0.975 quantile of that estimate give the final
one.  A text whose squared distance exceeds the cutoff is rejected where a statistic
stands out on the side of more noise.  Statistics over few words scatter more, so
distances of n words are weighed by n / (n + ``STEADY_WORDS``).

Groups too small for an estimate use that of their language, and languages too
small that of the whole table.  Where half the vectors agree in a statistic (the
exact fit of the method: no capitals, no repeated line) its scatter is zero, and a
floor well below the spread of usual texts takes its place.

Defined results: null text or text without a word has zero counts, fails the
base rules and is not kept.  Null languages and sources are groups of their own.
With fewer texts than an estimate needs in the whole table the base rules alone
decide.  Repeated rows are judged alike.  Only built-in expressions run.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, WORD_PATTERN, cut

SHINGLE = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
STATS = ("f_len", "f_mark", "f_up", "f_same", "f_dup")
LOWER = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
#: Centre, Cholesky factor of the scatter and the inverse of that factor.
ESTIMATE = (*[f"m{i}" for i in range(len(STATS))], *[f"l{i}{j}" for i, j in LOWER], *[f"w{i}{j}" for i, j in LOWER])
#: Standard deviations that each statistic has at least.  Measured scatter of the first
#: four is two to four times as large; repeated lines have none among most texts.
FLOORS = (0.03, 0.07, 0.07, 0.07, 0.5)
#: Words of a block in which words met before are counted (texts of any length compare).
BLOCK = 50
#: Shares below which differences of a logarithm of a share mean little.
SMALL_MARK, SMALL_UP, SMALL_SAME = 0.01, 0.01, 0.02
#: Words from which on a text weighs more than half of its distance.
STEADY_WORDS = 200
#: Shares of a group at which distances are cut; a group takes the first that holds
#: the half-plus share.
SHARES = tuple(0.5 + k / 200 for k in range(101))
MAX_STEPS = 500
#: Estimates of up to so many groups (some 400 bytes each) are broadcast to the vectors.
MAX_BROADCAST_GROUPS = 5_000
#: Partitions that the estimates of all groups keep from step to step.
STATE_PARTITIONS = 8
#: A determinant that falls by less than this part has stopped falling.
SETTLED = 1e-4
#: Squared distance up to which vectors feed the final estimate (0.975 quantile).
REWEIGHT_SHARE, REWEIGHT_CUTOFF = 0.975, 12.833
#: Lines added to each text's number of lines where their repeats are judged: one chance
#: repeat among four lines is no fault, most lines of a text alike are.
EXTRA_LINES = 20
#: Five texts for each statistic.
MIN_GROUP = 5 * len(STATS)
SALTS = 32
#: Squared distance: the chi-square quantile of 5 degrees at 0.999.
CUTOFF = 20.515
#: Deviations by which a statistic stands out.
STANDS_OUT = 3.0


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_PATTERN), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (bound as a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def _window_hashes(one: Column) -> Column:
    """Hashes of all 8-word windows from those of the words, by doubling: pairs, fours, eights."""

    def double(h: Column, by: int) -> Column:
        n = F.greatest(F.size(h) - by, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))

    return _let(double(one, 1), lambda h2: _let(double(h2, 2), lambda h4: double(h4, 4)))


def _distinct_in_blocks(hashes: Column) -> Column:
    """Distinct words of every block of ``BLOCK`` words, summed."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(BLOCK))
    return F.aggregate(starts, F.lit(0).cast("long"), lambda a, k: a + F.size(F.array_distinct(F.slice(hashes, k, F.lit(BLOCK)))))


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more: sort (hash, place), keep
    places with an equal neighbour, and sum the stretches they cover."""

    def stretches(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(SHINGLE), F.coalesce(F.get(p, k + 1) - x, F.lit(SHINGLE))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k + 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k - 1)["h"].eqNullSafe(x["h"])))
        return _let(F.array_sort(F.transform(twice, lambda x: x["i"])), stretches)

    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(order, repeated)


def base_counts(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_letters, n_upper, n_distinct, n_lines, n_dup_lines,
    n_repeat_words of every whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_PATTERN))

    def from_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long"))

    def per_word(h: Column) -> Column:
        return F.struct(F.size(h).cast("long").alias("n"), _distinct_in_blocks(h).alias("distinct"), _let(_window_hashes(h), from_hashes).alias("rep"))

    words = _let(F.transform(_words(t), lambda w: F.xxhash64(w)), per_word)
    per_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    d = docs.select(
        *keep,
        words.alias("w"),
        per_line.alias("l"),
        (F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        # Letters with the marks that scripts write beside them.
        F.char_length(F.regexp_replace(t, r"[^\p{L}\p{M}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    rest = [c for c in d.columns if c not in ("w", "l")]
    return d.select(*rest, F.col("w.n").alias("n_words"), F.col("w.distinct").alias("n_distinct"), F.col("w.rep").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"))


def statistics() -> list[Column]:
    """Transformed statistics, larger for worse texts but the first, which has two sides."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    share = lambda part, whole, small: F.log(small + part / whole)
    return [
        F.log(chars / n).alias("f_len"),
        share(F.col("word_chars") - F.col("n_letters"), chars, SMALL_MARK).alias("f_mark"),
        share(F.col("n_upper"), chars, SMALL_UP).alias("f_up"),
        share(F.col("n_words") - F.col("n_distinct"), n, SMALL_SAME).alias("f_same"),
        F.log1p(F.lit(100.0) * F.col("n_dup_lines") / (F.col("n_lines") + EXTRA_LINES)).alias("f_dup"),
    ]


def _beside(rows: DataFrame, small: DataFrame, on: list[tuple[str, str]], how: str = "left", few: bool = False) -> DataFrame:
    """``rows`` (with a column salt) joined to a table of one row per group: the
    small side is broadcast where it has ``few`` rows, else copied to every salt, so a
    hot group's rows stay spread out."""
    match = F.lit(True) if few else F.col("salt") == F.col("__s")
    for a, b in on:
        match = match & F.col(a).eqNullSafe(F.col(b))
    if few:
        return rows.join(F.broadcast(small), match, how).drop(*[b for _, b in on])
    copies = small.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, match, how).drop("__s", *[b for _, b in on])


def _groups(vectors: DataFrame, min_group: int) -> DataFrame:
    """(lang, source) -> judge, the key whose estimate judges its texts, and feeds,
    the keys to whose estimates they contribute."""
    key = lambda *c: F.to_json(F.struct(*c))
    g = vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    by_lang = Window.partitionBy("lang")
    g = g.withColumn("n_lang", F.sum("n").over(by_lang))
    own, lang, every = key(F.col("lang"), F.coalesce(F.col("source"), F.lit("\x00")).alias("source")), key(F.col("lang"), F.lit(1).alias("all")), F.lit("{}")
    g = g.withColumn("judge", F.when(F.col("n") >= min_group, own).when(F.col("n_lang") >= min_group, lang).otherwise(every))
    lang_used = F.max((F.col("judge") == lang).cast("int")).over(by_lang) == 1
    feeds = F.array_compact(F.array(F.when(F.col("judge") == own, own), F.when(lang_used, lang), F.when(F.col("any_small"), every)))
    small = g.agg(F.coalesce(F.max(F.col("judge") == "{}"), F.lit(False)).alias("any_small"))
    return g.crossJoin(F.broadcast(small)).select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "judge", feeds.alias("feeds"))


def _scatter(rows: DataFrame) -> DataFrame:
    """Centre m_i, the Cholesky factor l_ij of the scatter, its inverse w_ij and the
    determinant det, per key, from rows with the correction of their share; old_det is
    the determinant det of the rows."""
    d = len(STATS)
    sums = [f"avg({a}) AS m{i}" for i, a in enumerate(STATS)] + [f"covar_pop({STATS[i]}, {STATS[j]}) AS c{i}{j}" for i, j in LOWER]
    e = rows.groupBy("key").agg(*map(F.expr, ["first(correction) AS correction", "first(det) AS old_det", *sums]))
    # Each column may use those before it.
    columns = ["key", "old_det", *[f"m{i}" for i in range(d)]]
    for j in range(d):
        for i in range(j, d):
            rest = f"c{i}{j} * correction" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            floor = f"{FLOORS[j] ** 2!r}D"
            columns.append(f"sqrt(greatest({rest} + {floor}, {floor})) AS l{j}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    for i, j in LOWER:
        row = " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i))
        columns.append(f"1D / l{i}{i} AS w{i}{i}" if i == j else f"-({row}) / l{i}{i} AS w{i}{j}")
    columns.append(f"pow({' * '.join(f'l{i}{i}' for i in range(d))}, 2) AS det")
    return e.selectExpr(*columns).select("key", *ESTIMATE, "det", "old_det")


def _distance() -> Column:
    """Squared Mahalanobis distance."""
    rows = [" + ".join(f"w{i}{j} * ({STATS[j]} - m{j})" for j in range(i + 1)) for i in range(len(STATS))]
    return F.expr(" + ".join(f"pow({r}, 2)" for r in rows))


def _chi2(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees."""
    y, odd = x / 2, k % 2
    at, p = (0.5, math.erf(math.sqrt(y))) if odd else (1.0, 1 - math.exp(-y))
    while at < k / 2:
        p -= y**at * math.exp(-y) / math.gamma(at + 1)
        at += 1
    return p


@functools.cache
def consistency(d: int, share: float) -> float:
    """Factor that makes the scatter of the closest ``share`` of a normal sample
    consistent: share / P(chi2[d+2] <= quantile of chi2[d] at share)."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, d) < share else (lo, mid)
    return share / _chi2(lo, d + 2)


def _near(vectors: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    """The rows of the keys in ``est`` with their squared distance d2."""
    rows = _beside(vectors, est.select(F.col("key").alias("k"), *ESTIMATE, "det"), [("key", "k")], "inner", few)
    return rows.withColumn("d2", _distance()).select("key", "salt", *STATS, "d2", "det")


def _concentrate(vectors: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    """One concentration step of the keys in ``est``; moving: the determinant fell."""
    near = _near(vectors, est, few)
    half = F.floor((F.col("n") + len(STATS) + 1) / 2) / F.col("n")
    place = F.least(F.ceil((half - SHARES[0]) * 200 - 1e-9), F.lit(len(SHARES) - 1)).cast("int")
    factors = F.expr(f"array({', '.join(f'{consistency(len(STATS), x)!r}D' for x in SHARES)})")
    at = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d2", list(SHARES), 10000).alias("cuts"))
    at = at.select(F.col("key").alias("k"), F.get("cuts", place).alias("at"), F.get(factors, place).alias("correction"))
    new = _scatter(_beside(near, at, [("key", "k")], few=few).filter(F.col("d2") <= F.col("at")))
    return new.select("key", *ESTIMATE, "det", (F.col("det") < F.col("old_det") * (1 - SETTLED)).alias("moving"))


def estimate(vectors: DataFrame) -> DataFrame:
    """MCD estimates per key from rows (key, salt, statistics)."""
    few = vectors.select("key").distinct().count() <= MAX_BROADCAST_GROUPS
    mid = vectors.groupBy("key").agg(*[F.percentile_approx(a, 0.5, 10000).alias(f"m{i}") for i, a in enumerate(STATS)])
    mid = mid.withColumnRenamed("key", "k")
    dev = _beside(vectors, mid, [("key", "k")], few=few).groupBy("key").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(len(STATS))],
        *[F.percentile_approx(F.abs(F.col(a) - F.col(f"m{i}")), 0.5, 10000).alias(f"s{i}") for i, a in enumerate(STATS)],
    )
    spread = [F.sqrt(F.pow(F.col(f"s{i}") * 1.4826, 2) + FLOORS[i] ** 2) for i in range(len(STATS))]
    first = [(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in LOWER]
    first += [(1 / spread[i] if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in LOWER]
    start = dev.select("key", *[f"m{i}" for i in range(len(STATS))], *first, F.lit(float("inf")).alias("det"), F.lit(True).alias("moving"))
    # One job a step: settled keys pass through, the others move on.  Without coalesce the
    # union would add the partitions of a step to those of all steps before it.
    state = cut(start.coalesce(STATE_PARTITIONS))
    for _ in range(MAX_STEPS):
        moved = _concentrate(vectors, state.filter("moving"), few).unionByName(state.filter("NOT moving"))
        state = cut(moved.coalesce(STATE_PARTITIONS))
        if state.filter("moving").isEmpty():
            break
    else:
        raise RuntimeError(f"estimates still change after {MAX_STEPS} steps")
    near = _near(vectors, state, few).filter(F.col("d2") <= REWEIGHT_CUTOFF)
    return cut(_scatter(near.withColumn("correction", F.lit(consistency(len(STATS), REWEIGHT_SHARE)))).drop("det", "old_det"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """doc_id, the base counts, base_failed, distance (squared; null without an
    estimate) and kept, for every row."""
    keep = [F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    base = base_counts(docs, F.col(text_col), keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = cut(base.withColumn("base_failed", failed).select("*", *statistics(), salt.alias("salt")))
    vectors = rows.filter(F.col("n_words") >= MIN_WORDS).select("lang", "source", "salt", *STATS)
    groups = cut(_groups(vectors, min_group))
    on = [("lang", "gl"), ("source", "gs")]
    fed = cut(_beside(vectors, groups, on).select(F.explode("feeds").alias("key"), "salt", *STATS))
    enough = fed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_group).select("key")
    est = estimate(fed).join(enough, "key", "left_semi")
    known = groups.join(est, groups["judge"] == est["key"], "left").drop("feeds", "key")
    steady = F.col("n_words") / (F.col("n_words") + F.lit(float(STEADY_WORDS)))
    out = _beside(rows, known, on).withColumn("distance", _distance() * steady)
    # Fewer marks or repeats than usual are no fault; of word lengths both sides are.
    worse = F.lit(False)
    for i, a in enumerate(STATS):
        gap = F.col(a) - F.col(f"m{i}")
        spread = sum((F.pow(F.col(f"l{i}{j}"), 2) for j in range(i + 1)), F.lit(0.0))
        worse = worse | ((F.abs(gap) if i == 0 else gap) > STANDS_OUT * F.sqrt(spread))
    outlier = F.coalesce((F.col("distance") > cutoff) & worse, F.lit(False))
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & ~outlier).alias("kept"),
    )
