"""Helpers shared by the training-data operators: shared-folder tables, filters
of bounded size, ranks without hot groups, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Word separators of every word count here: ASCII blank and the controls 9-13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

# Arrow batches of whole texts: bounded in rows and in bytes, so a run of very
# long documents cannot fill a Python worker.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

#: Bits of a filter for each key that it marks, its 64-bit words at most (4 MB), and words in a row.
FILTER_BITS, FILTER_WORDS, FILTER_ROW = 32, 1 << 19, 512


def limit_arrow_batches(spark: SparkSession) -> None:
    for k, v in ARROW_BATCH.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.  A session
    that names none must be local (tests): then a folder of this machine serves, and the
    context remembers it."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="gatewarden-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read the shared copy, so a lost executor
    costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    # New column ids: unions of checkpoints fail where one keeps constraints on columns of its past.
    return out.select(*[F.col(f"`{c}`").alias(c) for c in out.columns])


def table_in_shared_dir(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.
    For wider results, which Parquet holds more compactly than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """Identity of a text (128-bit digest of its UTF-8 bytes; null as empty)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def likely_in(rows: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose ``column`` may be among the ``n`` values of the one column of ``keys``:
    all that are, and a few others, which a join with ``keys`` drops.

    The keys are marked as bits by their hash, and only these bits are broadcast: so the
    driver holds ``FILTER_WORDS`` of them at most, and no table of keys."""
    words = FILTER_ROW
    while words < min(n * FILTER_BITS // 64 + 1, FILTER_WORDS):
        words *= 2
    if n > words * 64:  # nearly every bit would be set
        return rows
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit(words * 64 - 1))
    bit = lambda c: at(c).bitwiseAND(F.lit(63)).cast("int")
    row_bits = (FILTER_ROW * 64).bit_length() - 1
    key = F.col(keys.columns[0])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(key))
    marks = keys.groupBy(F.shiftright(at(key), 6).alias("__w")).agg(F.bit_or(one).alias("__m"))
    entry = F.struct(F.col("__w").bitwiseAND(F.lit(FILTER_ROW - 1)).alias("i"), F.col("__m").alias("m"))
    marks = marks.groupBy(F.shiftright("__w", row_bits - 6).alias("__r")).agg(F.map_from_entries(F.collect_list(entry)).alias("__m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(FILTER_ROW - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("long")))
    marks = marks.select("__r", dense.alias("__m"))
    own = F.col(f"`{column}`")
    word = F.get("__m", F.shiftright(at(own), 6).bitwiseAND(F.lit(FILTER_ROW - 1)).cast("int"))
    found = rows.join(F.broadcast(marks), F.shiftright(at(own), row_bits) == F.col("__r"))
    return found.filter(F.getbit(word, bit(own)) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def gapless_rank(
    df: DataFrame, group: list[str], order: list[str], out: str, rows_per_bucket: int = 50_000, counts: DataFrame | None = None
) -> DataFrame:
    """Number the rows of each group 0..n-1 by (hash of ``order``, ``order``).

    A group larger than ``rows_per_bucket`` is cut into hash ranges: rows are
    counted per range, the ranges' offsets are summed, and rows are numbered
    within their range only, so no task holds a whole hot group.  ``df`` is read
    twice or three times and should be a checkpoint or a table.
    """
    on = lambda: [same(F.col(c), F.col(f"__{c}")) for c in group]
    keys = [F.col(c).alias(f"__{c}") for c in group]
    gone = [f"__{c}" for c in group]
    d = df.withColumn("__h", F.xxhash64(*order))
    sizes = counts if counts is not None else d.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    big = sizes.filter(F.col("__n") > rows_per_bucket).select(*keys, "__n")
    # The hash's upper 32 bits as a fraction pick one of the group's ranges.
    frac = F.shiftrightunsigned(F.col("__h"), 32).cast("double") / float(1 << 32)
    d = d.join(big, on(), "left").drop(*gone)
    d = d.withColumn("__b", F.coalesce(F.floor(frac * F.ceil(F.col("__n") / F.lit(float(rows_per_bucket)))), F.lit(0)).cast("int"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.filter(F.col("__n").isNotNull()).groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__c"))
    offsets = ranges.withColumn("__off", F.sum("__c").over(before)).select(*keys, F.col("__b").alias("__ob"), "__off")
    numbered = d.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__b").orderBy("__h", *order)) - 1)
    numbered = numbered.join(offsets, on() + [F.col("__b") == F.col("__ob")], "left")
    return numbered.withColumn(out, F.coalesce(F.col("__off"), F.lit(0)).cast("long") + F.col("__r")).drop(
        "__h", "__n", "__b", "__r", "__off", "__ob", *gone
    )


def _nearest(edges: DataFrame, salts: int) -> DataFrame:
    """edges (u, v) with the smallest v of each u beside every edge.  The minima
    are copied over ``salts`` keys, so a hub's edges spread over as many tasks.

    They meet by one number, the hash of u and salt, and by u beside it: a table of few rows
    by a number takes a MB, by several columns whole pages, which the driver and all
    executors would hold for every round whose join becomes a broadcast."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select(F.col("u").alias("__u"), "m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s")).select("__u", "m", F.xxhash64("__u", "__s").alias("__h"))
    salted = edges.withColumn("__k", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")))
    # Equal, but not as a second key of the join.
    own = (F.col("u") >= F.col("__u")) & (F.col("u") <= F.col("__u"))
    return salted.join(low, (F.col("__k") == F.col("__h")) & own).select("u", "v", "m")


def connected_components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """Components of an undirected graph: edges (a, b) of any orderable type ->
    (node, component), component the smallest node.  Smallest nodes themselves
    have no row.  Alternating large-star and small-star rounds over distributed
    tables, until a round changes nothing; only a count and a checksum reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v"))
    e = cut(e.distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _nearest(both, salts)
        large = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        near = _nearest(large, salts)
        small = near.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.*").filter(F.col("u") != F.col("v")).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(now)
