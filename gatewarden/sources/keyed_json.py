"""O2 read_keyed_json: per-platform JSON map files -> one row per entry.

Files are named ``{platform}-{suffix}.json``; the platform is the file stem
with the *last* ``-{suffix}`` removed.  A file that is not a JSON object is
read as empty.  Entries are typed one by one: an entry that is no object stays
an entry, with null fields (approving it ends as 422), and spoils no other.
Both kinds are also reported in a side output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PENDING_ENTRY = "struct<user_id: string, user_name: string, created_at: double, hash: string, salt: string>"
APPROVED_ENTRY = "struct<user_name: string, approved_at: double>"


def platform_of(name: str, suffix: str):
    """Platform from a file name: greedy, so the last ``-suffix`` is removed."""
    return F.regexp_extract(F.col(name), r"^(.*)-" + suffix + r"\.json$", 1)


def read_keyed_json(
    files: DataFrame,
    suffix: str,
    entry_schema: str = PENDING_ENTRY,
    name: str = "name",
    text: str = "text",
    key: str = "deployment_id",
) -> tuple[DataFrame, DataFrame]:
    """files(dep, name, text) -> (entries(dep, platform, entry_key, entry...),
    corrupt(dep, name, entry_key)); ``entry_key`` is null where the whole file is unreadable.

    Only names ending in ``-{suffix}.json`` are read.  Map-side only.
    """
    f = files.filter(F.col(name).rlike(r"-" + suffix + r"\.json$")).select(
        key, name, platform_of(name, suffix).alias("platform"), F.from_json(F.col(text), "map<string, variant>").alias("__m")
    )
    fields = T.StructType.fromDDL(entry_schema.removeprefix("struct<").removesuffix(">"))
    typed = [F.try_variant_get("__e", f"$.{x.name}", x.dataType.simpleString()).alias(x.name) for x in fields]
    is_object = F.coalesce(F.schema_of_variant("__e").startswith("OBJECT"), F.lit(False))
    # explode_outer + a filter on the generated key: a plain explode makes the
    # optimizer add size(from_json(...)) > 0 below the projection, parsing
    # every file twice.
    pairs = f.select(key, name, "platform", F.col("__m").isNull().alias("__bad"), F.explode_outer("__m").alias("entry_key", "__e"))
    entries = pairs.filter(F.col("entry_key").isNotNull()).select(key, "platform", "entry_key", *typed)
    corrupt = pairs.filter(F.col("__bad") | (F.col("entry_key").isNotNull() & ~is_object)).select(key, name, "entry_key")
    return entries, corrupt


def read_pairing_dir(spark: SparkSession, path: str, suffix: str, entry_schema: str = PENDING_ENTRY, deployment_from_path: str | None = None):
    """Read a folder of pairing files (one file per platform) whole."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")
    )
    dep = F.regexp_extract("__path", deployment_from_path, 1) if deployment_from_path else F.lit(None).cast("string")
    return read_keyed_json(raw.withColumn("deployment_id", dep), suffix, entry_schema)
