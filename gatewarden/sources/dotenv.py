"""O1 parse_dotenv: ``.env`` text -> (key, value) rows, Python rules exactly.

Rules: split lines the way ``str.splitlines`` does, strip each line with
Python whitespace, skip blank lines, ``#`` lines and lines without ``=``;
split at the first ``=``; strip key and value; remove one matching pair of
quotes around the value.  ``export`` stays part of the key; no inline
comments; an empty key (``=x``) is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip, split_lines, unquote_once


def parse_dotenv(
    files: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("deployment_id", "path"),
) -> DataFrame:
    """files(keep..., text) -> (keep..., line_no, key, value).

    Map-side only: each text is split and filtered inside its own task
    (no shuffle); the cheap ``contains('=')`` test runs before the regex work.
    """
    keep = list(keep)
    lines = files.select(*keep, F.posexplode(split_lines(text)).alias("__pos", "__raw"))
    lines = lines.filter(F.col("__raw").contains("="))
    stripped = lines.select(*keep, (F.col("__pos") + 1).alias("line_no"), py_strip("__raw").alias("__line"))
    kv = stripped.filter(
        (F.length("__line") > 0) & ~F.col("__line").startswith("#") & F.col("__line").contains("=")
    )
    key = py_strip(F.substring_index("__line", "=", 1))
    rest = F.expr("substring(__line, instr(__line, '=') + 1)")
    return kv.select(
        *keep,
        F.col("line_no").cast("int").alias("line_no"),
        key.alias("key"),
        unquote_once(py_strip(rest)).alias("value"),
    )


def read_dotenv_files(spark: SparkSession, paths: str | list[str], deployment_from_path: str | None = None) -> DataFrame:
    """Read ``.env`` snapshot files whole (one row per file) and parse them.

    ``deployment_from_path`` is a regex with one group applied to the file
    path to obtain ``deployment_id``; without it the path itself is used.
    Spark's file sources skip names starting with ``.`` or ``_``, so
    snapshots are expected under a visible name (e.g. ``<dep>/settings.env``).
    """
    raw = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    dep = F.regexp_extract("path", deployment_from_path, 1) if deployment_from_path else F.col("path")
    return parse_dotenv(raw.withColumn("deployment_id", dep))
