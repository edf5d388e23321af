"""O5 publish_pairing_state, and the ``.env`` file sink of O4.

The gateway rewrites one JSON file per deployment and platform.  Here a publish
covers some deployments: their rows replace whatever those deployments had, also
where none are left, and all other deployments' rows stay.  Plain Parquet has no
row-level merge, so the published state is a log of publishes: each writes its own
rows and the list of the deployments it covers into folders of its own, by hash
bucket of the deployment, then a commit row that names its version.  It touches
no bucket of other deployments and no file of other publishes.

A deployment's state is the rows of the last committed publish that covers it, by
(version, publish).  Two publishers at a time may take the same version: each
deployment then takes the one of the greater name whole, and deployments that only
one of them covers lose nothing.  A publish that dies half-way has no commit row
and is not seen.  :func:`compact_published` folds the log into one publish.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("pending", "approved")
BUCKETS = 64
_NO_FILES = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def merge_published(previous: DataFrame, rows: DataFrame, published: DataFrame, key: str = "deployment_id") -> DataFrame:
    """The published deployments' ``rows``, and ``previous`` of all others."""
    covered = published.select(key).distinct()
    return previous.join(covered, key, "left_anti").unionByName(rows.join(covered, key, "left_semi"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "false").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in _NO_FILES:
            return None
        raise


def committed_version(spark: SparkSession, root: str) -> int:
    """The last committed version, 0 before the first."""
    commits = _read(spark, f"{root.rstrip('/')}/commits")
    return 0 if commits is None else commits.agg(F.max("version")).first()[0] or 0


def last_publishes(spark: SparkSession, root: str, key: str = "deployment_id") -> DataFrame | None:
    """(deployment, publish) of the publish that holds each deployment's state; None before the first."""
    root = root.rstrip("/")
    commits, covered = _read(spark, f"{root}/commits"), _read(spark, f"{root}/covered")
    if commits is None or covered is None:
        return None
    # One commit row for each publish; the folder names of both are partition columns.
    last = covered.join(commits, "publish").groupBy(key).agg(F.max(F.struct("version", "publish")).alias("last"))
    return last.select(key, F.col("last.publish").alias("publish"))


def read_published(spark: SparkSession, root: str, table: str, key: str = "deployment_id") -> DataFrame | None:
    """The committed rows of ``pending`` or ``approved``; None where there are none."""
    last, rows = last_publishes(spark, root, key), _read(spark, f"{root.rstrip('/')}/rows/{table}")
    if last is None or rows is None:
        return None
    rows = rows.join(last, [key, "publish"], "left_semi").drop("publish", "bucket")
    return None if rows.isEmpty() else rows


def publish_pairing_state(pending: DataFrame, approved: DataFrame, published: DataFrame, root: str, key: str = "deployment_id", buckets: int = BUCKETS) -> int:
    """Publish the pairing state of the ``published`` deployments (one row each at
    least, rows or not) and return the new version.  Only their buckets are written;
    rows of other deployments are left out."""
    spark = pending.sparkSession
    version = committed_version(spark, root) + 1
    covered = published.select(key).distinct()
    tables = {name: rows.join(covered, key, "left_semi") for name, rows in zip(TABLES, (pending, approved))}
    _write_publish(tables, covered, root, version, key, buckets)
    return version


def _write_publish(tables: dict[str, DataFrame], covered: DataFrame, root: str, version: int, key: str, buckets: int) -> None:
    root, publish = root.rstrip("/"), f"p-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    for folder, rows in (*((f"rows/{name}", rows) for name, rows in tables.items()), ("covered", covered)):
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}/publish={publish}")
    covered.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1).write.parquet(f"{root}/commits/publish={publish}")


def compact_published(spark: SparkSession, root: str, into: str, key: str = "deployment_id", buckets: int = BUCKETS) -> int:
    """Fold all publishes of ``root`` into one publish in the new folder ``into``, at the
    version reached.  Readers and publishers move there; the old folder can go.  Run it
    while no publisher writes to ``root``."""
    version, covered = committed_version(spark, root), last_publishes(spark, root, key)
    if covered is not None:
        tables = {name: read_published(spark, root, name, key) for name in TABLES}
        _write_publish({n: t for n, t in tables.items() if t is not None}, covered.select(key), into, version, key, buckets)
    return version


def write_dotenv_files(settings: DataFrame, path: str, key: str = "deployment_id") -> None:
    """Write O4's ``.env`` files, one per deployment (``path/<key>=<id>/part-*``).

    Built from :func:`gatewarden.operators.settings.render_dotenv_lines`:
    rows are hash-partitioned by deployment and sorted within partitions by
    (deployment, category, part, line), so each file is streamed out in
    order by its writer task with no per-deployment array in memory.  The
    file bytes equal :func:`render_dotenv`'s text; a deployment without any
    value left gets a file of one blank line in place of its old one.
    Partitions are overwritten dynamically.
    """
    from ..operators.settings import render_dotenv_lines

    (
        render_dotenv_lines(settings, key=key)
        .repartition(key)
        .sortWithinPartitions(key, "cat_ord", "part", "line")
        .select(key, "line")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .text(path)
    )
