"""Session helpers.

The library never creates a session implicitly: every operator takes
DataFrames and returns DataFrames.  ``local_session`` exists for tests,
the bench and the driver entry point; on a cluster the caller brings its
own session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on: UTC timestamps (all event times are UTC)
# and adaptive execution (skew-join splitting, partition coalescing).
# Broadcast joins are never chosen from *estimated* sizes (estimates of
# filtered or aggregated inputs can be far off at scale); adaptive execution
# broadcasts a side only after measuring it at runtime below 10 MB.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Of equal keys in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.
    A session that names none must be local: then a folder of this machine serves."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="gatewarden-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gatewarden") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("GATEWARDEN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark
