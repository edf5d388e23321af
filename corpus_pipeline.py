"""The corpus pipeline: documents through five of the training-data operators.

Stages, in order: language ID (rows that it rejects go), line dedup, MinHash
near-dedup (one document of each group stays), mixing sources to target weights
(rows are taken 0, 1 or 2 times) and best-fit packing.  Each stage takes
(spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm import langid, linededup, minhash, mixing, packing
from gatewarden.llm.common import table_in_shared_dir
from gatewarden.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows whose language is not told: no letter, or a narrow margin."""
    return langid.filter_languages(docs, langid.fit(docs, langid.in_training(F.col("doc_id"))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay where they occur first."""
    return linededup.dedup_lines(docs, short=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("pack", pack)]

#: Compression, consistent samples, Newton steps and seeded searches have no SQL
#: form; tests hold the run against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table_in_shared_dir(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
