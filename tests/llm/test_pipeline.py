"""The registered queries and the pipeline on the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from .conftest import SF


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op6_url_filter", "op7_license_scan", "op11_lexical_search", "op12_chat_format", "op13_fill_in_middle"])
def test_query_equals_sql(spark, name):
    from gatewarden.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_stages_take_effect(spark):
    import corpus_pipeline as P
    from gatewarden.llm import linededup, minhash, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        if name != "pack":
            assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "line_dedup":
            assert all(r.kept for r in linededup.line_classes(docs).collect())
            assert docs.filter(F.col("n_chars") != F.char_length("text")).count() == 0
        if name == "near_dedup":
            assert all(r.kept for r in minhash.near_duplicates(docs).collect())
        if name == "source_mix":
            sizes = before.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
            assert abs(docs.select(F.sum(mixing.word_count(F.col("text")))).first()[0] - 1.5 * sizes) < 0.01 * sizes
        if name == "pack":
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
            pieces = docs.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n"))
            rows = before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
            assert pieces.join(rows, "doc_id").filter("n <> m").count() == 0


def test_run_equals_the_stages(spark):
    import corpus_pipeline as P

    out = P.run(spark, SF)
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and out.count() > 0
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5
