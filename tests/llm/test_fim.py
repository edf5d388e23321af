"""Fill-in-the-middle: against an independent brute force, and round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gatewarden.llm import fim


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(seed=5, n=400):
    rng = random.Random(seed)
    alphabet = ["a", "Zq", " ", "\n", "\r\n", "é", "ñ", "日", "😀", "é", "\x00", " ", "<", ">", "<P", "S>", "M", "7", ".", "\\1", "\x7f", "ÿ"]
    out = [None, "", "<P>", "a<S>b", "x<M>", "<", ">", "P>", "<P", "�", "word", "ÿ"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_equals_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id here"), (3, "a<S>b"), (7, "repeated row"), (7, "repeated row"), (-5, "below zero")]
    got = fim.fill_in_middle(docs_of(rows)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr(brute(i, t)) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_restores_every_text(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(texts(9, 600))]
    out = fim.fill_in_middle(docs_of(rows)).withColumn("again", fim.restore(F.col("output"), F.col("form")))
    assert {r.doc_id: r.again for r in out.collect()} == {i: t or "" for i, t in rows}


def test_slices_of_long_texts(spark, docs_of, monkeypatch):
    long = "Ab ñ. " * 600_000
    rows = [(0, long), (1, "short"), (2, long[:1_500_000]), (3, long), (4, None), (5, "x")]
    got = {r.doc_id: tuple(r) for r in fim.fill_in_middle(docs_of(rows)).collect()}
    for i, t in rows:
        assert got[i] == brute(i, t)


def test_slice_bounds():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * k for k in (10, fim.SLICE_BYTES, 5, fim.SLICE_BYTES + 9, 1, 1)]})
    assert [p.num_rows for p in fim._slices(batch)] == [1, 1, 1, 1, 2]
    assert not list(fim._slices(batch.slice(0, 0)))


def test_shares_and_empty_table(spark, docs_of):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to part").alias("text"))
    forms = {r.form: r["count"] for r in fim.fill_in_middle(docs).groupBy("form").count().collect()}
    assert 320 <= forms["plain"] <= 480 and 620 <= forms["spm"] <= 820
    never = fim.fill_in_middle(docs, plain_from=100, spm_below=0)
    assert [r.form for r in never.select("form").distinct().collect()] == ["psm"]
    assert fim.fill_in_middle(docs_of([])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_seed_moves_the_cuts(spark, docs_of, seed):
    rows = [(i, "one two three four five six seven") for i in range(50)]
    got = fim.fill_in_middle(docs_of(rows), seed=seed).collect()
    d = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in range(50)]
    assert [r.form == "plain" for r in sorted(got)] == [int(x[16:24], 16) % 100 >= 90 for x in d]
