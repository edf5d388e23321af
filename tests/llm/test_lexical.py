"""Ranked lexical search: against a plain scorer, and the tree's bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    split = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    N, L = sum(bool(ts) for _, ts in split), sum(len(ts) for _, ts in split)
    df = Counter(t for _, ts in split for t in set(ts))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in wanted.items():
        found = []
        for d, ts in split:
            if not ts:
                continue
            m, tf = 100 - 75 + (75 * len(ts) * N) // L, Counter(ts)
            s = sum(c * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, c in terms.items() if t in tf)
            if s > 0:
                found.append((-s, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Ñandú", "日本", "ÀB", "x_y", "it's", "A1"]
    def text():
        low = rng.randint(0, 200)
        return " ".join(rng.choice(words[low : low + 90] + words[:12] + words[-6:]) for _ in range(rng.randint(1, 60)))
    docs = [(i, text()) for i in range(n)]
    items = [(i, text()) for i in range(25)]
    docs += [(n + i, f"{text()} {items[i % 5][1]}") for i in range(40)]
    docs += [(2000 + i, docs[3][1]) for i in range(60)]  # copies: ties by doc_id
    docs += [(3000, None), (3001, ""), (3002, " -- "), (3003, "w1 " * 30_000), (None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1])]
    items += [(30, None), (31, "..."), (32, "nowhere tofind"), (33, docs[3][1]), (0, "w7 w7 w7 again"), (None, "w1 w2 w250 Ñandú")]
    return docs, items


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("score", F.lit("x"))


def test_equals_brute_force(spark, docs_of, items_of, monkeypatch):
    monkeypatch.setattr(lexical, "TREE_ROWS", 100)
    monkeypatch.setattr(lexical, "PIVOTS", 5)
    docs, items = corpus(1)
    assert found(lexical.search(docs_of(docs), items_of(items))) == brute(docs, items)


def test_blocks_of_items(spark, docs_of, items_of, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 2000)
    docs, items = corpus(2, 80)
    assert found(lexical.search(docs_of(docs), items_of(items), k=3)) == brute(docs, items, 3)


def test_empty_tables(spark, docs_of, items_of):
    docs, items = corpus(3, 20)
    assert found(lexical.search(docs_of([]), items_of(items))) == []
    assert found(lexical.search(docs_of(docs), items_of([]))) == []
    assert found(lexical.search(docs_of([(1, None), (2, "--")]), items_of(items))) == []


def test_terms():
    text = "Ab_c d'É 日本 x\u0085y\x00z9\x7fQ[W`e{Ü"
    assert [t.decode() for t in lexical.terms(text)] == TERM.findall(text.translate(LOWER))
    assert lexical.terms(None) == []


def _tree(seed, rows=700, n_terms=120, leaf_rows=16):
    rng = np.random.default_rng(seed)
    w = rng.integers(1, 9000, n_terms)
    centres = [rng.choice(n_terms, 30, replace=False) for _ in range(6)]
    cols = [np.sort(rng.choice(centres[r % 6], rng.integers(1, 15), replace=False)) for r in range(rows)]
    cols[10:200] = [cols[10]] * 190
    start = np.concatenate([[0], np.cumsum([len(c) for c in cols])])
    col = np.concatenate(cols)
    f = rng.integers(10_000, 900_000, len(col))
    f[start[10] : start[200]] = np.tile(f[start[10] : start[11]], 190)
    v = lexical.Vectors(np.arange(rows), start, col, f, np.sqrt(w.astype(float)))
    triples = [(int(i), f"t{t:04}".encode(), int(rng.integers(1, 4))) for i in range(20) for t in rng.choice(centres[i % 6], 8, replace=False)]
    triples += [(99, f"t{t:04}".encode(), 1) for t in range(n_terms)]
    items = lexical.Items(triples)
    return v, w, items, lexical.Queries(items, w), lexical.build(v, n_terms, leaf_rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounds_hold_below_every_node(seed):
    v, w, items, queries, root = _tree(seed)
    every = np.arange(len(items.ids))
    nodes, leaves = [root], 0
    while nodes:
        node = nodes.pop()
        below, todo = [], [node]
        while todo:
            x = todo.pop()
            below += [x] if not x.children else []
            todo += x.children
        top = np.max([queries.scores(x.rows, x.support, every).max(axis=0) for x in below], axis=0)
        assert (queries.bounds(node, every) >= top).all()
        leaves += not node.children
        nodes += node.children
    assert leaves >= 700 / 16


def test_best_first_leaves_subtrees_out():
    v, w, items, queries, root = _tree(4)
    full = queries.scores(v, np.arange(len(w)), np.arange(len(items.ids)))
    best, opened = lexical.search_tree(root, queries, np.ones(len(items.ids), dtype=np.int64), 10)
    for i, heap in enumerate(best.found):
        want = sorted(((-s, d) for d, s in enumerate(full[:, i].tolist()) if s > 0))[:10]
        assert sorted((-s, -d) for s, d in heap) == want
    one, few = lexical.search_tree(root, queries, best.floor, 10, np.array([0]))
    leaves = -(-700 // 16)
    assert few < leaves and sorted(one.found[0]) == sorted(best.found[0])


def test_large_weights_stay_exact():
    triples = [(0, b"a", 10**6), (0, b"b", 3)]
    items = lexical.Items(triples)
    w = np.array([20_001, 19_999])
    queries = lexical.Queries(items, w)
    assert queries.q.dtype == np.int64
    v = lexical.Vectors(np.array([1]), np.array([0, 2]), np.array([0, 1]), np.array([999_983, 777_777]), np.sqrt(w.astype(float)))
    assert queries.scores(v, np.array([0, 1]), np.array([0]))[0, 0] == 20_001 * 10**6 * 999_983 + 3 * 19_999 * 777_777
