"""MinHash near-dedup, line dedup and the grouping behind them, against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from .conftest import prose
from pyspark.sql import functions as F

from gatewarden.llm import linededup as L
from gatewarden.llm import minhash as M
from gatewarden.llm.common import _nearest, connected_components, cut, likely_in
from gatewarden.llm.links import link_components, shared_buckets


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(1)
    nodes = range(60)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, i) for i in range(40, 50)] + [(3, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(nodes, pairs)
    assert {n: got.get(n, n) for n in nodes} == want


def test_link_components_lose_no_link(spark):
    """Numbers link if they differ by 1; buckets are loose, so stars alone would miss links."""
    nodes = [1, 2, 3, 4, 10, 11, 13, 20, 22]
    members = spark.createDataFrame([(b, n, True) for n in nodes for b in (n // 10, 100 + n % 3)], "bucket long, node long, index boolean")
    parts, _ = link_components(members, lambda p: p.filter(F.abs(F.col("a") - F.col("b")) == 1))
    got = {r.node: r.component for r in parts.collect()}
    assert {n: got.get(n, n) for n in nodes} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 13: 13, 20: 20, 22: 22}


def test_a_filter_keeps_all_rows_of_its_keys(spark):
    rows = spark.createDataFrame([(k if k % 50 else None, f"t{k}", "x") for k in range(3000)], "k long, text string, __x string")
    for column, n in (("k", 700), ("text", 40), ("k", 0)):
        keys = rows.select(column).filter(f"{column} is not null").limit(n)
        want = {r[0] for r in keys.collect()}
        got = likely_in(rows, column, keys, n)
        assert got.columns == rows.columns
        found = [r[column] for r in got.collect()]
        assert len(found) == len(set(found)) and want <= set(found) and len(found) <= len(want) + 0.1 * 3000
    assert likely_in(rows, "k", rows.select("k"), 10**12) is rows


def test_the_driver_gets_no_table_of_shared_buckets(spark, monkeypatch):
    """What is broadcast are bits; the buckets found are the same."""
    members = spark.range(40_000).select(F.floor(F.col("id") / 2).alias("bucket"), F.col("id").alias("node"), F.lit(True).alias("index"))
    members = members.unionByName(spark.range(9).select((-F.col("id")).alias("bucket"), F.lit(77).cast("long").alias("node"), F.lit(True).alias("index")))
    sizes = []
    monkeypatch.setattr(F, "broadcast", lambda df, f=F.broadcast: sizes.append(df.count()) or f(df))
    got = shared_buckets(members).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("centre").alias("c")).collect()
    assert max(sizes, default=0) <= 200
    assert len(got) == 20_000 and all((r.n, r.c) == {0: (3, 77), 38: (2, 77)}.get(r.bucket, (2, 2 * r.bucket)) for r in got)


def test_rounds_of_components_join_by_one_number(spark):
    """So that a join that becomes a broadcast takes no whole pages of the driver."""
    edges = cut(spark.range(200).select(F.col("id").alias("u"), F.floor(F.col("id") / 7).alias("v")))
    near = _nearest(edges, 4)
    assert sorted(tuple(r) for r in near.collect()) == [(u, u // 7, u // 7) for u in range(200)]
    keys = re.findall(r"(?:BroadcastHash|SortMerge)Join (?:\(skew=true\) )?\[([^\]]*)\]", near._jdf.queryExecution().executedPlan().toString())
    assert keys and all("," not in k for k in keys)


# ---------------------------------------------------------------------------
# MinHash
# ---------------------------------------------------------------------------


def corpus():
    rng = random.Random(5)
    rows = []
    for k in range(60):
        rows.append((k, prose(rng, rng.choice([8, 60, 200]))))
    base = prose(rng, 150).split()
    for k in range(60, 100):  # one group of edited copies
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, rows[3][1]) for k in range(5)]  # exact copies
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "one two"), (305, "x" * 50_000 + " " + prose(rng, 3000)), (1, rows[1][1])]
    return rows


def test_minhash_classes_equal_brute_force(spark, docs_of):
    rows = corpus()
    docs = docs_of(rows)
    got = M.near_duplicates(docs.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    weights = M.common_shingles(docs)
    hashes = M.WordHashes()
    sets = {}
    for i, t in rows:
        s, c = M.shingles(t, hashes)
        if len(s):
            sets[i] = (s, weights(s, c))
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if M.similarity(sets[a], sets[b]) >= M.SIMILARITY]
    want = components([i for i, _ in rows], pairs)
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_drop_near_duplicates_keeps_one_row_and_the_columns(spark, docs_of):
    rows = corpus()
    docs = docs_of(rows)
    kept = M.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # Repeated rows count as one; texts without a word all stay.
    assert ids.count(1) == 1 and {300, 301, 302} <= set(ids) and 303 in ids and 304 not in ids
    assert not set(range(200, 205)) & set(ids)


def test_minhash_empty_table(spark, docs_of):
    assert M.near_duplicates(docs_of([]).select("doc_id", "text")).count() == 0
    assert M.drop_near_duplicates(docs_of([])).count() == 0


def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    s = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    a, b = (s[:300], wa), (s[100:], wb)
    sampler = M.Sampler(2000)
    agree = (sampler(*a) == sampler(*b)).mean()
    assert abs(agree - M.similarity(a, b)) < 0.05
    # Samples do not depend on how a long text is cut into parts.
    assert (sampler(*a, chunk=7) == sampler(*a)).all()


def test_words_up_to_64_bytes_are_hashed_together():
    """Shingles are told apart by their words alone, which are no longer looked up one by one."""
    rng = random.Random(7)
    words = ["a", "b", "a\0", "a\0\0", "é", "né", "\u2003", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 63, "x" * 64, "y" + "x" * 63, "\x1c", "x" * 32 + "y"]
    hashes, of, back = M.WordHashes(), {}, {}
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        s, c = M.shingles(rng.choice(["", " ", "\n\t"]) + "".join(w + rng.choice([" ", "\n", "\x0b\x0c ", "\r\n"]) for w in text), hashes)
        want = [tuple(text[k : k + M.WORDS]) for k in range(max(len(text) - M.WORDS + 1, 1))]
        assert (np.diff(s.astype(object)) > 0).all() if len(s) > 1 else len(s) == 1
        assert sorted(c.tolist()) == sorted(want.count(x) for x in set(want))
        for x in want:
            h = M.shingles(" ".join(x), hashes)[0]
            assert len(h) == 1 and h[0] in s
            assert of.setdefault(x, int(h[0])) == int(h[0]) and back.setdefault(int(h[0]), x) == x
    assert not hashes
    a, b, c = (int(M.shingles(w, hashes)[0][0]) for w in ("x" * 65, "x" * 66, "x" * 64 + "y"))
    assert len({a, b, c, of.get(("x" * 64,))}) >= 3 and len(hashes) == 3
    assert [len(v) for v in M.shingles(None, hashes)] == [0, 0] and [len(v) for v in M.shingles(" \n\x0b", hashes)] == [0, 0]


def test_values_are_found_only_near_the_least(monkeypatch):
    """Samples are those of the least value of all shingles, though few values are computed."""
    rng = np.random.default_rng(4)
    sampler, seen = M.Sampler(), []
    values = M.Sampler.values
    monkeypatch.setattr(M.Sampler, "values", lambda self, x, lw: seen.append(x.size) or values(self, x, lw))
    texts = []
    for n in (1, 2, 30, 700):
        s = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        for w in (np.ones(n), rng.uniform(0.05, 1, n), np.where(rng.random(n) < 0.1, 0.5, 1.0), rng.uniform(0.1, 4, n)):
            texts.append((s, w))
    got = sampler.many(texts)
    for (s, w), samples in zip(texts, got):
        value, level = values(sampler, sampler.hashes(s).copy(), np.log(w)[None, :])
        at = value.argmin(1)
        level = level[np.arange(len(at)), at].astype(np.int64).astype(np.uint64)
        assert (samples == (M._mix(s[at] + level * M._M1) >> np.uint64(32)).astype(np.uint32).view(np.int32)).all()
    seen.clear()
    sampler(*texts[-4])
    sampler(*texts[-2])
    # 700 shingles in 36 positions: 25,200 pairs each.
    assert sum(seen) < 300


def test_common_shingles_are_counted_exactly(spark, docs_of):
    rows = [(i, "a b c d e" + (f" x{i} y z w" if i % 2 else f" q{i}")) for i in range(20)]
    w = M.common_shingles(docs_of(rows).repartition(3))
    s, _ = M.shingles("a b c d e", M.WordHashes())
    assert int(s[0]) in set(w.keys.tolist())
    assert w(s, np.array([1])) == pytest.approx([np.log1p(1) / np.log1p(4)])


# ---------------------------------------------------------------------------
# Lines
# ---------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_matches_table(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "é", "😀"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", L.edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == min(edits(r.a, r.b), L.MAX_EDITS + 1), r


def line_corpus():
    rng = random.Random(11)
    stems = [prose(rng, rng.randint(4, 14)) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(s))
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
            lines.append("  " * rng.randint(0, 1) + "".join(s))
        rows.append((i, "\n".join(lines + rng.choice([[], ["short"], [""]]))))
    rows += [(100, None), (101, ""), (102, rows[5][1]), (102, rows[5][1]), (103, "z" * 60_000), (104, "z" * 59_999)]
    return rows


def test_line_classes_equal_brute_force(spark, docs_of):
    rows = line_corpus()
    got = L.line_classes(docs_of(rows).select("doc_id", "text")).collect()
    where = {}
    for i, t in set(rows):
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if len(line) >= L.MIN_CHARS:
                where.setdefault(line, []).append((i, k))
    lines = sorted(where)
    near = [
        (a, b)
        for a, b in itertools.combinations(lines, 2)
        if abs(len(a) - len(b)) <= L.MAX_EDITS and (len(a) > 1000 or edits(a, b) <= L.MAX_EDITS)
    ]
    want = components(lines, near)
    at = {p: want[line] for line, ps in where.items() for p in ps}
    got_at = {(r.doc_id, r.line_no): r.class_id for r in got if r.class_id is not None}
    assert set(got_at) == set(at)
    names = {}
    for p, c in got_at.items():  # the same partition, under other names
        assert names.setdefault(c, at[p]) == at[p]
    assert len(set(names.values())) == len(names)
    first = {}
    for p in sorted(at):
        first.setdefault(at[p], p)
    assert {(r.doc_id, r.line_no): r.kept for r in got if r.class_id is not None} == {p: first[c] == p for p, c in at.items()}
    assert all(r.kept for r in got if r.class_id is None)


def test_dedup_lines_drops_lines_and_documents(spark, docs_of):
    a, b, c = "the first line, long enough", "another line of some length", "a third line that is unique"
    rows = [(1, f"{a}\n{b}\nend"), (2, f"{b}\n{c}\nend"), (3, f"{a}\nend"), (4, "end"), (5, None), (6, f"{c}x\n{c}")]
    docs = docs_of(rows)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (f"{c}\nend", len(c) + 4), 4: ("end", 3), 5: (None, 0)}


def test_short_lines_of_its_own_keep_a_document(spark, docs_of):
    a = "a notice that many documents share"
    verse = "\n".join(f"verse {i}" for i in range(30))
    rows = [(1, f"{a}\nend"), (2, f"{a}\n{verse}\nend"), (3, f"{a}\n\nend"), (4, f"{a}\nひとつ")]
    got = {r.doc_id: r.text for r in L.dedup_lines(docs_of(rows)).collect()}
    assert got == {1: rows[0][1], 2: f"{verse}\nend", 4: "ひとつ"}


def test_short_lines_are_classes_by_equality(spark, docs_of):
    rows = [(1, "Menu\n\n one \nMenu"), (2, "Menu\nMenü\none"), (3, "Menu"), (4, "\n"), (5, "日本語\n日本語です")]
    got = {(r.doc_id, r.line_no): (r.class_id, r.kept) for r in L.line_classes(docs_of(rows), short=True).collect()}
    assert {k for k, (c, _) in got.items() if c is None} == {(1, 1), (4, 0), (4, 1)}
    assert {k for k, (_, kept) in got.items() if not kept} == {(1, 3), (2, 0), (2, 2), (3, 0)}
    assert got[1, 0][0] == got[2, 0][0] != got[2, 1][0] and got[5, 0][0] != got[5, 1][0]
    out = {r.doc_id: r.text for r in L.dedup_lines(docs_of(rows), short=True).collect()}
    assert out == {1: "Menu\n\n one ", 2: "Menü", 4: "\n", 5: "日本語\n日本語です"}


def test_lines_empty_table(spark, docs_of):
    assert L.line_classes(docs_of([]).select("doc_id", "text")).count() == 0
    assert L.dedup_lines(docs_of([])).count() == 0


def test_edit_distance_of_trimmed_pairs(spark):
    rng = random.Random(12)
    pairs = [("", ""), ("", "ab"), ("aaaa", "aaaaa"), ("abcabc", "abc"), ("x" * 70, "x" * 72), ("日本語日本語", "日本日本語")]
    for _ in range(600):
        a = [rng.choice("ab日😀") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice([[], ["z"], ["a"]])
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, x string, y string")
    got = {r.i: r.d for r in L.differing(df).withColumn("d", L.edit_distance(F.col("x"), F.col("y"))).collect()}
    want = {r.i: min(r.d, 3) for r in df.withColumn("d", F.levenshtein("x", "y")).collect()}
    assert got == want


def test_lines_that_share_a_segment_meet_in_finer_buckets(spark, docs_of, monkeypatch):
    """Hundreds of lines of one length share their beginning, middle or end: the classes
    of brute force, with far fewer candidates than pairs."""
    from gatewarden.llm import links

    monkeypatch.setattr(links, "HOT_INDEX", 4)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    lines = []
    for k in range(240):
        mid = word(14)
        lines.append([f"shared opening words {mid}{word(7)}", f"{mid}{word(7)} shared closing word", f"{mid[:10]} shared middle of it {word(11)}"][k % 3])
    for line in lines[:60]:
        s = list(line)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice([[], ["z"], ["q"]])
        lines.append("".join(s))
    seen = []
    verifier = L._verifier
    monkeypatch.setattr(L, "_verifier", lambda *a: lambda pairs: (seen.append(pairs.count()), verifier(*a)(pairs))[1])
    got = {r.doc_id: r.class_id for r in L.line_classes(docs_of(list(enumerate(lines))).select("doc_id", "text")).collect()}

    def near(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            prev = row
        return prev[-1] <= L.MAX_EDITS

    distinct = sorted(set(lines))
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if abs(len(a) - len(b)) <= 2 and near(a, b):
            parent[root(a)] = root(b)
    for (i, a), (j, b) in itertools.combinations(enumerate(lines), 2):
        assert (got[i] == got[j]) == (root(a) == root(b))
    assert sum(seen) < 3000  # all pairs that share a segment: about 100 * 100 / 2 for each of three


def test_every_shingle_weighs_by_the_texts_that_hold_it(spark, docs_of, monkeypatch):
    """Frequencies far below a quarter of the texts count, over any number of chunks."""
    monkeypatch.setattr(M, "CHUNK_BYTES", 2000)
    rng = random.Random(8)
    shared = prose(rng, 60)
    notice = [(i, shared + " " + " ".join(f"own{i}w{k}" for k in range(8))) for i in range(30)]
    rows = notice + [(100 + i, prose(rng, 80)) for i in range(300)] + [(500, notice[0][1]), (600, None), (601, " ")]
    docs = docs_of(rows).repartition(3)
    w = M.common_shingles(docs)
    s, c = M.shingles(" ".join(shared.split()[:5]), M.WordHashes())
    assert w.documents == 330
    assert w(s, c) == pytest.approx([np.log1p(330 / 30) / np.log1p(4)])
    # Alike by plain counts, told apart by what only one of them holds.
    a, b = (M.shingles(t, M.WordHashes()) for _, t in notice[:2])
    assert M.similarity(a, b) > 0.7 > 0.6 > M.similarity((a[0], w(*a)), (b[0], w(*b)))
    got = {r.doc_id: r.class_id for r in M.near_duplicates(docs.select("doc_id", "text"), threshold=0.7).collect()}
    assert got == {i: 0 if i == 500 else i for i, _ in rows}


def test_the_documents_are_read_three_times(spark, docs_of, monkeypatch):
    """Two passes find the shared buckets and one the texts of their lines, however many
    steps compare lines."""
    calls = []
    monkeypatch.setattr(L, "table_in_shared_dir", lambda df, name, f=L.table_in_shared_dir: calls.append(name) or f(df, name))
    L.line_classes(docs_of(line_corpus()).select("doc_id", "text")).collect()
    assert calls == ["lines"]


def test_buckets_of_a_line_are_hashes_of_its_segments(spark):
    from pyspark.sql import functions as F

    lines = ["abcdefghijklmnopqrstu", "äbcdéfghijklmnöpqrstuv", "日本語" * 8]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "node long, line string")
    got = {(r.node, r.bucket, r["index"]) for r in L.probes(df, 2).collect()}
    want = []
    for k, x in enumerate(lines):
        for shorter in range(3):
            n = len(x) - shorter
            cuts = [n // 3 * i + max(i - (3 - n % 3), 0) for i in range(4)]
            for i in range(3):
                for shift in range(max(-i, shorter - (2 - i)), min(i, shorter + 2 - i) + 1):
                    want.append((k, n, i, x[cuts[i] + shift : cuts[i + 1] + shift], shorter == 0 and shift == 0))
    rows = spark.createDataFrame(want, "node long, n int, i int, part string, own boolean")
    assert got == {tuple(r) for r in rows.select("node", F.xxhash64("n", "i", "part"), "own").collect()} and len(want) == 36
