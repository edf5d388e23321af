"""Language ID, URL filter, license scan, quality rules, embeddings."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import embedding as E
from gatewarden.llm import langid as I
from gatewarden.llm import licenses as C
from gatewarden.llm import quality as Q
from gatewarden.llm import urlfilter as U

from .conftest import SF, prose

# ---------------------------------------------------------------------------
# Language ID
# ---------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    from gatewarden.llm.queries import op4_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = op4_language_id(spark, SF).join(docs, "doc_id").filter("held_out and n >= 100").collect()
    assert len(got) > 20
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, docs_of):
    rng = random.Random(1)
    a, b = "zug licht schau berg".split(), "peau leur vent mois".split()
    rows = [(i, prose(rng, 60, a), "de") for i in range(30)] + [(100 + i, prose(rng, 60, b), "fr") for i in range(30)]
    rows += [(200, None, "de"), (201, "", "de"), (202, "123 !? ²", "de"), (203, prose(rng, 20_000, b), None), (204, "zug schau licht", None)]
    docs = docs_of(rows)
    known = I.fit(docs, F.col("doc_id") < 1000)
    assert set(known) == {"de", "fr"}
    got = {r.doc_id: r for r in I.detect(docs.select("doc_id", "text"), known).select("doc_id", "lid.*").collect()}
    assert all(got[i].lang_pred == I.UND and got[i].rejected and got[i].score == 0 for i in (200, 201, 202))
    assert got[203].lang_pred == "fr" and got[204].lang_pred == "de"
    assert all(got[i].lang_pred == ("de" if i < 100 else "fr") and not got[i].rejected for i in [*range(30), *range(100, 130)])
    kept = I.filter_languages(docs, known)
    assert kept.columns == docs.columns and {200, 201, 202}.isdisjoint(r.doc_id for r in kept.collect())
    # Nothing learned: nothing told.
    none = I.fit(docs, F.lit(False))
    assert none == {} and all(r.lid.lang_pred == I.UND for r in I.detect(docs, none).collect())
    assert I.detect(docs_of([]), known).count() == 0


def test_dictionaries_are_bounded(spark, docs_of):
    docs = docs_of([(i, "wort " * 5000 + str(i), "de") for i in range(20)])
    known = I.fit(docs, F.lit(True), passages=4, passage_chars=50)
    assert len(known["de"]) <= 4 * 51


# ---------------------------------------------------------------------------
# URL filter
# ---------------------------------------------------------------------------

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "a.net", "/x"),
    ("allow", "a.net", "/x/y/"),
    ("allow", "org", ""),
    ("allow", "twice.org", "/p"),
    ("block", "twice.org", "/p"),
]
URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1?q#f", "https://example.com/en", "https://example.com/en/",
    "https://m.example.com/en/a/b", "https://m.example.com/fr/", "http://x.net/es/1", "http://x.net/esx", "http://a.net/xyz", "http://b.a.net/x/y/z", "http://a.net/x/y",
    "http://org", "http://q.org?x", "http://twice.org/p1", "http://notexample.com/en/", "http://x.net:80/es/", "ftp://com//en/", "a://b://com/", "http://É.com/", "http://com./",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits and url and "://" in url else None
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("max_rules", [100, 3])
def test_url_rules_equal_brute_force(spark, max_rules):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = U.judge_urls(pages, rules, max_rules=max_rules).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id]), URLS[r.page_id]
    assert U.judge_urls(pages.limit(0), rules).count() == 0


# ---------------------------------------------------------------------------
# Licenses
# ---------------------------------------------------------------------------


def test_license_texts_and_notices(spark, docs_of):
    mit = C.TEXTS["MIT"]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2019 A. Body\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE") + "\n"),
        (3, mit + " and more"),
        (4, "Some text. Released under the MIT License. More text.\nThis work is licensed under the GNU General Public Licence, Version 3"),
        (5, "licensed under cc by-nc 4.0"),
        (6, None), (7, ""), (8, "Copyright 2020 X"), (9, "x" * 100_000), (4, "other row, same id"),
        (10, "Released under the MIT License.\n* Released under the MIT License."),
    ]
    got = {}
    for r in C.scan(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.notices, r.n_notices))
    assert got[1] == got[2] == [("MIT", None, 0)] and got[3] == [(None, None, 0)]
    assert sorted(got[4], key=str) == [(None, "GPL-3.0,MIT", 2), (None, None, 0)]
    assert got[5] == [("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1)] and got[10] == [(None, "MIT", 2)]
    assert all(got[i] == [(None, None, 0)] for i in (6, 7, 8, 9))
    digests = {r.doc_id: r.digest for r in C.scan(docs_of(rows)).filter("doc_id in (6, 7, 8)").collect()}
    assert set(digests.values()) == {None}
    assert C.scan(docs_of([])).count() == 0


def test_license_files_with_titles_and_in_one_line(spark, docs_of):
    who = "Copyright (c) 2024 A. Body and others"
    files = [(spdx, f"{C.TITLES[spdx][0]}\n\n{who}\n\n{text}") for spdx, text in [*C.TEXTS.items(), *C.BSD_TEXTS]]
    files.append(("MIT", f"The MIT License (MIT)\n\n{who}\n\n{C.TEXTS['MIT']}"))
    files += [(spdx, " ".join(t.split())) for spdx, t in files] + [(spdx, " ".join(f"{who} {t}".split())) for spdx, t in C.TEXTS.items()]
    files.append((None, f"{who} {C.TEXTS['MIT']} and more"))
    got = {r.doc_id: r.license for r in C.scan(docs_of([(i, t) for i, (_, t) in enumerate(files)])).collect()}
    assert [got[i] for i in range(len(files))] == [spdx for spdx, _ in files]


def test_license_shipped_files(spark, docs_of):
    files = C.file_texts()
    assert {spdx for spdx, _ in files} == {spdx for spdx, _ in C.FILES} and min(len(t) for _, t in files) > 6000
    rows = files + [(spdx, " ".join(t.upper().split())) for spdx, t in files if "Copyright (" not in t] + [(None, t[: len(t) // 2]) for _, t in files]
    got = {r.doc_id: r.license for r in C.scan(docs_of([(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert [got[i] for i in range(len(rows))] == [spdx for spdx, _ in rows]


def test_license_guard_leaves_out_no_known_unit(spark, monkeypatch):
    """With and without the test of beginnings the same units are found."""
    mit = " ".join(C.TEXTS["MIT"].split())
    names = [n for ns in C.NAMES.values() for n in ns]
    heads = ["", "* ", "12) ", "(c) 2020 X ", "Copyright 2020 X. ", "\r", "2020 Copyright X\r", "Ⅷ ", "MIT License Copyright (c) 2020 X ", "the ", "Σ. "]
    tails = ["", ".", "!! ", "\r", " Copyright 2020 X", "\rCopyright 2020 X", " more"]
    known = C.known_texts() + [("one", "ok"), ("two", "MIT"), ("line", mit.replace(". ", ", ")), ("mark", "© of all")]
    bodies = [f.format(n) for f in C.FORMS for n in names[::4]] + ["ok", "mit", "MIT License", known[-2][1], "© of all", "of all", "nothing"]
    rows = [(i, h + b + t) for i, (h, b, t) in enumerate((h, b, t) for h in heads for b in bodies for t in tails)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.notices, r.n_notices) for r in C.scan(docs, known).filter("n_notices > 0").collect())
    with_test = found()
    monkeypatch.setattr(C, "MAX_BEGINNINGS", 1)
    assert found() == with_test and len(with_test) > 500


# ---------------------------------------------------------------------------
# Quality
# ---------------------------------------------------------------------------


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def quality_corpus():
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(5, 200)).replace(" ", "\n" if i % 5 == 0 else " ", 3), rng.choice(["en", "fr"]), rng.choice(["a", "b"])) for i in range(500)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in prose(rng, 80).split()), "en", "a") for i in range(10)]
    rep = prose(rng, 12)
    edge = [(2000, None), (2001, ""), (2002, " \n\t "), (2003, f"{rep}\n" * 30), (2004, rep + " x " + rep + " y " + prose(rng, 100)), (2005, "é" * 30_000 + " 😀 "), (2006, prose(rng, 6000), None, None), (2000, None)]
    return rows + junk + edge


def test_quality_counts_equal_brute_force(spark, docs_of):
    rows = quality_corpus()
    got = Q.judge(docs_of(rows).select("doc_id", "text", "lang", "source", "kept", "score")).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        n, chars, symbols, dup, rep = counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert not any(by[1000 + i].kept for i in range(10))
    clean = [r for r in got if r.doc_id < 1000 and not r.base_failed]
    assert all(r.kept for r in clean) and by[2006].kept
    assert Q.judge(docs_of([])).count() == 0


def test_quality_rejects_plain_faults(spark, docs_of):
    """Symbols at 0.3 to 1 per word, and mostly duplicate lines that no 8-word repeat shows."""
    rng = random.Random(8)
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(8)), "en", "a") for i in range(300)]
    for k, every in enumerate([1, 1, 2, 2, 3, 3]):
        w = prose(rng, 90).split()
        rows.append((1000 + k, " ".join(x + "$" * (j % every == 0) for j, x in enumerate(w)), "en", "a"))
    for k in range(4):  # short lines, alike, between long ones
        lines = [x for _ in range(20) for x in ("ok", prose(rng, 12) if k % 2 and rng.random() < 0.2 else "ok")]
        rows.append((2000 + k, "\n".join([*lines, prose(rng, 300)]), "en", "a"))
    got = {r.doc_id: r for r in Q.judge(docs_of(rows)).collect()}
    assert all(got[i].kept for i in range(300))
    assert not any(r.base_failed or r.kept for i, r in got.items() if i >= 1000)


@pytest.mark.parametrize("bad", [0.35, 0.45])
def test_quality_resists_a_group_of_many_outliers(spark, docs_of, bad):
    rng = random.Random(9)
    n = int(300 * bad)
    rows = [(i, prose(rng, rng.randint(60, 120)), "en", "a") for i in range(300 - n)]
    rows += [(1000 + i, " ".join(w + rng.choice(["$$$", "&&&", "###"]) for w in prose(rng, rng.randint(60, 120)).split()), "en", "a") for i in range(n)]
    got = {r.doc_id: r.kept for r in Q.judge(docs_of(rows)).collect()}
    assert all(got[i] for i in range(300 - n)) and not any(got[1000 + i] for i in range(n))


def test_scatter_resists_outliers(spark):
    """MCD of a contaminated group is that of its clean part; brute-force distance agrees."""
    rng = np.random.default_rng(3)
    d = len(Q.STATS)
    clean = rng.multivariate_normal([1, 2, 0, -1, 1][:d], np.diag([1, 2, 1.5, 1, 1.2][:d]) + 0.4, 800)
    bad = rng.normal(12, 0.5, (150, d))
    rows = [("g", *map(float, x)) for x in np.concatenate([clean, bad])]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{s} double" for s in Q.STATS)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(Q.SALTS)).cast("int"))
    e = Q.estimate(df).first()
    assert all(abs(e[f"m{i}"] - clean.mean(0)[i]) < 0.25 for i in range(d))
    low = np.array([[e[f"l{i}{j}"] if j <= i else 0 for j in range(d)] for i in range(d)])
    scatter = low @ low.T
    x = df.crossJoin(spark.createDataFrame([e]).drop("key")).withColumn("d", Q._distance()).limit(5).collect()
    for r in x:
        v = np.array([r[s] for s in Q.STATS]) - [e[f"m{i}"] for i in range(d)]
        assert math.isclose(r.d, v @ np.linalg.solve(scatter, v), rel_tol=1e-6)
    assert np.linalg.det(scatter) < 4 * np.linalg.det(np.cov(clean.T) + np.diag(np.square(Q.FLOORS)))


def independent_mcd(v):
    """Concentration steps in numpy from the same start, and the reweighted estimate."""
    d, floor = v.shape[1], np.square(Q.FLOORS)
    half, ball = (len(v) + d + 1) // 2, np.random.default_rng(0).normal(size=(400_000, d))
    r = np.square(ball).sum(1)

    def consistent(share):
        return 1 / ball[r <= np.quantile(r, share)].var()

    def distances(m, c):
        return np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c), v - m)

    m = np.median(v, 0)
    c = np.diag(np.square(1.4826 * np.median(np.abs(v - m), 0)) + floor)
    for _ in range(100):
        near = v[np.argsort(distances(m, c), kind="stable")[:half]]
        m, c = near.mean(0), np.cov(near.T, bias=True) * consistent(half / len(v)) + np.diag(floor)
    near = v[distances(m, c) <= np.quantile(r, 0.975)]
    return near.mean(0), np.cov(near.T, bias=True) * consistent(0.975) + np.diag(floor)


def test_estimate_agrees_with_an_independent_one(spark):
    rng = np.random.default_rng(11)
    d = len(Q.STATS)
    v = np.concatenate([rng.multivariate_normal(np.arange(d), np.diag(np.linspace(0.5, 2, d)) + 0.3, 900), rng.normal(9, 1, (200, d))])
    df = spark.createDataFrame([("g", *map(float, x)) for x in v], "key string, " + ", ".join(f"{s} double" for s in Q.STATS)).withColumn("salt", F.lit(0))
    e = Q.estimate(df).first()
    low = np.array([[e[f"l{i}{j}"] if j <= i else 0 for j in range(d)] for i in range(d)])
    centre, scatter = independent_mcd(v)
    assert np.allclose([e[f"m{i}"] for i in range(d)], centre, atol=0.05)
    assert np.allclose(low @ low.T, scatter, atol=0.12)


def test_sources_of_different_spread_judge_the_same_text_differently(spark, docs_of):
    """Capitals: rare and steady in one source, of any share in another."""
    rng = random.Random(12)

    def capitals(share):
        return " ".join(w.capitalize() if rng.random() < share else w for w in prose(rng, 150).split())

    rows = [(i, capitals(0.1), "en", "steady") for i in range(200)] + [(200 + i, capitals(rng.uniform(0.05, 0.9)), "en", "varied") for i in range(200)]
    text = capitals(0.6)
    rows += [(1000, text, "en", "steady"), (1001, text, "en", "varied")]
    got = {r.doc_id: r for r in Q.judge(docs_of(rows)).collect()}
    assert not got[1000].kept and got[1001].kept and got[1000].distance > 4 * got[1001].distance
    assert not got[1000].base_failed and sum(not got[i].kept for i in range(400)) <= 4


# ---------------------------------------------------------------------------
# Embeddings
# ---------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(25, 24))
    rows = []
    for i in range(900):
        rows.append((i, (centres[i % 25] + rng.normal(size=24) * rng.choice([0.05, 0.25, 1.0])).tolist()))
    rows += [(1000 + k, rows[3][1]) for k in range(60)]
    rows += [(1100, (np.array(rows[4][1]) * 1e200).tolist()), (1101, (np.array(rows[4][1]) * 1e-200).tolist())]
    rows += [(1200, None), (1201, []), (1202, [0.0] * 24), (1203, [float("nan")] + [1.0] * 23), (1204, [None] + [1.0] * 23), (1205, [float("inf")] * 24), (1206, [1.0, 2.0]), (1207, [2.0, 4.0]), (1208, [0.0] * 24)]
    return rows


@pytest.mark.parametrize("block", [2048, 40])
def test_embedding_links_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r.vec_id: r for r in E.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    links = {i: 0 for i, _ in rows}
    comp = {i: i for i, _ in rows}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y >= E.COSINE:
                links[i] += 1
                links[j] += 1
                u, v = root(i), root(j)
                comp[max(u, v)] = min(u, v)
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= links[i] for i, r in got.items())
    assert found >= 0.97 * sum(links.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1200, 1201, 1202, 1203, 1204, 1205, 1208))
    assert got[1206].n_links == 1 and got[1207].component_id == 1206
    assert sum(got[i].component_id == root(i) for i in got) >= 0.97 * len(got)


def test_embedding_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_duplicates(df).count() == 0


def test_no_link_is_lost_within_a_probed_list():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + rng.normal(size=(150, 16)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = E.Index(x, 1)
    codes, errors = ix.encode(x, np.zeros(300, int))
    got = {(a, b) for u, v in E.link_block(ix, 0, x, x, codes, errors, E.COSINE) for a, b in zip(u.tolist(), v.tolist())}
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= E.COSINE))}
    assert got == want


@pytest.mark.parametrize("lists", [128, 1024])
def test_recall_with_many_more_lists_than_probes(lists):
    """Pairs at cosine 0.95 to 0.97, hardly above the threshold: either side probes the
    other's own list."""
    rng = np.random.default_rng(4)
    n, d = 8000, 64
    x = E._unit(rng.normal(size=(n, d)))
    aside = rng.normal(size=(n, d))
    aside = E._unit(aside - (aside * x).sum(1, keepdims=True) * x)
    cosine = rng.uniform(0.95, 0.97, (n, 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * aside
    ix = E.Index(np.concatenate([x, y])[rng.permutation(2 * n)[:8192]], lists)
    assert len(ix.centres) == lists > 10 * E.PROBES
    px, py = E._nearest(x, ix.centres, E.PROBES), E._nearest(y, ix.centres, E.PROBES)
    found = (px == py[:, :1]).any(1) | (py == px[:, :1]).any(1)
    print("recall", lists, found.mean())
    assert found.mean() >= 0.97


def test_estimates_keep_their_partitions_from_step_to_step(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"g{k}", *map(float, x)) for k in range(3) for x in np.concatenate([rng.normal(size=(150, len(Q.STATS))), rng.normal(4, 1, (60, len(Q.STATS)))])]
    df = spark.createDataFrame(rows, "key string, " + ", ".join(f"{s} double" for s in Q.STATS)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(Q.SALTS)).cast("int"))
    parts = []

    def counted(frame, cut=Q.cut):
        out = cut(frame)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(Q, "cut", counted)
    monkeypatch.setattr(Q, "STATE_PARTITIONS", 2)
    few = {r["key"]: r for r in Q.estimate(df).collect()}
    assert len(parts) > 4 and max(parts[:-1]) <= 2
    # The salted join of many groups gives the same.
    monkeypatch.setattr(Q, "MAX_BROADCAST_GROUPS", 0)
    many = {r["key"]: r for r in Q.estimate(df).collect()}
    assert set(few) == set(many) == {"g0", "g1", "g2"}
    assert all(math.isclose(few[k][c], many[k][c], rel_tol=1e-9, abs_tol=1e-12) for k in few for c in Q.ESTIMATE)
