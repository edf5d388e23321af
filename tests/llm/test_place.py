"""Packing, sharding and mixing: round trips and laws."""

import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest

from gatewarden.llm import mixing as X
from gatewarden.llm import packing as P
from gatewarden.llm import sharding as S

from .conftest import prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([0, 1, 30, 300, 900])), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200, None), (201, ""), (None, "null id here"), (None, "null id here"), (3, rows[3][1]), (202, "İ ǅ Σας \x1c!\x1c é ½ a<|endoftext|>b " + prose(rng, 5000))]
    return rows


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_word_by_word_ids_equal_whole_text_ids(tokenizer):
    words = P.WordIds(TOKENIZER)
    for _, text, *_ in corpus():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID]
        assert P.token_bytes(text, words) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_word_shapes_take_the_same_ids(tokenizer):
    words = P.WordIds(TOKENIZER)
    for w in ["Hello,", "naïve!?", "ÀÉÎ.", "ÿŸ", "Straße", "ŉ", "İx", "ſt", "ĳ", "ª", "µ.", "don't", "it's,", "...", "a.b", "x1", "ДА", "ﬁ", "e\u0301", "ǅ", "日本。", "Σας", "a" * 300]:
        assert words[w.encode()] == words.packed(tokenizer.encode(w, add_special_tokens=False).ids), w


def test_pack_round_trip(spark, docs_of, tokenizer):
    rows = corpus()
    got = P.pack(docs_of(rows).select("doc_id", "text"), TOKENIZER).collect()
    want = []
    for i, text, *_ in rows:
        data = b"".join(k.to_bytes(4, "little") for k in tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
        step = 4 * P.CAPACITY
        for k in range(0, len(data), step):
            part = data[k : k + step]
            want.append((i, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
    none_last = lambda t: tuple((x is None, x) for x in t)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=none_last) == sorted(want, key=none_last)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    assert len(sequences) <= -(-sum(w[3] for w in want) // P.CAPACITY) + 1


def test_pack_pools_badly_filled_bins_of_several_blocks(spark):
    rng = random.Random(9)
    lengths = [rng.randint(1, 100) for _ in range(600)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    placed = P.pack_lengths(pieces, capacity=100, block=100).collect()
    assert sorted(r.pid for r in placed) == list(range(600))
    used = {}
    for r in placed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + lengths[r.pid]
    assert max(used.values()) <= 100
    assert len(used) <= sum(lengths) / 100 * 1.05


def test_crossover_keeps_every_piece_once():
    rng = random.Random(4)
    island = P.Packer([rng.randint(1, 60) for _ in range(80)], 100, 1)
    a, b = island.fresh(0.0), island.fresh(0.5)
    for child in (island.cross(a, b), island.mutate(a)):
        assert sorted(i for items in child for i in items) == list(range(80))
        assert all(island.fill(items) <= 100 for items in child)


def test_pack_empty_table(spark, docs_of):
    assert P.pack(docs_of([]).select("doc_id", "text"), TOKENIZER).count() == 0


# ---------------------------------------------------------------------------
# Sharding
# ---------------------------------------------------------------------------


def test_shards_follow_the_key_law(spark, docs_of):
    rows = [(i, "x" * (i % 50)) for i in range(6000)] + [(5000, "other text"), (None, None), (None, None)]
    df = S.shard_table(docs_of(rows).select("doc_id", "text"), S.uniform_tree(24), S.uniform_tree(25))
    got = df.collect()
    assert len(got) == len(rows)
    by_key, slots = {}, {}
    for r in got:
        assert by_key.setdefault(r.doc_id, r.shard) == r.shard and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 24
    sizes = [len(v) for v in slots.values()]
    assert min(sizes) > 180 and max(sizes) < 330
    moved = sum(r.grown_shard == 24 for r in got)
    assert 180 < moved < 310
    one = next(r for r in got if r.doc_id == 7)
    assert (one.size, one.text_crc32, one.law) == (15, zlib.crc32(b"x" * 7), "key")
    none = next(r for r in got if r.doc_id is None)
    assert (none.size, none.text_crc32) == (8, 0)


def test_every_further_shard_takes_rows_only_into_itself(spark):
    from pyspark.sql import functions as F

    ids = spark.range(3000)
    trees = [S.uniform_tree(n) for n in (24, 25, 26, 40)]
    rows = ids.select(*[S.assign(F.col("id"), t).alias(f"t{k}") for k, t in enumerate(trees)]).collect()
    assert all(r.t1 in (r.t0, 24) and r.t2 in (r.t1, 25) and (r.t3 == r.t2 or r.t3 >= 26) for r in rows)


def test_changed_weight_moves_rows_only_through_its_subtree(spark):
    from pyspark.sql import functions as F

    def tree(weight):
        rack = lambda n, shards: S.Node(n, tuple(S.Node(f"{n}/{s}", shard=s, leaf_weight=weight if s == 0 else 1.0) for s in shards))
        return S.Node("root", (S.Node("a", (rack("a/0", (0, 1)), rack("a/1", (2, 3)))), S.Node("b", (rack("b/0", (4, 5)),))))

    rows = spark.range(6000).select(S.assign(F.col("id"), tree(1.0)).alias("x"), S.assign(F.col("id"), tree(3.0)).alias("y")).collect()
    # Rows of the other region move only into the changed one; inside it only into the changed rack.
    assert all(r.y in (r.x, 0, 1) or (r.x in (4, 5) and r.y in (2, 3)) for r in rows)
    share = sum(r.y == 0 for r in rows) / 6000
    assert abs(share - 3 / 8) < 0.04


def test_slots_of_a_hot_group_span_several_ranges(spark):
    from gatewarden.llm.common import gapless_rank

    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 900 THEN null ELSE id % 3 END AS g")
    got = gapless_rank(df, ["g"], ["id"], "slot", rows_per_bucket=100).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 4


# ---------------------------------------------------------------------------
# Mixing
# ---------------------------------------------------------------------------


def water_fill(sizes, weights=X.WEIGHTS, share=X.SHARE):
    """Targets by repeated resharing of what exceeds the limits."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, part = sum(w[s] for s in open_), left
        for s in list(open_):
            target[s] += part * w[s] / total
        left = 0.0
        for s in list(open_):
            over = target[s] - 2 * sizes[s]
            if over >= 0:
                left += over
                target[s] -= over
                open_.discard(s)
    return target


def test_mix_meets_targets(spark, docs_of):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = None if i % 9 == 0 else f"s{i % 7 if i % 3 else 0}"
        rows.append((i, prose(rng, rng.choice([1, 5, 20, 80, 300])), "en", source))
    rows += [(1000, None, "en", "s1"), (1001, "", "en", "empty"), (1002, None, "en", "empty"), (7, "same same", "en", "s1"), (7, "same same", "en", "s1")]
    docs = docs_of(rows)
    got = X.mix(docs.select("doc_id", "text", "source")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_fill(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.002 * want[s]), s
    again = X.mix(docs.select("doc_id", "text", "source").repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rates_tilt_with_length(spark):
    """The multipliers meet the constraint and the rates follow the tilt."""
    import math

    from pyspark.sql import functions as F

    cells = spark.createDataFrame([("a", 10, 5), ("a", 100, 2), ("a", 400, 1)], "s string, size long, n long")
    goals = spark.createDataFrame([("a", 650, 400.0, 650 / 8)], "s string, source_size long, target double, mean_size double")
    lam = X.solve(cells.select("s", F.col("size"), "n"), goals).first().lam
    rate = lambda z: 2 / (1 + math.exp(-lam * z / (650 / 8)))
    assert abs(sum(n * z * rate(z) for z, n in ((10, 5), (100, 2), (400, 1))) - 400) < 1e-3
    assert rate(10) > rate(100) > rate(400)


def test_take_repeats_rows(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30), "en", f"s{i % 2}") for i in range(40)] + [(3, "twin row", "en", "s1")] * 2
    docs = docs_of(rows)
    out = X.take(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[(r.doc_id, r.text)] = got.get((r.doc_id, r.text), 0) + 1
    want = {}
    text = {}
    from pyspark.sql import functions as F

    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        text[(r.doc_id, r.h)] = r.text
    for r in X.mix(docs).collect():
        k = (r.doc_id, text[(r.doc_id, r.row)])
        want[k] = want.get(k, 0) + r.copies
    assert got == {k: v for k, v in want.items() if v}


def test_mix_empty_table(spark, docs_of):
    assert X.mix(docs_of([]).select("doc_id", "text", "source")).count() == 0
    assert X.take(docs_of([])).count() == 0


def test_remembered_words_are_bounded_and_give_the_same_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "WORD_CACHE", 8)
    words = P.WordIds(TOKENIZER)
    rng = random.Random(4)
    for _ in range(60):
        text = prose(rng, 30) + " the the, The."
        assert P.token_bytes(text, words) == words.packed(tokenizer.encode(text, add_special_tokens=False).ids + [P.END_ID])
        assert max(map(len, (words, words.words_before, words.runs, words.runs_before))) <= 8
    assert len(words.words_before) == len(words.runs_before) == 8


def test_a_batch_asks_for_each_word_once_and_gives_whole_text_ids(tokenizer):
    asked = []

    class Asked(P.WordIds):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    def expect(texts, words):
        want = [words.packed(tokenizer.encode(t or "", add_special_tokens=False).ids + [P.END_ID]) for t in texts]
        assert list(P.tokens_of(pa.array(texts, pa.string()), words)) == want

    words = Asked(TOKENIZER)
    words.tokenizer = None  # letters and marks need no whole path
    rng = random.Random(6)
    texts = [prose(rng, 200) + " Und.*** und&&& THE| the) naïve$$$ ÄÖ%%%" for _ in range(20)]
    expect(texts, words)
    assert len(asked) == len(set(asked)) < sum(len(t.split()) for t in texts)

    odd = [f"A{chr(c)}S{chr(c)} x{chr(c)} {chr(c)}{chr(c)} '{chr(c)}" for c in range(0x250)]
    odd += ["ΣΑΣ Σ", "İİ I\u0307", "a<|endoftext|>B <|ENDOFTEXT|>", "<|startoftext|>It'S 'Tis don'T", "e\u0301É", "“Quoted” — it’S…", "", None, " \n\t", " a "]
    words = P.WordIds(TOKENIZER)
    expect(odd, words)
    expect(odd[::-1], words)
    expect(["", None], words)
    expect([], words)
    assert list(P.tokens_of(pa.array(["x y", None, "The end", ""]).slice(1, 2), words)) == [P.token_bytes(t, words) for t in (None, "The end")]
