"""MinHash near-dedup by improved consistent weighted sampling (operator 1).

A text is the weighted set of its five-word shingles: weight = occurrences in the
text x inverse document frequency.  Consistent weighted samples agree in a
position with the probability of the weighted Jaccard similarity; positions are
banded, texts that share a band are candidates, and candidates are verified by
the exact weighted Jaccard similarity of the whole texts.

The inverse document frequency is ln(1 + texts / frequency); the frequency is the exact
number of distinct texts that hold the shingle, counted for every shingle.  Texts are
dealt to chunks by hash; each chunk sends its distinct shingles, packed and in hash
ranges, to be merged with those of all chunks, and gets back the frequencies of those
that other texts hold too.  No table of shingles is sent to all tasks or the driver.

Equal texts are one class from the start and never paired.

Defined results: null text and text without a word match nothing and are kept;
a text of fewer than five words is one shingle; of a group, the row with the
smallest doc_id stays, and rows alike in doc_id and text count as one row, of
which one stays.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, likely_in, limit_arrow_batches, same, table_in_shared_dir, text_key
from .links import link_components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: A shingle that a quarter of the texts hold weighs 1.
UNIT = np.log1p(4)
#: Five standard deviations of the agreement of BANDS x ROWS samples below 0.8.
MIN_AGREEMENT = 16
#: Bytes of text in a chunk; there are as many hash ranges as chunks, up to MAX_RANGES.
CHUNK_BYTES = 8 << 20
MAX_RANGES = 4096
#: Texts that a task remembers to send equal ones once.
SEEN = 1_000_000
GROUP_BLOCK = 256
WORD_CACHE = 500_000
#: Bytes of a word that are hashed together with those of other words.
LANE_WORD = 64
#: Texts that are sampled together, and (position, shingle) whose values are found together.
SAMPLED = 64
CANDIDATES = 100_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: The first k of eight bytes.
_MASKS = np.array([256**k - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words longer than LANE_WORD bytes."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _step(x: np.ndarray) -> np.ndarray:
    x *= _M1
    x ^= x >> np.uint64(32)
    return x


def word_hashes(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words of a text, all at once: eight bytes of every word, then the
    next eight of those that are longer."""
    raw = b" " + text.encode() + b" " * 8
    octets = np.frombuffer(raw, np.uint8)
    blank = (octets == 32) | (octets - np.uint8(9) < 5)
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    h = _step(sizes.astype(np.uint64) ^ _M2)
    h = _step(h ^ (lanes[starts] & _MASKS[np.minimum(sizes, 8)]))
    at = np.flatnonzero(sizes > 8)
    for k in range(8, LANE_WORD, 8):
        if not len(at):
            break
        h[at] = _step(h[at] ^ (lanes[starts[at] + k] & _MASKS[np.minimum(sizes[at] - k, 8)]))
        at = at[sizes[at] > k + 8]
    for i in at.tolist():
        h[i] = hashes[raw[starts[i] : starts[i] + sizes[i]]]
    return h


def shingles(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the whole text and their counts."""
    w = word_hashes(text or "", hashes)
    if not len(w):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = max(len(w) - WORDS + 1, 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        s ^= w[k : k + n]
        s = _step(s)
    s = _mix(s)
    s.sort()
    new = np.flatnonzero(s[1:] != s[:-1]) + 1
    if len(new) == n - 1:
        return s, np.ones(n, np.int64)
    return s[np.r_[0, new]], np.diff(np.r_[0, new, n])


def idf(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p(documents / frequencies) / UNIT


def pack_frequencies(frequencies: np.ndarray) -> bytes:
    """Frequencies in the order of a text's shingles (most are 1)."""
    return zlib.compress(frequencies.astype("<u8").tobytes(), 1)


def weigh(counts: np.ndarray, packed: bytes, documents: int) -> np.ndarray:
    return counts * idf(np.frombuffer(zlib.decompress(packed), "<u8"), documents)


def lookup(s: np.ndarray, keys: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """Frequencies of the shingles s, 1 of those that are not among the sorted keys."""
    out = np.ones(len(s), np.uint64)
    if len(keys) and len(s):
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        hit = keys[at] == s
        out[hit] = frequencies[at[hit]]
    return out


class Weights:
    """Weights by the frequencies of all shingles that several texts hold."""

    def __init__(self, common: dict[int, int], documents: int):
        self.keys = np.array(sorted(common), np.uint64)
        self.frequencies = np.array([common[int(k)] for k in self.keys], np.uint64)
        self.documents = documents

    def __call__(self, s: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * idf(lookup(s, self.keys, self.frequencies), self.documents)


def _unit(bits: np.ndarray, n: int) -> np.ndarray:
    """Numbers of n bits as fractions between 0 and 1, neither included."""
    return (bits.astype(float) + 0.5) * 2.0**-n


def _parts(s: np.ndarray, log_w: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(s), chunk):
        yield s[i : i + chunk], log_w[i : i + chunk]


class Sampler:
    """Consistent weighted samples.  The variates of (shingle, position) are r and c of
    Gamma(2, 1) and a uniform beta; the value at weight 1, a = c exp(-r (1 - beta)), is
    Exp(1).  They are drawn from a on: given a, c - a is Exp(1), and so is r - log(c / a),
    which leaves 1 - beta = log(c / a) / r.  a rises with a 64-bit hash, so shingles of
    weight 1 need no more than the hash; and as a value never falls when its weight does,
    shingles of less weight need the other variates only where their a is near the least."""

    def __init__(self, positions: int = BANDS * ROWS):
        self.seeds = _mix(np.arange(1, positions + 1, dtype=np.uint64) * _M1)
        self.room = np.empty((2, 0), np.uint64)

    def hashes(self, s: np.ndarray) -> np.ndarray:
        """The hashes of a (position, shingle), valid until the next call.  The shingles are
        mixed already."""
        size = len(self.seeds) * len(s)
        if self.room.shape[1] < size:
            self.room = np.empty((2, size), np.uint64)
        x, y = (room[:size].reshape(len(self.seeds), len(s)) for room in self.room)
        np.bitwise_xor(self.seeds[:, None], s[None, :], out=x)
        x *= _M2
        np.right_shift(x, np.uint64(32), out=y)
        x ^= y
        x *= _M3
        return x

    def values(self, x: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the values, and the levels, by the hashes of a."""
        a = -np.log1p(-_unit(x >> np.uint64(12), 52))
        y = _mix(x ^ _M1)
        e1, e2 = -np.log(_unit(y >> np.uint64(32), 32)), -np.log(_unit(y & np.uint64(0xFFFFFFFF), 32))
        z = np.log1p(e1 / a)
        r = z + e2
        beta = 1 - z / r
        t = np.floor(log_w / r + beta)
        # At weight 1 the level is 0 and the value is a, without rounding.
        return np.where(log_w == 0, np.log(a), np.log(a + e1) - r * (t - beta) - r), np.where(log_w == 0, 0, t)

    def candidates(self, s: np.ndarray, log_w: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Positions, shingles, hashes and logarithms of weights: in every position the
        shingle of the least value is among them."""
        rows = np.arange(len(self.seeds))
        low = np.full(len(rows), ~np.uint64(0))
        plain = log_w == 0
        n_plain = int(plain.sum())
        if n_plain:
            least = np.zeros(len(rows), np.uint64)
            for part, _ in _parts(s[plain], log_w, chunk):
                x = self.hashes(part)
                at = x.argmin(1)
                own = x[rows, at]
                least = np.where(own <= low, part[at], least)
                low = np.minimum(low, own)
            yield rows, least, low, np.zeros(len(rows))
        if n_plain == len(s):
            return
        few = n_plain * 8 < (log_w < 0).sum()
        for part, lw in _parts(s[~plain], log_w[~plain], chunk):
            x = self.hashes(part)
            light, bound = lw < 0, low
            if few and light.any():
                xs = x[:, light]
                at = xs.argmin(1)
                own = xs[rows, at]
                near = np.exp(self.values(own, lw[light][at])[0] + 1e-6)
                # The hash of that value, with room for rounding; doubles end at 2**64 - 2048.
                low = np.minimum(low, np.minimum(-np.expm1(-near) * 2.0**64, 2.0**64 - 2048).astype(np.uint64))
                bound = np.maximum(low, own)
            row, col = np.nonzero((x <= bound[:, None]) | ~light)
            yield row, part[col], x[row, col], lw[col]

    def many(self, texts: list[tuple[np.ndarray, np.ndarray]], chunk: int = 512) -> np.ndarray:
        """A row of samples for each of some texts, given as (shingles, weights)."""
        positions = len(self.seeds)
        best = np.full(len(texts) * positions, np.inf)
        out = np.zeros(len(best), np.uint64)
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            slot, part, x, lw = (np.concatenate(c) for c in zip(*held))
            held.clear()
            value, level = self.values(x, lw)
            order = np.lexsort((value, slot))
            first = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]
            first = first[value[first] < best[slot[first]]]
            best[slot[first]] = value[first]
            out[slot[first]] = _mix(part[first] + level[first].astype(np.int64).astype(np.uint64) * _M1)

        waiting = 0
        for k, (s, w) in enumerate(texts):
            for row, *rest in self.candidates(s, np.log(w), chunk):
                held.append((row + k * positions, *rest))
                waiting += len(row)
                if waiting > CANDIDATES:
                    settle()
                    waiting = 0
        if held:
            settle()
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(len(texts), positions)

    def __call__(self, s: np.ndarray, w: np.ndarray, chunk: int = 512) -> np.ndarray:
        return self.many([(s, w)], chunk)[0]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def worded(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def chunks_of(docs: DataFrame, text: Column, size: int) -> DataFrame:
    """chunk, key, text of the texts with a word; of equal texts one for each task, all
    in one chunk.  size: bytes of all texts, or more."""
    chunk = F.pmod(F.xxhash64("key"), F.lit(max(-(-size // CHUNK_BYTES), 1))).cast("int")
    rows = docs.filter(worded(text)).select(text_key(text).alias("key"), text.alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            fresh = []
            for k in batch.column("key").to_pylist():
                fresh.append(k not in seen)
                seen.add(k)
            if len(seen) > SEEN:
                seen.clear()
            yield batch.filter(pa.array(fresh))

    return rows.select(chunk.alias("chunk"), "key", "text").mapInArrow(first, "chunk int, key string, text string")


def shared_frequencies(chunks: DataFrame, size: int) -> DataFrame:
    """chunk, s, f: the shingles of a chunk (sorted, packed) that several distinct texts
    of the table hold, with the number of those texts; some rows a chunk."""
    ranges = min(max(-(-size // CHUNK_BYTES), 1), MAX_RANGES)

    def lists(part: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        texts = part.drop_duplicates("key")["text"]
        s, n = np.unique(np.concatenate([shingles(t, hashes)[0] for t in texts]), return_counts=True)
        of = ((s >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(of, np.arange(ranges + 1))
        chunk, rows = int(part["chunk"].iloc[0]), []
        for r, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
            if lo < hi:
                rows.append((r, chunk, s[lo:hi].astype("<u8").tobytes(), n[lo:hi].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["range", "chunk", "s", "n"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        s = np.concatenate([np.frombuffer(b, "<u8") for b in part["s"]])
        n = np.concatenate([np.frombuffer(b, "<u4") for b in part["n"]])
        _, at = np.unique(s, return_inverse=True)
        f = np.bincount(at, n)[at].astype("<u8")
        rows, lo = [], 0
        for chunk, b in zip(part["chunk"], part["s"]):
            hi = lo + len(b) // 8
            several = f[lo:hi] > 1
            if several.any():
                rows.append((chunk, s[lo:hi][several].tobytes(), f[lo:hi][several].tobytes()))
            lo = hi
        return pd.DataFrame(rows, columns=["chunk", "s", "f"])

    packed = chunks.groupBy("chunk").applyInPandas(lists, "range int, chunk int, s binary, n binary")
    return packed.groupBy("range").applyInPandas(merge, "chunk int, s binary, f binary")


def unpacked(part: Any) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their frequencies from packed rows (s, f)."""
    s = np.concatenate([np.empty(0, "<u8"), *[np.frombuffer(b, "<u8") for b in part["s"]]])
    f = np.concatenate([np.empty(0, "<u8"), *[np.frombuffer(b, "<u8") for b in part["f"]]])
    order = np.argsort(s)
    return s[order], f[order]


def text_size(docs: DataFrame, text: Column) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def common_shingles(docs: DataFrame, text_col: str = "text") -> Weights:
    """The exact frequencies of all shingles that several texts hold, on the driver: for
    tables that it can hold.  :func:`near_duplicates` leaves them distributed."""
    text = F.col(text_col)
    documents = docs.filter(worded(text)).select(text_key(text)).distinct().count()
    size = text_size(docs, text)
    s, f = unpacked(shared_frequencies(chunks_of(docs, text, size), size).select("s", "f").toPandas())
    return Weights(dict(zip(s.tolist(), f.tolist())), documents)


def signatures(docs: DataFrame, documents: int, text_col: str = "text") -> DataFrame:
    """key (the text's digest), sig and f (packed frequencies of its shingles) of every
    distinct text with a word; documents: their number."""
    text = F.col(text_col)
    size = text_size(docs, text)
    chunks = chunks_of(docs, text, size)
    rare = float(idf(np.ones(1), documents)[0])

    def sign(part: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        hashes, sampler, known, rows, samples = WordHashes(), Sampler(), unpacked(shared), [], []
        part = part.drop_duplicates("key")
        for i in range(0, len(part), SAMPLED):
            weighted = []
            for key, t in zip(part["key"].iloc[i : i + SAMPLED], part["text"].iloc[i : i + SAMPLED]):
                s, c = shingles(t, hashes)
                f = lookup(s, *known)
                # In units of the rarest, as samples do not depend on the unit.
                weighted.append((s, np.where(f == 1, c, c * idf(f, documents) / rare)))
                rows.append((key, pack_frequencies(f)))
            samples.extend(sampler.many(weighted))
        return pd.DataFrame(rows, columns=["key", "f"]).assign(sig=pd.Series(samples, dtype=object))[["key", "sig", "f"]]

    shared = shared_frequencies(chunks, size)
    return chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(sign, "key string, sig array<int>, f binary")


def block_links(left: list, right: list, threshold: float) -> Iterator[tuple[int, int]]:
    """Links between two blocks of (node, component, shingles, weights), enough to
    connect what is alike; ``left is right`` for a block with itself.

    The sum of minima is at most the inner product of the weights' roots (equal
    where they are), which matrix products give for all pairs over the shingles
    that occur in both blocks; only pairs that pass are compared exactly.
    """
    bound = np.zeros((len(left), len(right)), np.float64)
    a, b = (np.concatenate([x[2] for x in side]) for side in (left, right))
    vocabulary = np.intersect1d(a, b)
    for i in range(0, len(vocabulary), 8192):
        part = vocabulary[i : i + 8192]
        dense = []
        for side in (left, right):
            m = np.zeros((len(side), len(part)), np.float32)
            for k, (_, _, s, w) in enumerate(side):
                lo, hi = np.searchsorted(s, part[0]), np.searchsorted(s, part[-1], "right")
                at = np.searchsorted(part, s[lo:hi])
                hit = part[np.minimum(at, len(part) - 1)] == s[lo:hi]
                m[k, at[hit]] = np.sqrt(w[lo:hi][hit])
            dense.append(m)
        bound += dense[0] @ dense[1].T
    total = np.array([x[3].sum() for x in left])[:, None] + np.array([x[3].sum() for x in right])[None, :]
    rows, cols = np.nonzero(bound * (1 + 1e-4) + 1e-6 >= threshold / (1 + threshold) * total)
    parent: dict = {}

    def root(c):
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for i, j in zip(rows.tolist(), cols.tolist()):
        x, y = left[i], right[j]
        cx, cy = root(x[1]), root(y[1])
        if cx != cy and similarity(x[2:], y[2:]) >= threshold:
            parent[cx] = cy
            yield x[0], y[0]


class Verifier:
    """Exact tests of whole texts, for pairs and for groups of class nodes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, documents: int, text_col: str, threshold: float):
        self.docs, self.classes, self.documents, self.text_col, self.threshold = docs, classes, documents, text_col, threshold

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures do not rule out the threshold."""
        sig = lambda n, s: self.classes.select(F.col("node").alias(n), F.col("sig").alias(s))
        agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
        return pairs.join(sig("a", "sa"), "a").join(sig("b", "sb"), "b").filter(agree >= MIN_AGREEMENT).select("a", "b")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """node, text, f (its packed frequencies) of some class nodes, written once."""
        need = cut(nodes.distinct().join(self.classes.select("node", F.col("key").alias("k"), "f"), "node"))
        texts = self.docs.select(text_key(F.col(self.text_col)).alias("key"), F.col(self.text_col).alias("text"))
        # A filter drops most other texts before they are shuffled, and copies are met before the join.
        texts = likely_in(texts, "key", need.select("k"), need.count()).groupBy("key").agg(F.any_value("text").alias("text"))
        return table_in_shared_dir(texts.join(need, F.col("key") == F.col("k")).select("node", "text", "f"), "texts")

    def pairs(self, pairs: DataFrame) -> DataFrame:
        documents, threshold = self.documents, self.threshold

        @F.pandas_udf("boolean")
        def alike(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            hashes, last, left = WordHashes(), None, None
            for columns in batches:
                out = []
                for x, fx, y, fy in zip(*columns):
                    if x != last:
                        s, c = shingles(x, hashes)
                        last, left = x, (s, weigh(c, fx, documents))
                    s, c = shingles(y, hashes)
                    out.append(similarity(left, (s, weigh(c, fy, documents))) >= threshold)
                yield pd.Series(out, dtype=bool)

        pairs = cut(self.likely(pairs))
        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb"), F.col("f").alias("fb")), "b")
        both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta"), F.col("f").alias("fa")), "a")
        return both.filter(alike("ta", "fa", "tb", "fb")).select("a", "b")

    def groups(self, groups: DataFrame, block: int = GROUP_BLOCK) -> DataFrame:
        """Links among the members (centre, node, component) of each group that are in
        different components.  A group is cut into blocks and each pair of blocks is
        one task's work, so a hot group spreads and no pair leaves a task but links."""
        documents, threshold = self.documents, self.threshold
        per = groups.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        per = per.filter("lo < hi").select("centre", F.ceil(F.col("n") / F.lit(float(block))).cast("int").alias("blocks"))
        rows = cut(groups.join(per, "centre"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.join(self.texts(rows.select("node")), "node").select(
            "centre", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "component", "text", "f"
        )

        def test(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
            hashes, sides = WordHashes(), {}
            for own, node, component, text, f in zip(part["own"], part["node"], part["component"], part["text"], part["f"]):
                s, c = shingles(text, hashes)
                sides.setdefault(own, []).append((node, component, s, weigh(c, f, documents)))
            left, right = sides.get(key[1], []), sides.get(key[2], [])
            found = list(block_links(left, right, threshold)) if left and right else []
            return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

        return rows.groupBy("centre", "bi", "bj").applyInPandas(test, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, key, class_id (smallest doc_id of the group), copy_id (smallest doc_id
    with the very same text) and kept, for every row."""
    limit_arrow_batches(docs.sparkSession)
    text = F.col(text_col)
    rows = table_in_shared_dir(docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), worded(text).alias("worded")), "keys")
    copies = cut(rows.filter("worded").groupBy("key").agg(F.min("doc_id").alias("copy_id")))
    documents = copies.count()
    signed = signatures(docs, documents, text_col)
    classes = table_in_shared_dir(copies.join(signed, "key").withColumn("node", F.monotonically_increasing_id()), "signatures")
    bands = F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    members = classes.select(F.explode(bands).alias("bucket"), "node", F.lit(True).alias("index"))
    exact = Verifier(docs, classes, documents, text_col, threshold)
    parts, _ = link_components(members, exact.pairs, exact.groups)
    named = classes.join(parts, "node", "left").select("key", "copy_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min(F.struct("copy_id", "key")).alias("first"))
    known = named.join(least, "component").select(
        F.col("key").alias("k"), "copy_id", F.col("first.copy_id").alias("class_id"), (F.col("key") == F.col("first.key")).alias("stays")
    )
    out = rows.select("doc_id", "key", (~F.col("worded")).alias("bare")).join(known, F.col("key") == F.col("k"), "left")
    return out.select(
        "doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        (F.col("bare") | (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("copy_id")))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies; columns as given.  Rows are told apart by
    (doc_id, text); of several rows alike in both, one stays where the text has words."""
    found = near_duplicates(docs, id_col, text_col).filter("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    tag = uuid.uuid4().hex
    found = cut(found.select(F.col("doc_id").alias(f"i{tag}"), F.col("key").alias(f"k{tag}"), F.col("n").alias(f"n{tag}")))
    key = text_key(F.col(text_col))
    kept = docs.withColumn(f"t{tag}", key).join(found, same(F.col(id_col), F.col(f"i{tag}")) & (F.col(f"t{tag}") == F.col(f"k{tag}")))
    many = (F.col(f"n{tag}") > 1) & worded(F.col(text_col))
    once = kept.filter(many).dropDuplicates([f"i{tag}", f"k{tag}"])
    return kept.filter(~many).unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
