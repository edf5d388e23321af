"""Best-fit packing by a grouping genetic algorithm (operator 2).

Documents become token ids and an end id; only those longer than a sequence are
cut.  Full pieces are sequences of their own.  The rest is dealt by hash into
blocks of bounded size, and several islands evolve packings of each block:

* a chromosome is a list of bins; its fitness is the mean squared fill;
* crossover injects the well-filled bins of one parent whole into the other,
  dissolves the bins there that hold any of the same pieces, and puts the
  displaced pieces back by best fit, longest first;
* mutation dissolves the emptiest and some random bins and refits their pieces;
* after an epoch each island's elite migrates to its neighbour, which goes on
  from both; the best island's packing is the block's.

Pieces of bins that stay badly filled are pooled over all blocks, dealt anew and
evolved again, so that what one block lacks another can give.

Defined results: null or empty text is the end id alone, one piece of length 1;
repeated rows are packed as rows of their own, also with null or equal ids; an
empty table gives an empty result.  Whole texts count, whatever their length.
"""

from __future__ import annotations

import random
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, limit_arrow_batches, table_in_shared_dir

CAPACITY = 2048
END_ID = 0
BLOCK = 8192
ISLANDS = 2
POPULATION = 4
GENERATIONS = 8
WELL_FILLED = 0.995
ROUNDS = 3
#: Words, and runs of them, whose ids a worker remembers: so many newest and as many
#: before them.  Workers live on between tasks, so both fill up, to some 200 MB.
WORD_CACHE = 300_000

Bins = list[list[int]]


def _byte_characters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


#: A character that may change by composing, or by another rule of lower case than Python's.
ODD = re.compile("[^\\x00-\u012f\u0131-\u017f]")


class WordIds(dict):
    """Word -> its token ids as little-endian bytes.

    The tokenizer drops white space and joins nothing across it, so the ids of a
    text are those of its words.  Most words are letters and closing marks, two
    runs that it encodes apart; their lower-case letters below U+0180 need no
    composing and go to its model directly.  All other words take its whole path.

    When the newest words are as many as may be, they become the words before, so the
    usual words stay known while rare ones go.
    """

    #: Neither letters, numbers nor white space.
    MARKS = string.punctuation

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = _byte_characters()
        self.runs: dict[str, bytes] = {}
        self.words_before: dict[bytes, bytes] = {}
        self.runs_before: dict[str, bytes] = {}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def run(self, text: str) -> bytes:
        out = self.runs.get(text)
        if out is None:
            out = self.runs_before.get(text)
            if out is None:
                # Letters and marks of ASCII stand for themselves.
                sign = self.characters
                signs = text if text.isascii() else "".join([sign[b] for b in text.encode()])
                out = self.packed([t.id for t in self.model.tokenize(signs)])
            if len(self.runs) >= WORD_CACHE:
                self.runs, self.runs_before = {}, self.runs
            self.runs[text] = out
        return out

    def __missing__(self, word: bytes) -> bytes:
        out = self.words_before.get(word)
        if out is None:
            out = self.encoded(word)
        if len(self) >= WORD_CACHE:
            self.words_before = dict(self)
            self.clear()
        self[word] = out
        return out

    def encoded(self, word: bytes) -> bytes:
        text = word.decode()
        letters = text.rstrip(self.MARKS)
        if letters.isalpha() and (letters.isascii() or not ODD.search(letters)):
            marks = text[len(letters) :]
            return self.run(letters.lower()) + (self.run(marks) if marks else b"")
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker, kept between its tasks."""
    return WordIds(path)


def tokens_of(texts: pa.Array, words: WordIds) -> Iterator[bytes]:
    """Each text's ids and the end id as little-endian bytes.  A word's ids are asked
    for once a batch, however often it occurs there."""
    texts = texts.fill_null("")
    # The tokenizer ignores case, but not within its added tokens, all of which hold "<|".
    texts = pc.if_else(pc.match_substring_regex(texts, f"{ODD.pattern}|<[|]"), texts, pc.utf8_lower(texts))
    # ASCII white space only, which the tokenizer drops too; empty words have no ids.
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    ids = [words[w] for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    known, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
    word = coded.indices.to_numpy()
    count = size[word]
    ends = np.concatenate([[0], np.cumsum(count)])
    # Where each id stands among the known ones: its word's place and its own in the word.
    data = known[np.repeat(begin[word] - ends[:-1], count) + np.arange(ends[-1])]
    cuts = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    for k in range(len(texts)):
        yield data[cuts[k] : cuts[k + 1]].tobytes() + END_ID.to_bytes(4, "little")


def token_bytes(text: str | None, words: WordIds) -> bytes:
    return next(tokens_of(pa.array([text], pa.string()), words))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece."""
    limit_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    step = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for row, data in enumerate(tokens_of(batch.column("text"), words)):
                for k in range(0, len(data), step):
                    part = data[k : k + step]
                    of.append(row)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(pieces, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


class Packer:
    """One island: packings of the pieces 0..n-1 with the given lengths."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.rng = lengths, capacity, random.Random(seed)
        self.least = -(-sum(lengths) // capacity)

    def fill(self, items: list[int]) -> int:
        size = self.lengths
        return sum(size[i] for i in items)

    def refit(self, bins: Bins, loose: list[int]) -> Bins:
        """Put loose pieces, in the given order, each into the fullest bin with room."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, items in enumerate(bins):
            free = self.capacity - self.fill(items)
            room[free].append(b)
            mask |= 1 << free
        for i in loose:
            need = self.lengths[i]
            fits = mask >> need
            if fits:
                free = need + (fits & -fits).bit_length() - 1
                b = room[free].pop()
                if not room[free]:
                    mask ^= 1 << free
                bins[b].append(i)
            else:
                free, b = self.capacity, len(bins)
                bins.append([i])
            room[free - need].append(b)
            mask |= 1 << (free - need)
        return bins

    def longest_first(self, items, noise: float = 0.0) -> list[int]:
        size, rnd = self.lengths, self.rng.random
        return sorted(items, key=(lambda i: (-size[i] * (1 + noise * rnd()), i)) if noise else (lambda i: (-size[i], i)))

    def fresh(self, noise: float) -> Bins:
        return self.refit([], self.longest_first(range(len(self.lengths)), noise))

    def fitness(self, bins: Bins) -> float:
        return sum((self.fill(b) / self.capacity) ** 2 for b in bins) / max(len(bins), 1)

    def cross(self, one: Bins, other: Bins) -> Bins:
        """The best-filled bins of ``other`` whole, then those of ``one`` without any
        piece of them, then the displaced pieces by best fit."""
        full = [b for b in other if self.fill(b) >= WELL_FILLED * self.capacity]
        if not full:
            full = sorted(other, key=self.fill, reverse=True)[: max(1, len(other) // 2)]
        given = self.rng.sample(full, max(1, len(full) * 3 // 4))
        taken = bytearray(len(self.lengths))
        for b in given:
            for i in b:
                taken[i] = 1
        kept, loose = [], []
        for b in one:
            if any(taken[i] for i in b):
                loose += [i for i in b if not taken[i]]
            else:
                kept.append(list(b))
        return self.refit([list(b) for b in given] + kept, self.longest_first(loose))

    def mutate(self, bins: Bins) -> Bins:
        order = sorted(range(len(bins)), key=lambda b: self.fill(bins[b]))
        gone = set(order[: max(2, len(bins) // 20)]) | set(self.rng.sample(range(len(bins)), min(len(bins), 2 + len(bins) // 20)))
        loose = [i for b in gone for i in bins[b]]
        return self.refit([list(b) for k, b in enumerate(bins) if k not in gone], self.longest_first(loose, 0.3))

    def evolve(self, migrants: list[Bins], population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
        people = list(migrants) or [self.fresh(0.0)]
        people += [self.fresh(0.05 * k) for k in range(1, population - len(people) + 1)]
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(people)), reverse=True)
        born = len(people)
        for _ in range(generations):
            if len(ranked[0][2]) <= self.least:
                break
            one, other = (self.rng.choice(ranked)[2] for _ in range(2))
            for child in (self.cross(ranked[0][2], other), self.mutate(self.cross(one, ranked[0][2]))):
                born += 1
                ranked.append((self.fitness(child), born, child))
            ranked = sorted(ranked, reverse=True)[:population]
        return min((p for _, _, p in ranked), key=len)


def _bins_of(rows: pd.DataFrame) -> dict[int, Bins]:
    """Migrants of an island by the island they come from."""
    out: dict[int, Bins] = {}
    for (origin, _), items in rows.groupby(["origin", "bin"], sort=True)["item"]:
        out.setdefault(origin, []).append(items.tolist())
    return out


def _rows_of(block: int, island: int, pid, lengths, bins: Bins) -> pd.DataFrame:
    item, number, offset = [], [], []
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            item.append(i)
            number.append(b)
            offset.append(at)
            at += lengths[i]
    return pd.DataFrame(
        {"block": block, "island": island, "pid": [pid[i] for i in item], "length": [lengths[i] for i in item], "item": item, "bin": number, "offset": offset}
    )


EVOLVED = "block long, island int, pid long, length long, item long, bin long, offset long"


def _evolve_blocks(loose: DataFrame, blocks: int, capacity: int, islands: int = ISLANDS) -> DataFrame:
    """pid, length -> block, pid, length, bin, offset: the best island of each block."""

    def first(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "pid"], ascending=[False, True])
        lengths, pid = rows["length"].tolist(), rows["pid"].tolist()
        bins = Packer(lengths, capacity, int(key[0] * 31 + key[1])).evolve([])
        return _rows_of(key[0], key[1], pid, lengths, bins)

    def second(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["origin"] == key[1]].sort_values("item")
        lengths, pid = own["length"].tolist(), own["pid"].tolist()
        elites = _bins_of(rows)
        bins = Packer(lengths, capacity, int(key[0] * 31 + key[1] + 7919)).evolve([elites[k] for k in sorted(elites)])
        return _rows_of(key[0], key[1], pid, lengths, bins)

    def best(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.groupby("island")["bin"].max()
        return rows[rows["island"] == sizes.idxmin()]

    dealt = loose.withColumn("block", F.pmod(F.xxhash64("pid", F.lit(blocks)), F.lit(blocks)))
    dealt = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    elite = dealt.groupBy("block", "island").applyInPandas(first, EVOLVED)
    # Each elite goes on in its own island and in the next one.
    moved = elite.withColumn("origin", F.col("island")).withColumn(
        "island", F.explode(F.array_distinct(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))))
    )
    grown = moved.groupBy("block", "island").applyInPandas(second, EVOLVED)
    return grown.groupBy("block").applyInPandas(best, EVOLVED).drop("island", "item")


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """pid, length -> pid, sequence_id, offset."""
    full = pieces.filter(F.col("length") >= capacity)
    placed = full.select("pid", (-F.col("pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.filter(F.col("length") < capacity).select("pid", "length")
    waiting = loose.count()
    for k in range(rounds):
        if not waiting:
            break
        blocks = -(-waiting // block)
        got = cut(_evolve_blocks(loose, blocks, capacity))
        last = k == rounds - 1 or blocks == 1
        fills = got.groupBy("block", "bin").agg(F.sum("length").alias("used"))
        done = fills if last else fills.filter(F.col("used") >= WELL_FILLED * capacity)
        number = F.lit(k << 58) + F.shiftleft(F.col("block"), 20) + F.col("bin")
        placed = placed.unionByName(got.join(done, ["block", "bin"], "left_semi").select("pid", number.alias("sequence_id"), "offset"))
        if last:
            break
        loose = got.join(done, ["block", "bin"], "left_anti").select("pid", "length")
        waiting = loose.count()
    return placed


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, tokenizer, capacity, id_col, text_col)
    # Texts are read once; from here on only lengths move.
    pieces = table_in_shared_dir(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack_lengths(pieces, capacity), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
