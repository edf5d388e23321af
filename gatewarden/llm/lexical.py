"""Ranked lexical search by an exact sparse ball tree (operator 11).

A document is a sparse vector over terms, ``f = (1000000000*tf) div (1000*tf + 8*m)``
with ``m = 25 + ((75*n*N) div L)``; an item is the vector of its terms' weights
``w = floor(1000*ln((2N+2)/(2df+1)))`` times their counts.  The score is their inner
product, all of it in integers but the logarithm.

The documents are read once: each becomes its terms that any item holds (others add
nothing to any score), and N, L and df are counted over all documents.  Documents
near the same pivot (a bounded sample, ``PIVOTS``) form a cell; a cell is cut into
trees of about ``TREE_ROWS`` documents, which tasks work on one by one.  A tree
halves its documents along the line between two far ones down to leaves of
``LEAF_ROWS``; each node holds its centroid, its radius and, as the centroid's
non-zero terms, the terms that occur below it.  For every document x below a node

    q.x <= q.c + |q restricted to the node's terms| * radius

The right side is rounded up by more than floating point can lose (``SLACK``).  Nodes
are opened best-first, and a subtree is left out for an item only where its bound lies
below a score that ``k`` documents of the item reach already.  First each item is
searched in one tree of its nearest cell; the scores found there are the bounds that
all trees start from, so most trees return only rows that can still be among the best.

Items beyond ``BLOCK_CELLS`` (items x their terms) are searched in blocks.

Defined results: null text has no terms; a document without terms isn't counted in N
and is never found; rows of one item_id are one item, their terms together; an item
without terms or hits has no row.  Rows of one doc_id are documents each; a null
doc_id comes after all others at equal score.  Other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import limit_arrow_batches, table_in_shared_dir

K = 10
PIVOTS = 64
TREE_ROWS = 4096
LEAF_ROWS = 64
#: Items x distinct terms of one block, as one dense matrix of doubles (64 MB).
BLOCK_CELLS = 8_000_000
#: Documents x terms held as one dense matrix while cells are told (16 MB).
DENSE_CELLS = 2_000_000
#: Relative allowance on every bound; sums of up to 10^6 products lose below 10^-9.
SLACK = 1e-8
#: Beyond it doubles don't hold every integer, so leaves count in 64-bit integers.
EXACT = 1 << 53

#: Bytes that no term holds become blanks, A-Z small letters; bytes of longer UTF-8
#: sequences stay.
_FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_VECTORS = "doc_id long, n long, term array<int>, tf array<int>"
_HITS = "item int, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and all beyond ASCII; only A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --- items ---------------------------------------------------------------------


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term, count) of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, counts = [], [], []
            for i, text in zip(b[0].to_pylist(), b[1].to_pylist()):
                for term, c in Counter(terms(text)).items():
                    ids.append(i)
                    words.append(term)
                    counts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["item_id", "term", "count"])

    rows = items.select(F.col(item_col).cast("long"), F.col(text_col)).mapInArrow(cut, "item_id long, term binary, count long")
    return rows.groupBy("item_id", "term").agg(F.sum("count").alias("count"))


class Items:
    """A block of items: ids, and their terms as (term, item, count) triples."""

    def __init__(self, rows: list[tuple[int | None, bytes, int]]):
        self.ids = sorted({r[0] for r in rows}, key=lambda x: (x is not None, x or 0))
        self.terms = sorted({bytes(r[1]) for r in rows})
        number, at = {i: k for k, i in enumerate(self.ids)}, {t: k for k, t in enumerate(self.terms)}
        self.triples = np.array(sorted((at[bytes(t)], number[i], c) for i, t, c in rows), dtype=np.int64).reshape(-1, 3)

    def weights(self, n_docs: int, df: dict[int, int]) -> np.ndarray:
        w = [weight(n_docs, df[t]) if t in df else 0 for t in range(len(self.terms))]
        return np.array(w, dtype=np.int64)


# --- documents -----------------------------------------------------------------


def _vectors(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """Each document with a term: n and its counts of the block's terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(shared.value)}
        for b in batches:
            ids, sizes, cols, tfs = [], [], [], []
            for i, text in zip(b[0].to_pylist(), b[1]):
                words = terms(text.as_py())
                if words:
                    found = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                    ids.append(i)
                    sizes.append(len(words))
                    cols.append([t for t, _ in found])
                    tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cols, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                ["doc_id", "n", "term", "tf"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, _VECTORS)


class Vectors:
    """Sparse rows: doc, row starts, columns, exact integers f and scaled doubles x."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, col: np.ndarray, f: np.ndarray, scale: np.ndarray):
        self.doc, self.start, self.col, self.f = doc, start, col, f
        self.x = f * scale[col]
        self.scale = scale

    def __len__(self) -> int:
        return len(self.doc)

    def rows_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def take(self, rows: np.ndarray) -> Vectors:
        length = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(start[-1]) + np.repeat(self.start[rows] - start[:-1], length)
        return Vectors(self.doc[rows], start, self.col[at], self.f[at], self.scale)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows_of(), self.x * dense[self.col], len(self))

    def squares(self) -> np.ndarray:
        return np.bincount(self.rows_of(), self.x * self.x, len(self))


def to_vectors(table: pa.Table | pa.RecordBatch, n_docs: int, n_terms: int, w: np.ndarray) -> Vectors:
    """Batches of ``_VECTORS`` with f in place; terms of weight 0 add nothing and go."""
    ids = [NULL_DOC if i is None else i for i in table["doc_id"].to_pylist()]
    n = np.asarray(table["n"].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table["n"].to_numpy())
    m = np.array([25 + (75 * int(x) * n_docs) // n_terms for x in n], dtype=np.int64)
    length = np.array([len(x) for x in table["term"]], dtype=np.int64)
    flat = [np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in _chunks(table[name])] or [np.array([], np.int32)]) for name in ("term", "tf")]
    col, tf = flat[0].astype(np.int64), flat[1].astype(np.int64)
    row = np.repeat(np.arange(len(n)), length)
    keep = w[col] > 0
    col, tf, row = col[keep], tf[keep], row[keep]
    f = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
    start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int64)
    return Vectors(np.array(ids, dtype=np.int64), start, col, f, np.sqrt(w.astype(float)))


def _chunks(column) -> list:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


#: Stands for a null doc_id inside a tree: after all others.
NULL_DOC = (1 << 63) - 1


# --- tree ----------------------------------------------------------------------


class Node:
    __slots__ = ("rows", "support", "centre", "radius", "children")

    def __init__(self, rows: Vectors, n_terms: int):
        self.rows, self.children = rows, ()
        sums = np.bincount(rows.col, rows.x, n_terms)
        self.support = np.flatnonzero(np.bincount(rows.col, minlength=n_terms))
        centre = sums / max(len(rows), 1)
        squares, inner = rows.squares(), rows.dot(centre)
        c2 = float(centre @ centre)
        # |x - c|^2 with what the subtraction of large numbers may lose added.
        apart = squares - 2 * inner + c2 + SLACK * SLACK + 1e-11 * (squares + 2 * inner + c2)
        self.radius = math.sqrt(max(float(apart.max(initial=0.0)), 0.0))
        self.centre = centre[self.support]

    def split(self, n_terms: int) -> None:
        """Halves along the line between the row farthest from the centroid and the
        row farthest from that one; equal rows may part, which costs nothing."""
        rows = self.rows
        squares = rows.squares()

        def apart(dense: np.ndarray) -> np.ndarray:
            return squares - 2 * rows.dot(dense)

        dense = np.zeros(n_terms)
        dense[self.support] = self.centre
        ends = []
        for _ in range(2):
            far = rows.take(np.array([int(np.argmax(apart(dense)))]))
            dense = np.zeros(n_terms)
            dense[far.col] = far.x
            ends.append(dense)
        order = np.argsort(rows.dot(ends[0] - ends[1]), kind="stable")
        half = len(order) // 2
        self.children = tuple(Node(rows.take(np.sort(part)), n_terms) for part in (order[:half], order[half:]))
        self.rows = None


def build(rows: Vectors, n_terms: int, leaf_rows: int = LEAF_ROWS) -> Node:
    root = Node(rows, n_terms)
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        if len(node.rows) > leaf_rows:
            node.split(n_terms)
            open_nodes += node.children
    return root


class Queries:
    """Items as columns: integer weights q, and doubles scaled against the documents'."""

    def __init__(self, items: Items, w: np.ndarray):
        shape = (len(items.terms), len(items.ids))
        t, i, c = items.triples.T
        exact = int(np.bincount(i, (w[t] * c).astype(float), shape[1]).max(initial=0)) * 1_000_000 < EXACT // 2
        self.q = np.zeros(shape, dtype=float if exact else np.int64)
        self.q[t, i] = w[t] * c
        self.scaled = np.zeros(shape)
        self.scaled[t, i] = np.sqrt(w[t].astype(float)) * c
        self.squares = self.scaled**2

    def bounds(self, node: Node, of: np.ndarray) -> np.ndarray:
        """No document below the node scores more, for each of the items."""
        at = np.ix_(node.support, of)
        straight = node.centre @ self.scaled[at]
        length = np.sqrt(self.squares[at].sum(axis=0))
        return (straight + length * node.radius) * (1 + SLACK) + 1

    def scores(self, leaf: Vectors, support: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact scores, documents x items."""
        dense = np.zeros((len(leaf), len(support)), dtype=self.q.dtype)
        dense[leaf.rows_of(), np.searchsorted(support, leaf.col)] = leaf.f
        return (dense @ self.q[np.ix_(support, of)]).astype(np.int64)


class Best:
    """The k best (score, doc) of each item so far; ``floor`` is a score that k
    documents reach (here or elsewhere), 1 where there are fewer."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, np.maximum(floors, 1)
        self.found: list[list[tuple[int, int]]] = [[] for _ in floors]

    def add(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        heap = self.found[item]
        for d, s in zip(docs.tolist(), scores.tolist()):
            entry = (s, -d)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.floor[item] = max(self.floor[item], heap[0][0])


def search_tree(root: Node, queries: Queries, floors: np.ndarray, k: int, of: np.ndarray | None = None) -> tuple[Best, int]:
    """Best-first over nodes; also the number of leaves opened."""
    best, opened, tie = Best(floors, k), 0, 0
    every = np.arange(len(floors)) if of is None else of

    def live(node: Node, items: np.ndarray) -> tuple[float, int, Node, np.ndarray, np.ndarray] | None:
        nonlocal tie
        bound = queries.bounds(node, items)
        stays = bound >= best.floor[items]
        if not stays.any():
            return None
        tie += 1
        items, bound = items[stays], bound[stays]
        return (-float((bound / best.floor[items]).max()), tie, node, items, bound)

    heap = [x for x in [live(root, every)] if x]
    while heap:
        _, _, node, items, bound = heapq.heappop(heap)
        items = items[bound >= best.floor[items]]
        if not len(items):
            continue
        if node.children:
            for child in node.children:
                entry = live(child, items)
                if entry:
                    heapq.heappush(heap, entry)
            continue
        opened += 1
        scores = queries.scores(node.rows, node.support, items)
        for j in np.flatnonzero((scores >= best.floor[items]).any(axis=0)):
            rows = np.flatnonzero(scores[:, j] >= best.floor[items[j]])
            best.add(int(items[j]), node.rows.doc[rows], scores[rows, j])
    return best, opened


# --- jobs ----------------------------------------------------------------------


def _with_cells(vectors: DataFrame, shared) -> DataFrame:
    """Each row with the number of its nearest pivot (largest cosine, first of equals)."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, w, n_docs, n_terms = shared.value
        for b in batches:
            step = max(1, DENSE_CELLS // len(pivots))
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                v = to_vectors(part, n_docs, n_terms, w)
                dense = np.zeros((len(v), len(pivots)))
                dense[v.rows_of(), v.col] = v.x
                yield part.append_column("cell", pa.array((dense @ pivots).argmax(axis=1).astype(np.int32)))

    return vectors.mapInArrow(nearest, f"{_VECTORS}, cell int")


def _search(cells: DataFrame, shared, k: int) -> DataFrame:
    """The rows of each (cell, part) as a tree: what it finds at or above the floors."""

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        items, w, n_docs, n_terms, floors, only = shared.value
        of = None if only is None else np.array(only[key[0].as_py()], dtype=np.int64)
        rows = to_vectors(table, n_docs, n_terms, w)
        order = np.argsort(rows.doc, kind="stable")
        best, _ = search_tree(build(rows.take(order), len(items.terms)), Queries(items, w), floors, k, of)
        out = [(i, -d, s) for i, heap in enumerate(best.found) for s, d in heap]
        docs = pa.array([None if d == NULL_DOC else d for _, d, _ in out], pa.int64())
        return pa.table([pa.array([x[0] for x in out], pa.int32()), docs, pa.array([x[2] for x in out], pa.int64())], names=["item", "doc_id", "score"])

    return cells.select("doc_id", "n", "term", "tf", "cell", "part").groupBy("cell", "part").applyInArrow(search, _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(spark: SparkSession, docs: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame:
    words = spark.sparkContext.broadcast(items.terms)
    vectors = table_in_shared_dir(_vectors(docs, words, id_col, text_col), "lexical-vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.t: r.c for r in vectors.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()}
    w = items.weights(n_docs, df)

    # Pivots: the sample's directions, by a hash of the rows.
    sample = vectors.filter(F.size("term") > 0).orderBy(F.xxhash64("doc_id", "term"), "doc_id").limit(PIVOTS).toArrow()
    at = to_vectors(sample, max(n_docs, 1), max(n_terms, 1), w)
    pivots = np.zeros((len(items.terms), max(len(at), 1)))
    pivots[at.col, at.rows_of()] = at.x / np.maximum(np.sqrt(at.squares()), 1e-300)[at.rows_of()]
    shape = spark.sparkContext.broadcast((pivots, w, max(n_docs, 1), max(n_terms, 1)))
    cells = table_in_shared_dir(_with_cells(vectors.filter(F.size("term") > 0), shape), "lexical-cells")
    # At most PIVOTS rows.
    sizes = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // TREE_ROWS))]), F.col("cell")) if sizes else F.lit(1)
    cells = cells.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int"))

    # One tree of each item's nearest cell gives the scores that all trees start from.
    nearest = (Queries(items, w).scaled.T @ pivots).argmax(axis=1)
    only: dict[int, list[int]] = {}
    for item, cell in enumerate(nearest.tolist()):
        only.setdefault(cell, []).append(item)
    none = np.ones(len(items.ids), dtype=np.int64)
    first = cells.filter(F.col("cell").isin(list(only)) & (F.col("part") == 0))
    begun = _best(_search(first, spark.sparkContext.broadcast((items, w, max(n_docs, 1), max(n_terms, 1), none, only)), k), k)
    floors = none.copy()
    # At most one row for each item of the block.
    for r in begun.filter(F.col("rank") == k).collect():
        floors[r.item] = r.score
    hits = _search(cells, spark.sparkContext.broadcast((items, w, max(n_docs, 1), max(n_terms, 1), floors, None)), k)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(items.ids)], "item int, item_id long")
    return _best(hits, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    entries = table_in_shared_dir(_item_terms(items, item_col, item_text_col), "lexical-items")
    n_items, n_entries = entries.agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), F.count(F.lit(1))).first()
    per_block = max(1, math.isqrt(BLOCK_CELLS * n_items // max(n_entries, 1)))
    blocks = max(1, -(-n_items // per_block))
    out = None
    for b in range(blocks):
        rows = entries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if rows or blocks == 1:
            found = _search_block(spark, docs, Items([tuple(r) for r in rows]), k, id_col, text_col)
            out = found if out is None else out.unionByName(found)
    return out
