"""Embedding near-dedup by product quantisation (operator 10).

Vectors with equal components form one class and are searched once.  A coarse
quantiser, fitted on a bounded sample, deals the classes into inverted lists;
residuals to the list's centre are coded per subspace.  Every class is also a
query: for each of its nearest lists the asymmetric distances to the list's
codes come from look-up tables, and what may lie within the threshold is ranked
by the exact cosine in double precision.

The filter loses nothing within a probed list: with the residual's coding error
e stored beside the code, a true neighbour at distance d has an asymmetric
distance of at most d + e.  Recall rests on the probes alone; a pair is found if
either side probes the other's list.

Lists longer than ``block`` rows are cut into blocks, and queries meet a list
block by block, so a hot list spreads over many tasks.  A task sends back link
counts and a spanning forest of what it linked, not the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths do not link; repeated
rows and equal vectors link with each other.  A null vec_id stays a row of its
own and is nobody's component.  An empty table gives an empty result.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, limit_arrow_batches

COSINE = 0.95
SAMPLE = 16_384
PROBES = 8
LIST_ROWS = 512
SUBSPACES, CODES = 8, 64
BLOCK = 2048
ROUNDS = 12


def _kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by the largest component first, against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n nearest centres of each row, nearest first."""
    n = min(n, len(centres))
    out = np.empty((len(x), n), np.int64)
    half = (centres**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ centres.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        out[i : i + 4096] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return out


class Index:
    """Coarse centres and residual codebooks of vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, lists)
        residual = sample - self.centres[_nearest(sample, self.centres, 1)[:, 0]]
        d = sample.shape[1]
        cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        self.parts = list(zip(cuts[:-1], cuts[1:]))
        self.books = [_kmeans(residual[:, a:b], CODES) for a, b in self.parts]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what the codes leave out."""
        residual = x - self.centres[lists]
        codes = np.stack([_nearest(residual[:, a:b], k, 1)[:, 0] for (a, b), k in zip(self.parts, self.books)], 1)
        back = np.concatenate([k[codes[:, m]] for m, k in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.linalg.norm(residual - back, axis=1)

    def tables(self, q: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of each query's residual to every code, per subspace."""
        r = q - self.centres[which]
        out = np.full((len(q), len(self.parts), CODES), np.inf)
        for m, ((a, b), k) in enumerate(zip(self.parts, self.books)):
            out[:, m, : len(k)] = ((r[:, None, a:b] - k[None]) ** 2).sum(2)
        return out


def link_block(index: Index, which: int, q: np.ndarray, x: np.ndarray, codes: np.ndarray, errors: np.ndarray, cosine: float):
    """(query, row) positions of exact links of a list's rows; unit vectors."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    limit = (reach + errors) ** 2
    for i in range(0, len(q), 256):
        table = index.tables(q[i : i + 256], which)
        far = np.zeros((table.shape[0], len(x)))
        for m in range(codes.shape[1]):
            far += table[:, m, codes[:, m]]
        a, b = np.nonzero(far <= limit)
        for j in range(0, len(a), 65536):
            u, v = a[j : j + 65536], b[j : j + 65536]
            close = np.einsum("ij,ij->i", q[i + u], x[v]) >= cosine
            yield i + u[close], v[close]


def root_of(parent: dict, n: int) -> int:
    while parent.setdefault(n, n) != n:
        parent[n] = parent[parent[n]]
        n = parent[n]
    return n


def _join_all(a: np.ndarray, b: np.ndarray, parent: dict) -> None:
    for u, v in zip(a.tolist(), b.tolist()):
        u, v = root_of(parent, u), root_of(parent, v)
        if u != v:
            parent[max(u, v)] = min(u, v)


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(
        (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    # -0.0 + 0.0 is 0.0, so that equal vectors have equal keys.
    return vectors.select(F.col(id_col).alias("vec_id"), F.when(fine, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = PROBES, block: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    spark = vectors.sparkSession
    limit_arrow_batches(spark)
    rows = cut(_clean(vectors, id_col, vector_col).withColumn("key", F.when(F.col("v").isNotNull(), F.md5(F.to_json("v")))))
    classes = cut(
        rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))
    )
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    share = {d: min(1.0, 2.0 * sample / n) for d, n in sizes.items()}
    index: dict[int, Index] = {}
    for dim, n in sizes.items():
        chosen = classes.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share[dim] * (1 << 20)) + 1))
        x = np.array([r["v"] for r in chosen.select("v").orderBy(F.xxhash64("key")).limit(sample).collect()], float).reshape(-1, dim)
        x = _unit(x)
        index[dim] = Index(x, min(-(-n // LIST_ROWS), len(x) // 8 + 1))
    shared = spark.sparkContext.broadcast(index)

    def deal(batches):
        """Each class once into its own list, with its code, and as a query into its probes."""
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                ix = shared.value[dim]
                x = np.stack(part["v"].to_numpy()).astype(float)
                x = _unit(x)
                lists = _nearest(x, ix.centres, probes)
                codes, errors = ix.encode(x, lists[:, 0])
                for p in range(lists.shape[1]):
                    yield pd.DataFrame(
                        {
                            "dim": dim, "list": lists[:, p], "own": p == 0, "node": part["node"].to_numpy(), "copies": part["copies"].to_numpy(), "home": lists[:, 0],
                            "v": list(x), "codes": [c.tobytes() if p == 0 else b"" for c in codes], "error": errors,
                        }
                    )

    schema = "dim int, list long, own boolean, node long, copies long, home long, v array<double>, codes binary, error double"
    dealt = classes.select("dim", "v", "node", "copies").mapInPandas(deal, schema)
    # A list's rows are cut into blocks, its queries into parts, and each block meets
    # each part: a row is copied to all parts, a query to all blocks.
    lengths = cut(
        dealt.groupBy("dim", "list").agg(
            F.greatest(F.ceil(F.sum(F.col("own").cast("int")) / F.lit(block)), F.lit(1)).cast("int").alias("blocks"),
            F.ceil(F.count(F.lit(1)) / F.lit(4 * block)).cast("int").alias("parts"),
        )
    )
    dealt = dealt.join(lengths, ["dim", "list"])
    row_at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    query_at = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    place = lambda b, p, stored: F.struct(b.alias("block"), p.alias("part"), F.lit(stored).alias("stored"))
    as_row = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(row_at, p, True))
    as_query = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: place(b, query_at, False))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("own"), F.concat(as_row, as_query)).otherwise(as_query)))
    dealt = dealt.select("dim", "list", "to.*", "node", "copies", "home", "v", "codes", "error")

    def search(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        dim, which = int(key[0]), int(key[1])
        ix = shared.value[dim]
        stored, part = part[part["stored"]], part[~part["stored"]]
        if not len(stored) or not len(part):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        x, q = np.stack(stored["v"].to_numpy()), np.stack(part["v"].to_numpy())
        codes = np.stack([np.frombuffer(c, np.uint8) for c in stored["codes"]])
        qn, xn, xc, qc = part["node"].to_numpy(), stored["node"].to_numpy(), stored["copies"].to_numpy(), part["copies"].to_numpy()
        qhome = part["home"].to_numpy()
        forward, backward, parent = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64), {}
        asks = _nearest(x, ix.centres, probes)
        for u, v in link_block(ix, which, q, x, codes, stored["error"].to_numpy(), cosine):
            other = qn[u] != xn[v]
            u, v = u[other], v[other]
            np.add.at(forward, u, xc[v])
            # The stored side counts the query unless it probes the query's list itself.
            lone = ~(asks[v] == qhome[u][:, None]).any(1)
            np.add.at(backward, v[lone], qc[u[lone]])
            _join_all(qn[u], xn[v], parent)
        roots = {n: root_of(parent, n) for n in parent}
        return pd.DataFrame(
            {
                "a": [*qn.tolist(), *xn.tolist(), *roots.keys()],
                "b": [-1] * (len(qn) + len(xn)) + list(roots.values()),
                "n": [*forward.tolist(), *backward.tolist(), *[0] * len(roots)],
            }
        ).query("n > 0 or b >= 0")

    found = cut(dealt.groupBy("dim", "list", "block", "part").applyInPandas(search, "a long, b long, n long"))
    counts = found.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    ids = classes.select("node", "first")
    parts = connected_components(found.filter("b >= 0 and a <> b").select("a", "b"))
    named = ids.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = classes.select("key", "node", "copies").join(named.select("node", "component"), "node").join(least, "component").join(counts, "node", "left")
    known = known.select(F.col("key").alias("k"), "copies", "component_id", F.coalesce("linked", F.lit(0)).alias("linked"))
    out = rows.select("vec_id", "key").join(known, F.col("key") == F.col("k"), "left")
    return out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.col("linked"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
