"""URL filters: a trie over reversed host labels, then path segments (operator 6).

A rule (host, path, verdict) hangs at the node reached by its host's labels from
the right and then its path's whole segments; what follows the path's last
slash is kept there as an open prefix of the next segment.  A URL walks the trie
once and the deepest rule that fits wins: more host labels first, then the
longer path, so a narrower allow overrides a wider block and the reverse.

The trie is broadcast only up to ``max_rules`` rules.  Beyond that its nodes are
kept as a table: each URL emits its own nodes (labels x segments, bounded by the
URL) and joins them to the rules, with the same result.

Defined results: null url or url without ``://`` -> empty host and path, no rule,
the default verdict.  Two rules for the same host and path: block wins.  Empty
rule list: the default for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_arrow_batches

Rule = tuple[str, str, str]
MAX_BROADCAST_RULES = 200_000
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _split_rule(host: str, path: str) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    *whole, open_prefix = path.split("/")
    return tuple(reversed(host.split("."))), tuple(whole), open_prefix


class Trie:
    """Nested dicts; a label or a segment is a key, ``None`` parts host from path,
    ``0`` holds a node's [(open prefix, rule text, verdict)]."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            labels, whole, rest = _split_rule(host, path)
            node = self.root
            for part in (*labels, None, *whole):
                node = node.setdefault(part, {})
            ends = node.setdefault(0, {})
            ends[rest] = (host + path, "block" if "block" in (verdict, ends.get(rest, (0, ""))[1]) else "allow")

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        segments = path.split("/")
        best: tuple[str | None, str | None] = (None, None)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            branch, found = node.get(None), None
            for i, seg in enumerate(segments):
                if branch is None:
                    break
                fits = [(len(p), e) for p, e in branch.get(0, {}).items() if seg.startswith(p)]
                found = max(fits)[1] if fits else found
                branch = branch.get(seg) if i + 1 < len(segments) else None
            best = found or best
        return best


def _with_trie(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    limit_arrow_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("rule string, verdict string")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for hosts, paths in batches:
            yield pd.DataFrame([trie.match(h, p) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return pages.withColumn("__m", walk("host", "path")).select("page_id", "host", "path", "__m.rule", "__m.verdict")


def _with_node_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The trie as a table of nodes keyed (host, whole segments), hash-joined."""
    r = rules.select(
        F.col("host").alias("nh"),
        F.regexp_extract("path", r"^(.*/)?", 0).alias("np"),
        F.concat("host", "path").alias("rule"),
        F.col("path").alias("rp"),
        "verdict",
    )
    # One row per distinct rule, block before allow.
    r = r.groupBy("nh", "np", "rule", "rp").agg(F.max("verdict").alias("verdict"))
    p = pages.withColumn("__id", F.monotonically_increasing_id())
    labels, segs = F.split("host", r"\."), F.split("path", "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    paths = F.transform(F.sequence(F.lit(0), F.size(segs) - 1), lambda i: F.concat(F.array_join(F.slice(segs, 1, i), "/"), F.when(i > 0, "/").otherwise("")))
    nodes = p.select("__id", "host", "path", F.explode(F.array_distinct(hosts)).alias("nh"), F.array_distinct(paths).alias("ps"))
    nodes = nodes.select("__id", "path", "nh", F.explode("ps").alias("np"))
    hits = nodes.join(r, ["nh", "np"]).filter(F.col("path").startswith(F.col("rp")))
    depth = F.struct(F.char_length("nh").alias("a"), F.char_length("rp").alias("b"), F.col("rule"), F.col("verdict"))
    best = hits.groupBy("__id").agg(F.max(depth).alias("m"))
    return p.join(best, "__id", "left").select("page_id", "host", "path", "m.rule", "m.verdict")


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = DEFAULT, max_rules: int = MAX_BROADCAST_RULES, url_col: str = "url", id_col: str = "page_id"
) -> DataFrame:
    """page_id, host, path, rule (host + path text, else null), verdict.
    ``rules``: columns verdict (allow or block), host, path."""
    p = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    r = rules.select("verdict", "host", "path")
    few = r.limit(max_rules + 1).collect()
    out = _with_trie(p, [tuple(x) for x in few]) if len(few) <= max_rules else _with_node_table(p, r)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
