"""Sharding by a hierarchical weighted hash tree (operator 5).

The tree has regions, racks and shards.  A key descends it: at each node every
child draws ``-ln(u) / weight`` with u from a hash of (key, child), and the
smallest draw wins, so children are chosen in proportion to their weights.  A
child's draw depends on the key and that child alone: if a weight changes, keys
move only into or out of the subtrees on its path, and a new top-level subtree
takes keys only into itself.

Defined results: null keys are one key like any other, equal keys share a shard;
null text counts no bytes.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank

BASE_REGIONS, BASE_RACKS, BASE_SHARDS = 3, 2, 4


@dataclass(frozen=True)
class Node:
    """A named subtree; leaves carry the shard number and the weight."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def uniform_tree(shards: int, regions: int = BASE_REGIONS, racks: int = BASE_RACKS, rack_shards: int = BASE_SHARDS) -> Node:
    """Regions of racks of equal shards.  Shards beyond the layout's own number
    are regions of their own (new capacity comes as a new failure domain), so
    that one more shard takes keys only into itself."""
    base = regions * racks * rack_shards
    tops: list[Node] = []
    for r in range(regions):
        rks = []
        for k in range(racks):
            first = (r * racks + k) * rack_shards
            leaves = tuple(Node(f"shard{s}", shard=s) for s in range(first, min(first + rack_shards, shards)))
            if leaves:
                rks.append(Node(f"region{r}/rack{k}", leaves))
        if rks:
            tops.append(Node(f"region{r}", tuple(rks)))
    for s in range(base, shards):
        tops.append(Node(f"region{regions + s - base}", (Node(f"region{regions + s - base}/rack0", (Node(f"shard{s}", shard=s),)),)))
    return Node("root", tuple(tops))


def _draw(key: Column, name: Column, weight: Column) -> Column:
    # 52 hash bits, the half keeps u inside (0, 1).
    u = (F.shiftrightunsigned(F.xxhash64(key, name), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def assign(key: Column, tree: Node) -> Column:
    """Shard number of a key: one weighted draw among the children of the chosen
    node per level.  The tree is a literal of the plan; a key's cost is its
    depth times the children on its path, not the number of shards."""
    levels: list[dict[str, tuple[Node, ...]]] = []
    front = [tree]
    while any(n.children for n in front):
        levels.append({n.name: n.children for n in front if n.children})
        front = [c for n in front for c in n.children]
    at = F.lit(tree.name)
    for level in levels:
        entries = []
        for name, children in level.items():
            kids = F.array(*[F.struct(F.lit(float(c.weight)).alias("w"), F.lit(c.name).alias("n")) for c in children if c.weight > 0])
            entries += [F.lit(name), kids]
        kids = F.element_at(F.create_map(*entries), at)
        draws = F.transform(kids, lambda c: F.struct(_draw(key, c["n"], c["w"]).alias("d"), c["n"].alias("n")))
        at = F.array_min(draws)["n"]
    leaves = [x for n in front for x in (F.lit(n.name), F.lit(n.shard))]
    return F.element_at(F.create_map(*leaves), at)


def shard_table(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The wide rows are read once and reduced to these few columns; slots are
    numbered by hash ranges of each shard, so no task holds a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        assign(key, tree).cast("int").alias("shard"),
        (assign(key, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return gapless_rank(cut(placed), ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
