"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards with weights; a node's weight is the sum of its
leaves'. A document descends from the root: at each level every child draws
-ln(u) / weight from a hash of document and child, and the least draw wins, so children are
chosen in proportion to weight. A draw depends on its own child alone: where weights change,
documents move only into or out of the subtrees in which they change.

A number of shards has one tree: the first INITIAL shards fill regular regions, and each further
one is a region of its own, so no other node's weight changes and it takes documents only
into itself, however often a tree grows.

Everything is built-in functions; the draws need no shuffle, and their plan has the same size for any
number of nodes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Racks of a region and shards of a rack in the regular part of a tree, and how many shards that part holds at most.
RACKS, PER_RACK, INITIAL = 3, 4, 24


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; shards have a number and a weight of their own."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own

    @property
    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards] if self.children else [self.shard]


def regular_tree(shards: int, racks: int = RACKS, per_rack: int = PER_RACK, weights: dict[int, float] | None = None, initial: int = INITIAL) -> Node:
    """The tree of so many shards: regions of racks x per_rack up to ``initial``, then a region for each further shard.

    Equal to the tree of ``initial`` shards grown one by one. Below ``initial`` what is left over fills a smaller last region.
    """
    weights, size = weights or {}, racks * per_rack
    if shards < 1:
        raise ValueError("a tree needs a shard")
    leaf = lambda s: Node(f"shard{s}", shard=s, own=weights.get(s, 1.0))
    regions = []
    for lo in range(0, min(shards, initial), size):
        part = range(lo, min(lo + size, shards, initial))
        name = f"region{lo // size}"
        regions.append(Node(name, tuple(Node(f"{name}/rack{k}", tuple(map(leaf, part[k * per_rack : (k + 1) * per_rack]))) for k in range(-(-len(part) // per_rack)))))
    tree = Node("root", tuple(regions))
    for s in range(initial, shards):
        tree = grown(tree, weights.get(s, 1.0))
    return tree


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and a rack of its own."""
    s = max(tree.shards) + 1
    leaf = Node(f"shard{s}", shard=s, own=weight)
    return Node(tree.name, (*tree.children, Node(f"region+{s}", (Node(f"region+{s}/rack0", (leaf,)),))))


def _levels(tree: Node) -> list[list[tuple[list[tuple[str, float]], int]]]:
    """For each level and node: its children (name, weight), and the place of the first of them on the level below.

    Children without weight take nothing and are left out; a leaf above the lowest level is its own only child.
    """
    levels, nodes = [], [tree]
    while any(n.children for n in nodes):
        rows, below = [], []
        for n in nodes:
            kids = [c for c in n.children if c.weight > 0] if n.children else [n]
            rows.append(([(c.name, c.weight) for c in kids], len(below)))
            below += kids
        levels.append(rows)
        nodes = below
    return [*levels, [([(str(n.shard), 1.0)], n.shard) for n in nodes]]


def _pick(key: Column, node: Column, rows: list[tuple[list[tuple[str, float]], int]]) -> Column:
    """The place of the drawn child of the node at ``node``, on the level below: -ln(u) / weight is least, u in (0, 1) from 53 bits."""
    names = F.element_at(F.array(*(F.array(*(F.lit(c) for c, _ in kids)) for kids, _ in rows)), node + 1)
    weights = F.element_at(F.array(*(F.array(*(F.lit(float(w)) for _, w in kids)) for kids, _ in rows)), node + 1)
    first = F.element_at(F.array(*(F.lit(at) for _, at in rows)), node + 1)
    unit = lambda name: (F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    draws = F.zip_with(names, weights, lambda name, w: -F.ln(unit(name)) / w)
    return first + F.array_position(draws, F.array_min(draws)).cast("int") - 1


def assign(docs: DataFrame, tree: Node, shard_col: str = "shard", id_col: str = "doc_id") -> DataFrame:
    """``docs``, all rows and columns, with the shard of each row's id.

    Level by level: the region is drawn first, then the rack among that region's racks, then
    the shard among that rack's. A null id is a key of its own. A column that is already called ``shard_col`` is kept as
    ``<shard_col>_before``, with as many underscores more as it takes. No shuffle.
    """
    out, kept = docs, f"{shard_col}_before"
    if shard_col in docs.columns:
        while kept in docs.columns:
            kept += "_"
        out = docs.withColumnRenamed(shard_col, kept)
    key = F.coalesce(F.col(kept if id_col == shard_col else id_col).cast("string"), F.lit("null"))
    *levels, leaves = _levels(tree)
    node = F.lit(0)
    for i, rows in enumerate(levels):
        name = f"_{uuid.uuid4().hex}"  # a level is a column, so that a draw is made once
        out = out.withColumn(name, _pick(key, node, rows))
        out, node = (out.drop(last) if i else out), F.col(name)
        last = name
    out = out.withColumn(shard_col, F.element_at(F.array(*(F.lit(s) for _, s in leaves)), node + 1).cast("int"))
    return out.drop(last) if levels else out


def number(rows: DataFrame, order: list[str], shard_col: str = "shard", slot_col: str = "slot", parts: int | None = None) -> DataFrame:
    """``rows`` with a gapless number from 0 in each shard, by ``order``.

    A shard may hold any share of all rows, so no task numbers a whole shard: rows go to ranges
    of ``order``, each range is numbered by itself, and what lies before a range is added.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, base, local = (f"_{uuid.uuid4().hex}" for _ in range(3))  # no clash with any column
    ranged = written(rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(shard_col, part).count()
    before = Window.partitionBy(shard_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(shard_col, part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(shard_col, part).orderBy(*order)
    numbered = ranged.withColumn(local, F.row_number().over(within) - 1).join(bases, [shard_col, part])
    return numbered.withColumn(slot_col, F.col(base) + F.col(local)).drop(part, base, local)


def write_shards(docs: DataFrame, tree: Node, path: str, files_per_shard: int = 8, id_col: str = "doc_id") -> None:
    """Writes whole rows as Parquet, a folder a shard; rows of a shard go to several files."""
    rows = assign(docs, tree, "shard", id_col)
    salt = F.pmod(F.xxhash64(F.col(id_col), F.lit("file")), F.lit(files_per_shard))
    rows.repartition(files_per_shard * len(tree.shards), "shard", salt).write.partitionBy("shard").parquet(path)
