"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At every level each child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child, and the lowest
draw wins, so children get rows in proportion to their weights.  A draw depends on
nothing but key, child and that child's weight: when weights change, rows move only
into or out of subtrees whose weight changed, and the draws below an unchanged node stay.

The key alone decides (law ``key``).  ``Tree.grown`` adds a shard as a region of its own,
so no node above an old shard changes its weight and all rows that move go to the new
shard.  Folding such regions into larger ones is a new tree and moves rows like one.

Rows with a null key share one place.  Equal keys share a shard, whatever their other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyview.llm.common import without


@dataclass(frozen=True)
class Tree:
    """Leaves ``(region, rack, shard, weight)``; an inner node weighs what its leaves weigh."""

    leaves: tuple[tuple[int, int, int, float], ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int, weight: float = 1.0) -> Tree:
        """``racks`` per region, ``shards`` per rack, numbered through from 0."""
        return Tree(tuple(
            (r, r * racks + k, (r * racks + k) * shards + s, weight)
            for r in range(regions) for k in range(racks) for s in range(shards)
        ))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own."""
        return Tree((*self.leaves, tuple(max(leaf[i] for leaf in self.leaves) + 1 for i in range(3)) + (weight,)))

    def weighing(self, shard: int, weight: float) -> Tree:
        """The same tree with another weight for one shard; 0 drains it."""
        return Tree(tuple((r, k, s, weight if s == shard else w) for r, k, s, w in self.leaves))

    def level(self, depth: int) -> dict[int, dict[int, float]]:
        """Children and their weights by parent: regions (of -1), racks or shards."""
        found: dict[int, dict[int, float]] = {}
        for *path, weight in self.leaves:
            children = found.setdefault(path[depth - 1] if depth else -1, {})
            children[path[depth]] = children.get(path[depth], 0.0) + weight
        return {p: {c: w for c, w in cs.items() if w > 0} for p, cs in found.items() if any(w > 0 for w in cs.values())}


def _draw(key: Column, depth: int, children: dict[int, dict[int, float]], parent: Column) -> Column:
    entries: list[Column] = []
    for node, weights in children.items():
        entries.append(F.lit(node))
        entries.append(F.array(*[F.struct(F.lit(c).alias("node"), F.lit(float(w)).alias("weight")) for c, w in weights.items()]))
    unit = lambda c: (F.shiftrightunsigned(F.xxhash64(key, F.lit(depth), c["node"]), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    draws = F.transform(F.element_at(F.create_map(*entries), parent), lambda c: F.struct((-F.log(unit(c)) / c["weight"]).alias("draw"), c["node"].alias("node")))
    return F.array_min(draws)["node"]


def place(df: DataFrame, key: str, tree: Tree, names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """``df`` plus its region, rack and shard; columns of these names are replaced."""
    parent: Column = F.lit(-1)
    out = without(df, list(names))
    for depth, name in enumerate(names):
        out = out.withColumn(name, _draw(F.col(key), depth, tree.level(depth), parent))
        parent = F.col(name)
    return out


def slots(df: DataFrame, group: str, key: str, slot: str = "slot", ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` plus a gapless number from 0 within each ``group``, in order of the hash of key and ``ties``.

    Rows of one key with other ties have cells of their own; rows equal in all of these are interchangeable.

    A group is dealt over many cells of the hash's value space; rows are numbered within
    their cell and start at the count of the cells before it (a table of cells, not rows).
    The numbers don't depend on how many cells there are.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (8 * parts - 1).bit_length())
    hashed = without(df, [slot]).withColumn("__h", F.xxhash64(F.lit("slot"), F.col(key), *ties))
    hashed = hashed.withColumn("__cell", F.shiftrightunsigned("__h", 64 - bits))
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy(group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select(F.col(group).alias("__g"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__cell").orderBy("__h", key, *ties)
    numbered = hashed.withColumn("__row", F.row_number().over(inside))
    joined = numbered.join(starts, numbered[group].eqNullSafe(starts["__g"]) & (numbered["__cell"] == starts["__c"]))
    return joined.withColumn(slot, F.col("__start") + F.col("__row") - 1).drop("__h", "__cell", "__g", "__c", "__start", "__row")


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus ``size`` (UTF-8 bytes plus 1) and ``text_crc32`` (of the bytes; null: of none)."""
    return without(df, ["size", "text_crc32"]).withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")),
    })
