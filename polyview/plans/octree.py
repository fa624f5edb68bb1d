"""Neighbourhoods of 3-D points on an octree.

* ``occupied_pairs``: pairs of occupied grid cells near each other.  Cells look into the eight parents around them, whose
  occupied cells are listed (64 at most), so that empty neighbours cost nothing and no point is copied.
* ``nearest_rows``: for every location its ``k`` nearest rows.  Locations in Morton order are cut into tiles of about ``TILE``;
  a tile builds its octree leaves in NumPy and answers its own locations.  What another tile can still improve is known from the tiles'
  boxes: only those locations go there, with the distance that has to be beaten.

The driver holds one box a tile.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.session import cut

CELLS = ["cx", "cy", "cz"]
AXES = ["x", "y", "z"]
DEPTH = 20
TILE = 8_192
LEAF = 32


def occupied_pairs(cells: DataFrame, reach: int = 2) -> DataFrame:
    """``(a, b)``: structs of ``cells(cx, cy, cz, ...)``, one row a cell, at most ``reach`` apart on every axis, each with itself too."""
    span = 2 * reach
    up = lambda c: F.floor(c / span)
    parents = [f"__p{c}" for c in CELLS]
    row = F.struct(*cells.columns)
    listed = cells.groupBy(*[up(F.col(c)).alias(p) for c, p in zip(CELLS, parents, strict=True)]).agg(F.collect_list(row).alias("__in"))
    asking = cells.select(row.alias("a"))
    for c, p in zip(CELLS, parents, strict=True):
        at = F.col(f"a.{c}")
        asking = asking.withColumn(p, F.explode(F.array_distinct(F.array(up(at - reach), up(at + reach)))))
    near = F.filter("__in", lambda b: reduce(Column.__and__, [F.abs(b[c] - F.col(f"a.{c}")) <= reach for c in CELLS]))
    return asking.join(listed, parents).select("a", F.explode(near).alias("b"))


def box_gaps(a: str, b: str) -> tuple[Column, Column]:
    """The least and the largest distance between points of two boxes, given as structs with ``lo`` and ``hi`` per axis."""
    def side(c: str) -> tuple[Column, Column]:
        apart = F.greatest(F.col(f"{a}.lo{c}") - F.col(f"{b}.hi{c}"), F.col(f"{b}.lo{c}") - F.col(f"{a}.hi{c}"), F.lit(0.0))
        wide = F.greatest(F.col(f"{a}.hi{c}") - F.col(f"{b}.lo{c}"), F.col(f"{b}.hi{c}") - F.col(f"{a}.lo{c}"))
        return apart, wide

    sides = [side(c) for c in AXES]
    return tuple(F.sqrt(reduce(Column.__add__, [s[i] * s[i] for s in sides])) for i in (0, 1))


def box_columns() -> list[Column]:
    return [f(c).alias(n + c) for c in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]


def morton(columns: list[Column]) -> Column:
    """The interleaved bits of three whole numbers below ``2 ** DEPTH``."""
    bits = [F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), 3 * i + axis) for i in range(DEPTH) for axis, c in enumerate(columns)]
    return reduce(Column.bitwiseOR, bits)


class Leaves:
    """Octree leaves of at most ``LEAF`` locations each (more only where codes coincide), over locations in Morton order."""

    def __init__(self, codes: np.ndarray, xyz: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes, kind="stable")
        self.order, self.xyz, self.counts = order, xyz[order], counts[order]
        codes, leaf = codes[order], np.full(len(codes), -1, np.int64)
        for depth in range(DEPTH + 1):
            prefix = codes >> (3 * (DEPTH - depth))
            heads = np.flatnonzero(np.diff(prefix, prepend=prefix[0] - 1))
            sizes = np.diff(heads, append=len(codes))
            small = np.repeat((sizes <= LEAF) | (depth == DEPTH), sizes) & (leaf < 0)
            leaf[small] = (np.repeat(heads, sizes))[small]
        self.starts = np.flatnonzero(np.diff(leaf, prepend=-1))
        self.ends = np.append(self.starts[1:], len(codes))
        self.low = np.minimum.reduceat(self.xyz, self.starts)
        self.high = np.maximum.reduceat(self.xyz, self.starts)
        self.rows = np.add.reduceat(self.counts, self.starts)

    def nearest(self, xyz: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries close together: distances and counts of locations until ``k`` rows, nearest first; those beyond ``reach`` don't count."""
        low, high = xyz.min(axis=0), xyz.max(axis=0)
        far = np.sqrt((np.maximum(self.high - low, high - self.low) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.rows[order]), k))
        bound = min(far[order[enough]] if enough < len(order) else np.inf, reach.max())
        near = np.sqrt((np.maximum(np.maximum(self.low - high, low - self.high), 0) ** 2).sum(axis=1))
        at = np.flatnonzero(near <= bound)
        if not len(at):
            return np.full((len(xyz), 0), np.inf), np.zeros((len(xyz), 0), np.int64)
        found = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in at])
        gaps = np.sqrt(sum((xyz[:, c, None] - self.xyz[None, found, c]) ** 2 for c in range(3)))
        some = min(k, gaps.shape[1])
        best = np.argpartition(gaps, some - 1, axis=1)[:, :some]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(gaps, best, axis=1), axis=1, kind="stable"), axis=1)
        gaps, counts = np.take_along_axis(gaps, best, axis=1), self.counts[found][best]
        return gaps, np.where(gaps <= reach[:, None], counts, 0)


def _taken(gaps: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of each location belong to the first ``k``, and the distance of the last of them (infinite: fewer rows)."""
    before = np.cumsum(counts, axis=1) - counts
    take = np.clip(k - before, 0, counts)
    last = np.where(take > 0, gaps, -np.inf).max(axis=1, initial=-np.inf)
    return take, np.where(take.sum(axis=1) >= k, last, np.inf)


def nearest_rows(located: DataFrame, k: int) -> DataFrame:
    """``(loc, mean_distance)``: the mean distance of each location to its ``k`` nearest rows, for ``located(loc, x, y, z, n)``.

    Locations are distinct places, ``n`` rows each, own rows included.  There must be ``k`` rows.
    """
    box = located.agg(*box_columns(), F.count(F.lit(1)).alias("n")).first()
    side = max(max(box[f"hi{c}"] - box[f"lo{c}"] for c in AXES), 1e-12)
    scaled = [F.least(F.floor((F.col(c) - box[f"lo{c}"]) / side * 2**DEPTH), F.lit(2**DEPTH - 1)).cast("long") for c in AXES]
    coded = located.select("loc", *AXES, F.col("n").cast("long").alias("n"), morton(scaled).alias("code"))
    tiled = cut(coded.repartitionByRange(max(1, -(-box["n"] // TILE)), "code").withColumn("tile", F.spark_partition_id()))
    boxes = tiled.groupBy("tile").agg(*box_columns(), F.sum("n").alias("rows")).orderBy("tile").toPandas()
    shared = located.sparkSession.sparkContext.broadcast(boxes)

    def answers(leaves: Leaves, xyz: np.ndarray, reach: np.ndarray, starts: np.ndarray):
        """Gaps and counts of queries, which stand in portions of neighbours."""
        for a, b in zip(starts, np.append(starts[1:], len(xyz)), strict=True):
            gaps, counts = leaves.nearest(xyz[a:b], k, reach[a:b])
            yield a, b, gaps, counts

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        held = shared.value
        low, high = held[[f"lo{c}" for c in AXES]].to_numpy(), held[[f"hi{c}" for c in AXES]].to_numpy()
        mine = int(np.flatnonzero(held["tile"].to_numpy() == pdf["tile"].iloc[0])[0])
        leaves = Leaves(pdf["code"].to_numpy(), pdf[AXES].to_numpy(), pdf["n"].to_numpy())
        locs, out = pdf["loc"].to_numpy()[leaves.order], []
        for a, b, gaps, counts in answers(leaves, leaves.xyz, np.full(len(locs), np.inf), leaves.starts):
            xyz = leaves.xyz[a:b]
            take, reach = _taken(gaps, counts, k)
            if not np.isfinite(reach).all():  # the tile is too small: boxes that hold enough rows bound the distance
                far = np.sqrt((np.maximum(np.abs(xyz[:, None] - low), np.abs(xyz[:, None] - high)) ** 2).sum(axis=2))
                order = np.argsort(far, axis=1)
                enough = (np.cumsum(held["rows"].to_numpy()[order], axis=1) >= k).argmax(axis=1)
                reach = np.minimum(reach, far[np.arange(len(xyz)), order[np.arange(len(xyz)), enough]])
            near = np.sqrt((np.maximum(np.maximum(low - xyz[:, None], xyz[:, None] - high), 0) ** 2).sum(axis=2))
            ask = near < reach[:, None]
            ask[:, mine] = False
            for i in range(b - a):
                some = take[i] > 0
                out.append((locs[a + i], *xyz[i], reach[i], float((gaps[i] * take[i])[some].sum() / k), gaps[i][some].tolist(), take[i][some].tolist(), held["tile"].to_numpy()[ask[i]].tolist()))
        return pd.DataFrame(out, columns=["loc", *AXES, "reach", "mean_distance", "gaps", "counts", "tiles"])

    kind = located.schema["loc"].dataType.simpleString()
    lists = "gaps array<double>, counts array<long>"
    first = cut(tiled.groupBy("tile").applyInPandas(own, f"loc {kind}, x double, y double, z double, reach double, mean_distance double, {lists}, tiles array<int>"))
    open_ = first.filter(F.size("tiles") > 0)
    asked = open_.select("loc", *AXES, "reach", F.explode("tiles").alias("tile"))

    def other(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or held.empty:
            return pd.DataFrame([], columns=["loc", "gaps", "counts"])
        leaves = Leaves(held["code"].to_numpy(), held[AXES].to_numpy(), held["n"].to_numpy())
        xyz = queries[AXES].to_numpy()
        order = np.lexsort(np.floor((xyz - xyz.min(axis=0)) / (np.ptp(xyz, axis=0).max() / 32 + 1e-300)).T)
        locs, xyz, reach, out = queries["loc"].to_numpy()[order], xyz[order], queries["reach"].to_numpy()[order], []
        for a, b, gaps, counts in answers(leaves, xyz, reach, np.arange(0, len(xyz), LEAF)):
            take, _ = _taken(gaps, counts, k)
            out += [(locs[a + i], gaps[i][take[i] > 0].tolist(), take[i][take[i] > 0].tolist()) for i in range(b - a) if (take[i] > 0).any()]
        return pd.DataFrame(out, columns=["loc", "gaps", "counts"])

    more = asked.groupBy("tile").cogroup(tiled.groupBy("tile")).applyInPandas(other, f"loc {kind}, {lists}")
    every = open_.select("loc", "gaps", "counts").unionByName(more)
    listed = every.groupBy("loc").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("gaps", "counts")))).alias("found"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("rows"))

    def add(s, e):
        take = F.least(e["counts"], F.lit(k).cast("long") - s["rows"])
        return F.struct((s["total"] + e["gaps"] * take).alias("total"), (s["rows"] + take).alias("rows"))

    merged = listed.select("loc", (F.aggregate("found", start, add)["total"] / k).alias("mean_distance"))
    return first.filter(F.size("tiles") == 0).select("loc", "mean_distance").unionByName(merged)
