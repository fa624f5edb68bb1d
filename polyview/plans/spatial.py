"""Spatial equi-joins: overlapping boxes and points in radius."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.plans.scan import group_fits

# Groups up to this size are paired by an equi-join on their key alone.
PAIR_LIMIT = 2_000
BLOCK = 4  # radii a block of points is wide
BLOCK_POINTS = 40_000  # points of a block, or of one of its parts, about
CANDIDATES = 200_000
SLACK = 1e-6  # blocks and cells reach a little farther than the radius, so that rounding loses no pair


# Box sides are powers of two apart between levels; smaller sides share the lowest one.
LOWEST, HIGHEST = -16, 60


def _level(df: DataFrame) -> Column:
    """The level whose cells are at least as wide as the box, so that it touches four of them at most."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return F.when(side > 2.0**LOWEST, F.least(F.ceil(F.log2(side)), F.lit(HIGHEST))).otherwise(LOWEST).cast("int")


def _in_cells(df: DataFrame, level: str) -> DataFrame:
    """A row for each cell of the ``level`` that a box touches."""
    size = F.pow(F.lit(2.0), F.col(level))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return df.withColumn("__cx", span("x1", "x2")).withColumn("__cy", span("y1", "y2"))


def overlapping(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    fits: bool | None = None,
) -> DataFrame:
    """Pairs of touching or overlapping boxes inside a key group, as structs ``a`` and ``b``.

    Points are boxes without extent.  While the larger side's groups are small the
    key alone pairs them.  Otherwise boxes lie on grids of several levels, each on that of its own
    size; of two boxes the smaller one also looks into the larger one's level, where it touches four cells
    at most.  So a box as wide as the table is four rows and small boxes stay in small cells.  A pair is kept only in the
    cell holding the lower corner of the intersection, so it appears once and needs no ``distinct``; Spark splits
    crowded cells (skew join).
    """
    keys = list(keys)
    if fits is None:
        fits = group_fits(a, keys, PAIR_LIMIT) and group_fits(b, keys, PAIR_LIMIT)
    pack = lambda df, name, *more: df.select(
        *keys, F.struct(*[c for c in df.columns if not c.startswith("__")]).alias(name), *more
    )
    touch = (
        (F.col("a.x1") <= F.col("b.x2"))
        & (F.col("b.x1") <= F.col("a.x2"))
        & (F.col("a.y1") <= F.col("b.y2"))
        & (F.col("b.y1") <= F.col("a.y2"))
    )
    if fits:
        return pack(a, "a").join(pack(b, "b"), keys).filter(touch)
    cell = ["__level", "__cx", "__cy"]
    sides = {name: df.withColumn("__own", _level(df)) for name, df in (("a", a), ("b", b))}
    levels = {name: sorted(r[0] for r in df.select("__own").distinct().collect() if r[0] is not None) for name, df in sides.items()}

    def met(small: str, large: str, strict: bool) -> DataFrame:
        """Pairs whose ``small`` side is on a lower level, or on the same one."""
        least = F.col("__own") + 1 if strict else F.col("__own")
        up = F.filter(F.array(*[F.lit(v) for v in levels[large]]).cast("array<int>"), lambda v: v >= least)
        looking = pack(_in_cells(sides[small].withColumn("__level", F.explode(up)), "__level"), small, *cell)
        lying = pack(_in_cells(sides[large].withColumn("__level", F.col("__own")), "__level"), large, *cell)
        size = F.pow(F.lit(2.0), F.col("__level"))
        owner = (F.col("__cx") == F.floor(F.greatest("a.x1", "b.x1") / size)) & (F.col("__cy") == F.floor(F.greatest("a.y1", "b.y1") / size))
        return looking.join(lying, [*keys, *cell]).filter(touch & owner).select(*keys, "a", "b")

    return met("a", "b", False).unionByName(met("b", "a", True))


def lattice(axes: Sequence[Column], size: float, names: Sequence[str]) -> list[Column]:
    return [F.floor(c / size).alias(n) for c, n in zip(axes, names)]


def _near_pairs(a: np.ndarray, b: np.ndarray | None, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``a`` and in ``b`` of points at most ``radius`` apart and their distances, from about ``CANDIDATES`` pairs at a time; without ``b`` each pair of ``a`` once.

    Points stand in columns half a radius wide, in the order of their height: a point looks into the columns around it, as high and as deep as the
    distance of the column leaves.
    """
    alone, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return
    both = np.concatenate([a, b])
    reach = radius * (1 + SLACK) + np.abs(both).max() * 4e-15
    width, low = reach / 2, both.min(axis=0)
    ny = int((both[:, 1].max() - low[1]) / width) + 6
    span = both[:, 2].max() - low[2] + 4 * reach

    def ordered(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        cell = np.floor((xyz[:, :2] - low[:2]) / width) + 2
        key = (cell[:, 0] * ny + cell[:, 1]) * span + (xyz[:, 2] - low[2])
        order = np.argsort(key, kind="stable")
        return order, key[order], [np.ascontiguousarray(xyz[order, c]) for c in range(3)]

    a_order, a_key, a_at = ordered(a)
    b_order, b_key, b_at = (a_order, a_key, a_at) if alone else ordered(b)
    for step in product(range(-2, 3), repeat=2):
        rest = reach * reach - sum((max(abs(t) - 1, 0) * width) ** 2 for t in step)
        if rest < 0 or alone and step < (0, 0):
            continue
        there, high = a_key + (step[0] * ny + step[1]) * span, rest**0.5
        lo = np.searchsorted(b_key, there - high, "left") if any(step) or not alone else np.arange(1, len(a) + 1)
        count = np.searchsorted(b_key, there + high, "right") - lo
        ends = np.cumsum(count)
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
            n = count[at:to]
            two = np.arange(n.sum()) + np.repeat(lo[at:to] - (np.cumsum(n) - n), n)
            square = np.zeros(len(two))
            for x, y in zip(a_at, b_at, strict=True):
                gap = y[two]
                gap -= np.repeat(x[at:to], n)
                gap *= gap
                square += gap
            near = np.flatnonzero(square <= radius * radius * (1 + SLACK))
            dist = np.sqrt(square[near])
            near, dist = near[dist <= radius], dist[dist <= radius]
            if len(near):
                one = np.repeat(np.arange(at, to), n)[near]
                yield a_order[one], b_order[two[near]], dist
            at = to


def _rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero in the shortest decimal form, as Spark's ``round`` does it, for values that are not negative."""
    scaled = values * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    half = np.abs(scaled - np.floor(scaled) - 0.5)
    odd = np.flatnonzero((half <= np.maximum(scaled, 1) * 1e-15) | (scaled > 2.0**50))
    step = Decimal(1).scaleb(-digits)
    out[odd] = [float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) if v < 1e20 else v for v in values[odd].tolist()]
    return out


def within_radius(points: DataFrame, radius: float, ident: str, carry: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Every unordered pair of 3-D points at most ``radius`` apart, ``a_id < b_id``, with ``dist``, rounded to ``digits`` if they are given.

    Columns that ``carry`` names come along as ``a_…`` and ``b_…``.

    Points are dealt to blocks of ``BLOCK`` radii, and also to those they are within reach of at the upper sides: about two copies each.
    A pair belongs to the block of its lower corner.  A block of more than ``BLOCK_POINTS`` points is dealt into hashed parts, and each pair of parts
    is a group of its own, so no group holds more than two parts.  Groups find their pairs in columns finer than the radius.
    """
    axes, blocks = ["x", "y", "z"], ["__bx", "__by", "__bz"]
    side = radius * BLOCK
    base = points.select(F.col(ident).alias("__id"), *[F.col(c).cast("double").alias(c) for c in axes], *[c for c in carry if c not in axes])
    base = base.filter(" AND ".join(f"abs({c}) < double('infinity')" for c in axes))
    dealt = base
    for c, b in zip(axes, blocks, strict=True):
        low = F.floor((F.col(c) - radius * (1 + SLACK) - F.abs(c) * 4e-15) / side)
        dealt = dealt.withColumn(b, F.explode(F.array_distinct(F.array(F.floor(F.col(c) / side), low))))
    crowded = dealt.groupBy(*blocks).agg(F.ceil(F.count(F.lit(1)) / BLOCK_POINTS).cast("int").alias("__parts")).filter("__parts > 1")
    dealt = dealt.join(crowded, blocks, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    part = F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int")
    dealt = dealt.withColumn("__part", part).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    dealt = dealt.withColumns({"__p": F.least("__part", "__other"), "__q": F.greatest("__part", "__other")}).drop("__other")
    kept = [*carry, "__id"]
    names = [f"{s}_{'id' if c == '__id' else c}" for s in "ab" for c in kept]
    kinds = [base.schema[c].dataType for c in kept] * 2
    schema = T.StructType([T.StructField(n, k) for n, k in zip([*names, "dist"], [*kinds, T.DoubleType()], strict=True)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        xyz = np.stack([group.column(c).to_numpy() for c in axes], axis=1)
        block = np.array([group.column(b)[0].as_py() for b in blocks])
        p, q = group.column("__p")[0].as_py(), group.column("__q")[0].as_py()
        rank = pc.rank(group.column("__id"), "ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        firsts = np.unique(rank, return_index=True)[1]
        ids = group.column("__id").combine_chunks().take(pa.array(firsts))
        numbers = ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else None
        named = lambda at: pa.array(numbers[at], ids.type) if numbers is not None else ids.take(pa.array(at))
        here = (np.floor(xyz / side) == block) @ np.array([1, 2, 4], np.uint8)  # the axes on which a point lies in the block; else it lies above
        own = group.column("__part").to_numpy()
        ia, ib = np.flatnonzero(own == p), np.flatnonzero(own == q)
        rows = group.select(list(carry)).to_batches()[0] if carry else None
        for one, two, dist in _near_pairs(xyz[ia], None if p == q else xyz[ib], radius):
            one, two = ia[one], ib[two]
            mine = ((here[one] | here[two]) == 7) & (rank[one] != rank[two])
            if not mine.all():
                one, two, dist = one[mine], two[mine], dist[mine]
            less, more = rank[one], rank[two]
            first = less < more
            less, more = np.minimum(less, more), np.maximum(less, more)
            taken = [rows.take(pa.array(np.where(first, x, y))).columns for x, y in ((one, two), (two, one))] if carry else [[], []]
            dist = dist if digits is None else _rounded(dist, digits)
            yield pa.RecordBatch.from_arrays([*taken[0], named(less), *taken[1], named(more), pa.array(dist)], names=[*names, "dist"])

    return dealt.groupBy(*blocks, "__p", "__q").applyInArrow(pairs, schema)
