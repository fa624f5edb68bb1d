"""Exact nearest neighbours of vectors on a two-level pivot tree.

* Cells: about sqrt(n) source rows, taken in hash order, are pivots; a row goes to the nearest of the top pivots and then to the nearest
  pivot below that.  Rows of a cell fall into rings by their distance to the pivot, rings into blocks of bounded size by hash, so
  a crowded cell, or a third of all rows at one place, becomes many blocks.  A block is one row: its ids and vectors as bytes.
* Bound pass: each ring of targets meets the source rings that must lie nearest.  A target's k-th distance there is what any
  other source has to beat.
* Search pass: by the triangle inequality, centre distances, ring bounds and the worst of those distances leave the source rings that can
  hold a neighbour; the others are never met.
* Inner products: vectors get one more coordinate that brings all sources to the largest source's length.  There, larger products
  are smaller distances, so the same bounds prune them.

Blocks meet in Spark's nested loop over a few parts of each side: parts are read again and again, but no vector is shuffled for a pair, so disk
grows with the rows and not with the pairs.  A task streams the source blocks past one target block after the other, in NumPy products, and
hands on the k best of what it saw and what beats the bound; a rank merges them.  The driver holds the pivots and at most ``RINGS`` rows a
cell for each side, about ``RINGS * sqrt(n)`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.session import cut, cut_counted

PIVOT_ROWS = 1_024  # sources a cell holds at least, on average
BLOCK_ROWS = 2_048
RINGS = 16  # of a cell, at most
SLACK = 1e-9
CHUNK = 512  # targets of a block in one matrix product
PART_BYTES = 2**25  # vectors that a task holds of the sources, about


class Tree:
    """Pivots in two levels, in lifted coordinates."""

    def __init__(self, vectors: np.ndarray, length: float | None):
        self.length = length
        self.pivots = self.lift(vectors, True)
        self.tops = self.pivots[: max(1, round(len(vectors) ** 0.5))]
        home = self._gaps(self.pivots, self.tops).argmin(axis=1)
        self.below = [np.flatnonzero(home == t) for t in range(len(self.tops))]

    def lift(self, vectors: np.ndarray, source: bool) -> np.ndarray:
        """Vectors as they are for distances; for products with the coordinate that evens out the sources' lengths."""
        if self.length is None:
            return vectors
        rest = np.sqrt(np.maximum(self.length**2 - (vectors**2).sum(axis=1), 0)) if source else np.zeros(len(vectors))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    @staticmethod
    def _gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((rows - c) ** 2).sum(axis=1)) for c in centres], axis=1)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each (lifted) row and its distance to the pivot."""
        top = self._gaps(rows, self.tops).argmin(axis=1)
        cell, gap = np.zeros(len(rows), np.int32), np.zeros(len(rows))
        for t in np.unique(top):
            mine = np.flatnonzero(top == t)
            gaps = self._gaps(rows[mine], self.pivots[self.below[t]])
            best = gaps.argmin(axis=1)
            cell[mine], gap[mine] = self.below[t][best], gaps[np.arange(len(mine)), best]
        return cell, gap


def _placed(df: DataFrame, tree: Tree, source: bool) -> tuple[DataFrame, pd.DataFrame]:
    """Rows with cell and ring, and what each ring holds: its rows and the least and largest distance to the pivot."""
    shared = df.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                cell, gap = shared.value.place(shared.value.lift(np.stack(pdf["vec"].to_numpy()).astype(float), source))
                yield pdf.assign(cell=cell, gap=gap)

    rows = cut(df.mapInPandas(run, f"id long, vec {df.schema['vec'].dataType.simpleString()}, cell int, gap double"))
    cells = rows.groupBy("cell").agg(F.count("id").alias("n"), F.max("gap").alias("far"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / BLOCK_ROWS))
    ring = F.when(F.col("far") > 0, F.least(rings - 1, F.floor(F.col("gap") / F.col("far") * rings))).otherwise(0)
    ringed = rows.join(F.broadcast(cells), "cell").select("id", "vec", "cell", ring.cast("int").alias("ring"), "gap")
    held = ringed.groupBy("cell", "ring").agg(F.count("id").alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
    return ringed.drop("gap"), held.orderBy("cell", "ring").toPandas()


Choice = Callable[[np.ndarray, np.ndarray, pd.Series], np.ndarray]


def _pairs(tree: Tree, targets: pd.DataFrame, sources: pd.DataFrame, df: DataFrame, choose: Choice) -> DataFrame:
    """``(tc, tr, sc, sr, tb, sb)``: pairs of rings that meet and their numbers of blocks.

    ``choose(nearest, farthest, ring)`` picks source rings by bounds on the distance between any two rows.
    """
    shared = df.sparkSession.sparkContext.broadcast((tree.pivots, sources))

    def run(batches):
        pivots, held = shared.value
        cell, lo, hi = held["cell"].to_numpy(), held["lo"].to_numpy(), held["hi"].to_numpy()
        for pdf in batches:
            for _, r in pdf.iterrows():
                apart = np.sqrt(((pivots - pivots[int(r["cell"])]) ** 2).sum(axis=1))[cell]
                near = np.maximum.reduce([apart - r["hi"] - hi, lo - apart - r["hi"], r["lo"] - apart - hi, np.zeros(len(cell))])
                at = choose(near, apart + r["hi"] + hi, r)
                yield pd.DataFrame({
                    "tc": np.int32(r["cell"]), "tr": np.int32(r["ring"]), "sc": cell[at].astype(np.int32), "sr": held["ring"].to_numpy()[at].astype(np.int32),
                    "tb": np.int32(-(-r["n"] // BLOCK_ROWS)), "sb": (-(-held["n"].to_numpy()[at] // BLOCK_ROWS)).astype(np.int32),
                })

    asked = df.sparkSession.createDataFrame(targets).coalesce(1 + len(targets) // 256)
    return cut(asked.mapInPandas(run, "tc int, tr int, sc int, sr int, tb int, sb int"))


def _packed(rows: DataFrame, rings: pd.DataFrame) -> DataFrame:
    """``(cell, ring, n, ids, vecs, bounds)``: one row a block, with the bytes of its ids, of its vectors and of what they have to beat."""
    single = rows.schema["vec"].dataType.elementType == T.FloatType()
    columns = ["cell", "ring", "id", "vec", *(["bound"] if "bound" in rows.columns else [])]
    counts = rows.sparkSession.createDataFrame(rings[["cell", "ring", "n"]])
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int").alias("block")

    def pack(group: pa.Table) -> pa.Table:
        vecs = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        some = group.slice(0, 1).select(["cell", "ring"])
        bounds = group.column("bound").to_numpy() if "bound" in group.column_names else np.full(group.num_rows, np.inf)
        for name, kept in (("ids", group.column("id").to_numpy()), ("vecs", vecs.astype("f4" if single else "f8")), ("bounds", bounds)):
            some = some.append_column(name, pa.array([kept.tobytes()], pa.binary()))
        return some.append_column("n", pa.array([group.num_rows], pa.int32()))

    blocks = rows.join(F.broadcast(counts), ["cell", "ring"]).select(*columns, block).groupBy("cell", "ring", "block")
    return cut(blocks.applyInArrow(pack, "cell int, ring int, ids binary, vecs binary, bounds binary, n int"))


def _candidates(
    a: np.ndarray, b: np.ndarray, ai: np.ndarray, bi: np.ndarray, some: int, metric: str, exclude_self: bool, limit: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and ``b`` that hold the ``some`` best of each row of ``a``, and few others.

    One matrix product estimates all costs (squared distances, or negative products).  Each estimate is off by less than ``SLACK`` of
    the squared lengths, so whatever lies more than that above the ``some``-th estimate isn't among the best, ties by rounding included.
    Rows with a finite ``limit`` want only what costs no more than that.
    """
    size_a, size_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    rough = (a * (-2.0 if metric == "l2" else -1.0)) @ b.T
    if metric == "l2":
        rough += size_b[None, :]  # the own length of a row of ``a`` is the same for all its pairs
    off = SLACK * (1 + size_a + size_b.max())
    own = np.zeros((2, 0), np.int64)
    if exclude_self:
        order = np.argsort(bi, kind="stable")
        lo, hi = (np.searchsorted(bi[order], ai, side) for side in ("left", "right"))
        at = np.repeat(np.arange(len(ai)), hi - lo)
        own = np.stack([at, order[np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]])
        rough[own[0], own[1]] = np.inf
    last = np.full(len(a), np.inf) if limit is None else limit - (size_a if metric == "l2" else 0)
    free = np.flatnonzero(~np.isfinite(last))
    if len(free):
        last[free] = np.partition(rough[free], some - 1, axis=1)[:, some - 1]
    odd = ~np.isfinite(last) | ~np.isfinite(off)  # fewer rows than asked for, or values beyond the doubles: all of them
    close = rough <= (last + off)[:, None]
    if odd.any():
        close[odd] = True
        close[own[0], own[1]] = False
    return np.divmod(np.flatnonzero(close.ravel()), len(b))


class _Best:
    """The best sources so far of each target of a block."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, bounds: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.ids, self.vecs, self.bounds = ids, vecs, bounds
        self.k, self.metric, self.exclude_self = k, metric, exclude_self
        self.cost, self.source = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)

    def meet(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        for at in range(0, len(self.ids), CHUNK):
            self._meet(slice(at, at + CHUNK), ids, vecs)

    def _meet(self, part: slice, bi: np.ndarray, b: np.ndarray) -> None:
        a, ai = self.vecs[part], self.ids[part]
        most = np.minimum(self.bounds[part], self.cost[part, -1]) + 1e-12  # costs are rounded
        limit = most * most if self.metric == "l2" else most
        rows, flat = _candidates(a, b, ai, bi, min(self.k, len(b)), self.metric, self.exclude_self, limit)
        total = np.zeros(len(rows))
        for dim in range(a.shape[1]):  # in the order of the dimensions, so that sums are those of a scan
            x, y = a[rows, dim], b[flat, dim]
            total += (x - y) * (x - y) if self.metric == "l2" else x * y
        cost = np.round(np.sqrt(total), 12) if self.metric == "l2" else -np.round(total, 12)
        good = np.isfinite(cost) & (cost <= np.minimum(self.bounds[part], self.cost[part, -1])[rows])
        if not good.any():
            return
        rows, cost, source = rows[good], cost[good], bi[flat[good]]
        hit = np.unique(rows)
        held, old = self.cost[part][hit], self.source[part][hit]
        rows, cost = np.concatenate([np.repeat(hit, self.k), rows]), np.concatenate([held.ravel(), cost])
        source = np.concatenate([old.ravel(), source])
        order = np.lexsort((source, cost, rows))
        rows, cost, source = rows[order], cost[order], source[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, hit)[np.searchsorted(hit, rows)]
        kept = place < self.k
        self.cost[part][rows[kept], place[kept]] = cost[kept]
        self.source[part][rows[kept], place[kept]] = source[kept]

    def found(self, cell: int, ring: int, length: float | None) -> pa.RecordBatch:
        rows, place = np.nonzero(np.isfinite(self.cost))
        cost = self.cost[rows, place]
        size = (self.vecs * self.vecs).sum(axis=1)
        reach = cost if self.metric == "l2" else np.sqrt(np.maximum(size[rows] + length**2 + 2 * cost, 0))
        return pa.RecordBatch.from_pydict({
            "target": self.ids[rows], "source": self.source[rows, place], "value": cost if self.metric == "l2" else -cost,
            "tc": np.full(len(rows), cell, np.int32), "tr": np.full(len(rows), ring, np.int32), "reach": reach,
        })


def _met(
    targets: DataFrame, sources: DataFrame, pairs: DataFrame, k: int, metric: str, exclude_self: bool, length: float | None, shape: tuple[int, str, str], parts: int
) -> DataFrame:
    """``(target, source, value, tc, tr, reach)``: of each target the ``k`` best, or better, in each part of the sources; ``reach`` is the lifted distance.

    ``shape`` is the number of dimensions and the types of the targets' and of the sources' numbers.
    """
    ring = lambda cell, ring: F.col(cell).cast("long") * RINGS + F.col(ring)
    asked = pairs.groupBy(F.col("tc").alias("cell"), F.col("tr").alias("ring")).agg(F.collect_list(ring("sc", "sr")).alias("asked"))
    spread = -(-3 * targets.sparkSession.sparkContext.defaultParallelism // parts)
    left = targets.join(asked, ["cell", "ring"]).select("cell", "ring", "ids", "vecs", "bounds", "asked").repartition(spread)
    right = sources.select(ring("cell", "ring").alias("s_ring"), F.col("ids").alias("s_ids"), F.col("vecs").alias("s_vecs")).repartition(parts)
    both = left.join(right.hint("shuffle_replicate_nl"), F.array_contains("asked", F.col("s_ring"))).drop("asked", "s_ring")
    dims, t_kind, s_kind = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = None, None
        for batch in batches:
            held = dict(zip(batch.schema.names, batch.columns, strict=True))
            read = lambda name, i, kind: np.frombuffer(held[name][i].as_buffer(), kind)  # noqa: B023, E731
            for i in range(batch.num_rows):
                ids = read("ids", i, "i8")
                if best is None or now[:2] != (held["cell"][i], held["ring"][i]) or not np.array_equal(best.ids, ids):
                    if best is not None:
                        yield best.found(now[0].as_py(), now[1].as_py(), length)
                    now = (held["cell"][i], held["ring"][i])
                    best = _Best(ids.copy(), read("vecs", i, t_kind).reshape(-1, dims).astype(float), read("bounds", i, "f8").copy(), k, metric, exclude_self)
                best.meet(read("s_ids", i, "i8"), read("s_vecs", i, s_kind).reshape(-1, dims).astype(float))
        if best is not None:
            yield best.found(now[0].as_py(), now[1].as_py(), length)

    return both.mapInArrow(run, "target long, source long, value double, tc int, tr int, reach double")


def nearest(
    targets: DataFrame, sources: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False
) -> DataFrame:
    """The k best sources of every target: ``(target, source, value, rank)``, ties by id.

    ``l2`` ranks by distance ascending, ``dot`` by inner product descending.
    """
    def plain(df: DataFrame) -> DataFrame:
        vec = F.col("vec") if df.schema["vec"].dataType.simpleString() == "array<float>" else F.col("vec").cast("array<double>")
        return df.select(F.col("id").cast("long").alias("id"), vec.alias("vec"))

    s_rows, count = cut_counted(plain(sources))
    if not count:
        return targets.sparkSession.createDataFrame([], "target long, source long, value double, rank int")
    length = None
    if metric == "dot":
        squares = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v)
        length = s_rows.agg(F.max(F.sqrt(squares))).first()[0]
    wanted = max(1, min(int(count**0.5), count // PIVOT_ROWS))
    pivots = s_rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    tree = Tree(np.array([r["vec"] for r in pivots], dtype=float), length)
    s_placed, s_rings = _placed(s_rows, tree, True)
    t_placed, t_rings = _placed(plain(targets), tree, False)
    best = F.col("value").asc() if metric == "l2" else F.col("value").desc()
    rank = F.row_number().over(Window.partitionBy("target").orderBy(best, "source"))
    if not len(t_rings):
        return targets.sparkSession.createDataFrame([], "target long, source long, value double, rank int")
    need, sizes = k + exclude_self, s_rings["n"].to_numpy()
    width = lambda df: 4 if df.schema["vec"].dataType.simpleString() == "array<float>" else 8
    dims = len(pivots[0]["vec"])
    shape = (dims, f"f{width(t_placed)}", f"f{width(s_placed)}")
    parts = -(-count * dims * width(s_placed) // PART_BYTES)
    s_blocks = _packed(s_placed, s_rings)

    def closest(near, far, ring):
        order = np.argsort(far, kind="stable")
        return order[: 1 + int(np.searchsorted(np.cumsum(sizes[order]), need))]

    first = _pairs(tree, t_rings, s_rings, t_placed, closest)
    found = cut(_met(_packed(t_placed, t_rings), s_blocks, first, k, metric, exclude_self, length, shape, parts).withColumn("rank", rank).filter(F.col("rank") <= k))
    if len(s_rings) > 1:
        cost = F.col("value") if metric == "l2" else -F.col("value")
        full = cut(found.groupBy("target", "tc", "tr").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach"), F.max(cost).alias("cost")))
        worst = full.groupBy("tc", "tr").agg(F.when(F.min("n") == k, F.max("reach")).alias("reach"), F.count(F.lit(1)).alias("seen")).toPandas()
        asked = t_rings.merge(worst, how="left", left_on=["cell", "ring"], right_on=["tc", "tr"])
        # a ring in which some target found too few, or nothing at all, looks everywhere
        asked["bound"] = asked["reach"].where(asked["seen"] == asked["n"], np.inf).fillna(np.inf)
        asked = asked[["cell", "ring", "n", "lo", "hi", "bound"]]

        def within(near, far, ring):
            return np.flatnonzero(near <= ring["bound"] * (1 + SLACK) + SLACK)

        rest = cut(_pairs(tree, asked, s_rings, t_placed, within).join(first.select("tc", "tr", "sc", "sr"), ["tc", "tr", "sc", "sr"], "left_anti").select(first.columns))
        kth = full.filter(F.col("n") == k).groupBy(F.col("target").alias("id")).agg(F.max("cost").alias("bound"))
        bounded = t_placed.join(kth, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        met = _met(_packed(bounded, t_rings), s_blocks, rest, k, metric, exclude_self, length, shape, parts)
        both = found.drop("rank").unionByName(met)
        found = both.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("target", "source", "value", "rank")
