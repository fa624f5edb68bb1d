"""Budgets and deterministic samples.

Random draws are replaced by hash order, so a sample is the same on every run and
every partitioning.  Shares between groups are solved in closed form on the sorted
group table instead of by repeated rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.plans.scan import along, group_size, group_sum, number, running_sum
from polyview.plans.stats import attach, with_aggregates

DRAWN = 200_000  # candidates that ``box_points`` draws at a time, or those of one box


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "pos") -> DataFrame:
    """First ``k`` rows per group; the rank limit runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, rank).filter(F.col(name) <= k)


def equal_quota(groups: DataFrame, key: str, capacity: str, budget: int) -> DataFrame:
    """Equal shares of a budget, capped by capacity; leftovers go to the first keys.

    With capacities sorted, group i is the first that cannot be filled when
    ``floor((budget - used by smaller groups) / groups left)`` falls below it; that
    quotient is the common level.
    """
    cap = F.col(capacity)
    scanned = along(
        groups, [], [cap, F.col(key)],
        {"__used": running_sum(cap, strict=True), "__i": number(), "__m": group_size()},
    )
    level = F.floor((F.lit(budget) - F.col("__used")) / (F.col("__m") - F.col("__i") + 1))
    first = scanned.filter(cap > level).agg(F.min_by(level, "__i").alias("__level"))
    leveled = attach(groups, [], first)
    base = F.when(F.col("__level").isNull(), cap).otherwise(F.least(cap, F.col("__level")))
    hungry = F.coalesce(cap > F.col("__level"), F.lit(False))
    based = leveled.withColumns({"__base": base, "__hungry": hungry.cast("long")})
    total = with_aggregates(based, [], __given=F.sum("__base"))
    turn = along(total, [], [F.col(key)], {"__turn": running_sum(F.col("__hungry"))})
    extra = (F.col("__hungry") == 1) & (F.col("__turn") <= F.lit(budget) - F.col("__given"))
    return turn.select(key, capacity, (F.col("__base") + extra.cast("long")).alias("quota"))


def largest_remainder(groups: DataFrame, key: str, capacity: str, mass: str, budget: int) -> DataFrame:
    """Shares proportional to mass, capped, at least one each, rounded by largest remainder."""
    occupied = groups.filter(F.col(capacity) > 0)
    seeded = with_aggregates(occupied, [], __n=F.count(F.lit(1)))
    seed = F.when(F.lit(budget) >= F.col("__n"), 1).otherwise(0)
    room = seeded.withColumns({"__seed": seed, "__room": F.col(capacity) - seed})
    open_ = room.filter("__room > 0")
    scanned = along(
        open_, [], [F.col("__room") / F.col(mass), F.col(key)],
        {
            "__filled": running_sum(F.col("__room"), strict=True),
            "__mass_before": running_sum(F.col(mass), strict=True),
            "__mass": group_sum(F.col(mass)), "__i": number(),
        },
    )
    left = F.lit(budget) - F.col("__seed") * F.col("__n") - F.col("__filled")
    rate = left / (F.col("__mass") - F.col("__mass_before"))
    first = scanned.filter(rate * F.col(mass) < F.col("__room")).agg(
        F.min_by(F.struct(rate.alias("rate"), F.col("__i").alias("i")), "__i").alias("__cutoff")
    )
    with_cut = attach(scanned, [], first)
    full = F.coalesce(F.col("__i") < F.col("__cutoff.i"), F.lit(True))
    share = F.greatest(F.lit(0.0), F.round(F.col("__cutoff.rate") * F.col(mass), 9))
    split = with_cut.withColumns({
        "__give": F.when(full, F.col("__room")).otherwise(F.floor(share)).cast("long"),
        "__frac": F.when(full, F.lit(-1.0)).otherwise(share - F.floor(share)),
    })
    given = with_aggregates(split, [], __given=F.sum("__give"))
    ranked = along(given, [], [F.col("__frac").desc(), F.col(key)], {"__turn": number()})
    spare = F.lit(budget) - F.col("__seed") * F.col("__n") - F.col("__given")
    more = (F.col("__frac") >= 0) & (F.col("__turn") <= spare)
    granted = ranked.select(key, (F.col("__give") + more.cast("long")).alias("__grant"))
    return room.join(granted, key, "left").select(
        key, capacity, mass, (F.col("__seed") + F.coalesce("__grant", F.lit(0))).cast("long").alias("quota")
    )


def morton(x: Column, y: Column, bits: int) -> Column:
    """Interleave the low bits of two cell coordinates."""
    code = F.lit(0).cast("long")
    for b in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(1).cast("long"), 2 * b))
        code = code.bitwiseOR(F.shiftleft(F.shiftright(y, b).bitwiseAND(1).cast("long"), 2 * b + 1))
    return code


def systematic_sample(rows: DataFrame, tile: str, quotas: DataFrame, weight: str, order: Sequence[Column]) -> DataFrame:
    """Inclusion probabilities that add up to the tile's quota, then evenly spaced picks.

    ``sum(min(1, r * w)) = quota`` is solved on the rows sorted by weight; a row is
    picked when the running probability in ``order`` passes another half-integer.
    """
    joined = rows.join(quotas.select(tile, "quota"), tile)
    heavy = along(
        joined, [tile], [F.col(weight).desc(), *order],
        {
            "__before": running_sum(F.col(weight), strict=True),
            "__all": group_sum(F.col(weight)), "__i": number(),
        },
    )
    rate = (F.col("quota") - F.col("__i") + 1) / (F.col("__all") - F.col("__before"))
    rates = heavy.filter(F.round(rate * F.col(weight), 9) < 1).groupBy(tile).agg(F.min_by(rate, "__i").alias("__rate"))
    p = F.least(F.lit(1.0), F.coalesce(F.col("__rate"), F.lit(float("inf"))) * F.col(weight))
    chance = joined.join(rates, tile, "left").withColumn("__p", F.greatest(F.lit(0.0), p))
    cum = along(chance, [tile], order, {"__cum": running_sum(F.col("__p"))})
    steps = lambda c: F.ceil(F.round(c - 0.5, 6))
    picked = steps(F.col("__cum")) > steps(F.col("__cum") - F.col("__p"))
    return cum.filter(picked).select(*rows.columns, F.col("__p").alias("probability"))


def round_robin(
    rows: DataFrame, cell: Sequence[str], subcell: str, quality: str, ident: str, budget: int
) -> DataFrame:
    """Quality-weighted turns: every cell shows its distinct sub-cells before repeats.

    A row's priority is its turn divided by the cell's weight; the ``budget`` lowest
    are kept, and rows tied at the limit are spread evenly over the sorted cells.
    """
    best_first = [F.col(quality).desc(), F.col(ident)]
    fine = along(rows, [*cell, subcell], best_first, {"__fine": number()})
    turns = along(
        fine, list(cell), [F.col("__fine"), F.col(quality).desc(), F.col(subcell), F.col(ident)],
        {"turn": number()},
    )
    best = turns.filter("turn = 1").select(*cell, F.col(quality).alias("__best"))
    ranked = turns.join(best, list(cell)).withColumn(
        "priority", F.round(F.col("turn") / (0.35 + 0.65 * F.col("__best")), 9)
    )
    steps = along(
        ranked.groupBy("priority").agg(F.count(F.lit(1)).alias("__n")), [], [F.col("priority")],
        {"__upto": running_sum(F.col("__n"))},
    )
    edge = steps.filter(F.col("__upto") >= budget).agg(
        F.min_by(F.struct(F.col("priority").alias("p"), F.col("__n").alias("tied"), (F.col("__upto") - F.col("__n")).alias("below")), "priority").alias("__edge")
    )
    marked = attach(ranked, [], edge)
    keep = marked.filter(F.col("__edge").isNull() | (F.col("priority") < F.col("__edge.p")))
    tied = along(
        marked.filter(F.col("priority") == F.col("__edge.p")), [],
        [*[F.col(c) for c in cell], F.col("turn")], {"__at": number()},
    )
    missing = F.lit(budget) - F.col("__edge.below")
    spaced = tied.filter(_evenly(F.col("__at") - 1, missing, F.col("__edge.tied"))).drop("__at")
    cols = [*rows.columns, "turn", "priority"]
    return keep.select(*cols).union(spaced.select(*cols))


def _evenly(index: Column, want: Column, have: Column) -> Column:
    """Whether 0-based ``index`` is one of ``floor((k + 0.5) * have / want)``, k < want."""
    # k is the smallest with (k + 0.5) * have / want >= index.
    k = F.greatest(F.lit(0), F.ceil(F.round((2 * index * want - have) / (2 * have), 9)))
    return (k < want) & (F.floor((2 * k + 1) * have / (2 * want)) == index)


def evenly_spaced(rows: DataFrame, order: Sequence[Column], want: Column | int, having: DataFrame | None = None) -> DataFrame:
    """``want`` rows spread evenly over the ordered table."""
    want = F.lit(want) if isinstance(want, int) else want
    placed = along(rows, [], order, {"__at": number(), "__have": group_size()})
    return placed.filter(_evenly(F.col("__at") - 1, want, F.col("__have"))).drop("__at", "__have")


def linspace_sample(rows: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """Rows at ``floor(linspace(0, n - 1, most))`` when the table is larger than ``most``."""
    placed = along(rows, [], order, {"__at": number(), "__n": group_size()})
    i, last, gaps = F.col("__at") - 1, F.col("__n") - 1, most - 1
    # Row i is a sample position when the smallest k with k * last / gaps >= i lands on it.
    k = F.floor((i * gaps + last - 1) / last)
    hit = (k <= gaps) & (F.floor(k * last / gaps) == i)
    return placed.filter((F.col("__n") <= most) | hit).drop("__at", "__n")


def grid_top_k(rows: DataFrame, x: Column, y: Column, distance: str, ident: str, k: int, side: int = 4) -> DataFrame:
    """Best ``k`` rows with at most ``ceil(k / side²)`` per cell, filled up by distance.

    ``x`` and ``y`` are relative positions in [0, 1].
    """
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(c * side))).cast("int")
    cap = max(1, -(-k // (side * side)))
    placed = along(
        rows.withColumns({"__cx": cell(x), "__cy": cell(y)}), ["__cx", "__cy"],
        [F.col(distance), F.col(ident)], {"__rank": number()},
    )
    return (
        placed.withColumn("over_cap", F.col("__rank") > cap)
        .orderBy("over_cap", distance, ident).limit(k).drop("__cx", "__cy", "__rank")
    )


def hash_order(ident: str, seed: int = 42) -> list[Column]:
    """A seeded order without relation to the data: SHA-2 of seed and id, then the id."""
    return [F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")), 256), F.col(ident)]


def bottom_k(rows: DataFrame, ident: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` uniform rows: the lowest hashes.  Samples of parts merge by the same rule."""
    return rows.orderBy(*hash_order(ident, seed)).limit(k)


def balanced_sample(rows: DataFrame, frame: str, ident: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most // frames`` rows per frame in hash order."""
    order = hash_order(ident, seed)
    frames = rows.select(frame).distinct().agg(F.count(F.lit(1)).alias("__frames"))
    ranked = along(rows, [frame], order, {"__rank": number()})
    share = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("__frames")))
    return (
        attach(ranked, [], frames).filter(F.col("__rank") <= share)
        .drop("__rank", "__frames").orderBy(*order).limit(most)
    )


def label_ranges(rows: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """Half-open row ranges per label after ordering by label; labels without rows are empty."""
    counted = labels.join(rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows")), label, "left").fillna(0, ["rows"])
    out = along(counted, [], [F.col(label)], {"end": running_sum(F.col("rows"))})
    return out.select(label, (F.col("end") - F.col("rows")).alias("start"), "end")


def overlapping_chunks(rows: DataFrame, index: str, size: int, overlap: int, total: Column) -> DataFrame:
    """Every row once per chunk that covers it; chunks start every ``size - overlap`` rows."""
    step = size - overlap
    chunks = F.when(total <= size, F.lit(1)).otherwise(F.ceil((total - overlap) / F.lit(step)))
    first = F.greatest(F.lit(0), F.floor((F.col(index) - size) / F.lit(step)) + 1)
    last = F.least(chunks - 1, F.floor(F.col(index) / F.lit(step)))
    return rows.withColumn("chunk", F.explode(F.sequence(first, last)))


def bounded_exchange(
    baseline: DataFrame, pool: DataFrame, tile: str, cell: str, macro: str, quality: str, ident: str,
    safe_order: Sequence[Column],
) -> tuple[DataFrame, DataFrame]:
    """Swap at most 1/16 of each tile of a baseline for the best rows of new cells.

    Returns the removed and the added rows, equally many.  ``baseline.safe`` marks
    rows that may go.  Additions visit macro cells in turns; when the last turn is
    short it is spread evenly.
    """
    sized = with_aggregates(baseline, [tile], __tile_n=F.count(F.lit(1)))
    ranked = along(sized.filter("safe"), [tile], safe_order, {"__rank": number()})
    removable = ranked.filter(F.col("__rank") <= F.floor(F.col("__tile_n") / 16)).drop("__tile_n")
    novel = pool.join(baseline.select(cell).distinct(), cell, "left_anti")
    row = F.struct(*[c for c in pool.columns if c != cell])
    best = novel.groupBy(cell).agg(F.max_by(row, F.struct(F.col(quality), -F.col(ident))).alias("r")).select(cell, "r.*")
    counts = removable.agg(F.count(F.lit(1)).alias("__have")).select(
        "__have", best.agg(F.count(F.lit(1))).scalar().alias("__new")
    ).select("__have", F.least("__have", "__new").alias("__swap"))
    positions = along(removable, [], [F.col(tile), *safe_order], {"__at": number()})
    removed = attach(positions, [], counts).filter(_evenly(F.col("__at") - 1, F.col("__swap"), F.col("__have")))
    layered = along(best, [macro], [F.col(quality).desc(), F.col(ident)], {"__layer": number()})
    sizes = along(
        layered.groupBy("__layer").agg(F.count(F.lit(1)).alias("__size")), [], [F.col("__layer")],
        {"__before": running_sum(F.col("__size"), strict=True)},
    )
    turns = attach(layered.join(sizes, "__layer"), [], counts)
    left = F.col("__swap") - F.col("__before")
    inside = along(turns.filter(left > 0), ["__layer"], [F.col(macro)], {"__at": number()})
    added = inside.filter((F.col("__size") <= left) | _evenly(F.col("__at") - 1, left, F.col("__size")))
    return removed.select(*baseline.columns), added.select(*pool.columns)


def uniform(*key: Column) -> Column:
    """A number between 0 and 1 from the hash of the key, the same on every run."""
    digits = F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def draw_order(weight: Column, *key: Column) -> Column:
    """Exponential keys: the n lowest are a draw of n without replacement, by weight (null: never drawn)."""
    return F.when(weight > 0, -F.log(uniform(*key)) / weight)


def weighted_draw(rows: DataFrame, keys: Sequence[str], weight: str, ident: str, n: str, most: int, name: str = "pos") -> DataFrame:
    """``n`` rows of each group (at most ``most``), drawn without replacement by weight, numbered in drawing order.

    A group with fewer than ``n`` rows of positive weight is drawn evenly.  Only ``most`` rows of a group leave a task.
    """
    positive = F.count_if(F.col(weight) > 0)
    known = with_aggregates(rows, keys, __some=positive)
    even = F.when(F.col("__some") >= F.col(n), F.col(weight)).otherwise(F.lit(1.0))
    keyed = known.withColumn("__draw", draw_order(even, *[F.col(k) for k in keys], F.col(ident))).filter("__draw IS NOT NULL")
    return top_k(keyed, keys, [F.col("__draw"), F.col(ident)], most, name).filter(F.col(name) <= F.col(n)).drop("__draw", "__some")


def box_points(boxes: DataFrame, keys: Sequence[str], sides: Sequence[str], budget: str, sigma: float, cut: float, factor: int = 4) -> DataFrame:
    """Points of each box, drawn by the Gaussian weight of their place from an even grid of about ``factor`` candidates a point.

    ``sides`` name left, top, right and bottom.  A box's candidates follow from its row alone, so nothing is shuffled; a task
    draws about ``DRAWN`` candidates at a time, with the keys of ``draw_order``.
    """
    edge = F.greatest(F.floor(F.sqrt(F.col(budget) * factor)).cast("int"), F.lit(1))
    named = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(""))
    rows = boxes.filter(F.col(budget) > 0).select(
        *keys, *[F.col(c).cast("double").alias(f"__s{i}") for i, c in enumerate(sides)],
        F.col(budget).cast("int").alias("__n"), edge.alias("__edge"), named.alias("__key"),
    )
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("x", "y")]])

    def grid(e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.arange(e * e)
        u, v = ((k % e) / (e - 1), (k // e) / (e - 1)) if e > 1 else (np.zeros(1), np.zeros(1))
        square = (2 * u - 1) * (2 * u - 1) + (2 * v - 1) * (2 * v - 1)
        return u, v, np.where(np.sqrt(square) <= sigma * cut, np.exp(-square / (2 * sigma * sigma)), 0.0)

    def draw(rows: pa.RecordBatch, n: int, e: int) -> tuple[np.ndarray, ...]:
        """For boxes of one budget and grid: the drawn places, in drawing order."""
        u, v, w = grid(e)
        k = np.flatnonzero(w > 0)
        if len(k) < n:
            k, w = np.arange(e * e), np.ones(e * e)
        tails = [str(i).encode() for i in k]
        digests = b"".join([md5(key + t).digest()[:6] for key in map(str.encode, rows.column("__key").to_pylist()) for t in tails])
        places = np.frombuffer(digests, np.uint8).reshape(rows.num_rows, len(k), 6).astype(np.int64) @ (256 ** np.arange(5, -1, -1, dtype=np.int64))
        order = np.argsort(-np.log((places + 0.5) / float(16**12)) / w[k], axis=1, kind="stable")[:, :n]
        return order.shape[1], u[k][order].ravel(), v[k][order].ravel()

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, e = batch.column("__n").to_numpy(), batch.column("__edge").to_numpy()
            for one in np.unique(np.stack([n, e], axis=1), axis=0).tolist():
                places = np.flatnonzero((n == one[0]) & (e == one[1]))
                step = max(1, DRAWN // (one[1] * one[1]))
                for at in range(0, len(places), step):
                    part = batch.take(pa.array(places[at:at + step]))
                    width, u, v = draw(part, *one)
                    owner = np.repeat(np.arange(part.num_rows), width)
                    left, top, right, bottom = [part.column(f"__s{i}").to_numpy(zero_copy_only=False)[owner] for i in range(4)]
                    null = [part.column(f"__s{i}").is_null().to_numpy(zero_copy_only=False)[owner] for i in range(4)]
                    kept = part.select(list(keys)).take(pa.array(owner))
                    pos = pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), part.num_rows))
                    xy = [pa.array(left + (right - left) * u, mask=null[0] | null[2]), pa.array(top + (bottom - top) * v, mask=null[1] | null[3])]
                    yield pa.RecordBatch.from_arrays([*kept.columns, pos, *xy], names=[*keys, "pos", "x", "y"])

    return rows.mapInArrow(drawn, schema)


def area_shares(regions: DataFrame, group: Sequence[str], key: str, area: str, budget: int) -> DataFrame:
    """Each group's budget split by area: whole parts first, what is left to the largest remainders (ties by key).

    A group without any area gets nothing.
    """
    known = with_aggregates(regions, group, __all=F.sum(area))
    exact = F.when(F.col("__all") > 0, F.col(area) * budget / F.col("__all")).otherwise(F.lit(0.0))
    split = known.withColumn("__exact", exact).withColumns({"__base": F.floor("__exact"), "__over": F.round(F.col("__exact") - F.floor("__exact"), 9)})
    turn = along(split, list(group), [F.desc("__over"), F.col(key)], {"__turn": number(), "__given": group_sum(F.col("__base"))})
    extra = (F.col("__all") > 0) & (F.col("__turn") <= F.lit(budget) - F.col("__given"))
    return turn.select(*group, key, area, (F.col("__base") + extra.cast("long")).cast("long").alias("share"))


def hash_sample(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """The first ``quota`` rows of each group in hash order: the default of ``shared_sample``."""
    placed = along(rows, [key], [uniform(F.col(ident)), F.col(ident)], {"__place": number()})
    return placed.filter(F.col("__place") <= F.col("quota")).drop("__place")


def shared_sample(rows: DataFrame, key: str, ident: str, budget: int, sampler: Callable[[DataFrame, str, str], DataFrame] = hash_sample) -> DataFrame:
    """At most ``budget`` rows, shared equally between groups; what small groups leave goes to the others.

    ``sampler(rows, key, ident)`` chooses rows inside the quotas: it gets all rows with their group's ``quota`` and must not
    return more than that; a group with more fails.
    """
    quotas = equal_quota(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__cap")), key, "__cap", budget)
    chosen = sampler(rows.join(quotas.select(key, "quota"), key), key, ident)
    counted = with_aggregates(chosen, [key], __taken=F.count(F.lit(1)))
    over = F.when(F.col("__taken") > F.col("quota"), F.raise_error("the sampler took more rows than its quota").cast("boolean"))
    return counted.filter(F.coalesce(over, F.lit(True))).select(rows.columns)
