"""Ordered lookups, intervals and set operations on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.plans.scan import (
    along, group_fits, group_size, lagged, last_seen, leading, next_seen, numbered, running_max, running_sum,
)
from polyview.plans.stats import attach, ratio


def average_rank(rows: DataFrame, value: str) -> DataFrame:
    """(average rank - 1) / (n - 1) of each value; a single row has 1.

    Ranks come from the per-value counts, so the ordered scan runs over distinct
    values only.
    """
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    scanned = along(counted, [], [F.col(value)], {"__before": running_sum(F.col("__c"), strict=True)})
    total = scanned.agg(F.sum("__c").alias("__n"))
    placed = attach(scanned, [], total)
    mean_rank = F.col("__before") + (F.col("__c") + 1) / 2
    pct = F.when(F.col("__n") == 1, F.lit(1.0)).otherwise(F.try_divide(mean_rank - 1, F.col("__n") - 1))
    return rows.join(placed.select(value, pct.alias("rank_pct")), value)


def depth_breaks(grid: DataFrame, line: Sequence[str], along_axis: str, spacing: float) -> DataFrame:
    """Whether a break lies between each pixel and the next one along an axis."""
    step = along(
        grid, line, [F.col(along_axis)],
        {"__d": leading(F.col("depth")), "__v": leading(F.col("valid"))},
    )
    pair = F.coalesce(F.col("valid") & F.col("__v"), F.lit(False))
    diff = F.when(pair, F.abs(F.col("__d") - F.col("depth")))
    gaps = step.withColumns({"__pair": pair, "__diff": diff}).filter("__v IS NOT NULL")
    near = along(
        gaps, line, [F.col(along_axis)],
        {"__prev": lagged(F.col("__diff")), "__next": leading(F.col("__diff"))},
    )
    slope = F.coalesce(F.least("__prev", "__next"), F.lit(0.0))
    tolerance = F.greatest(F.lit(2.0 * spacing), 0.005 * F.least("depth", "__d"))
    broken = ~F.col("__pair") | F.coalesce(F.col("__diff") > tolerance + 3 * slope, F.lit(False))
    return near.select(*line, along_axis, broken.alias("broken"))


def break_distance(breaks: DataFrame, line: Sequence[str], axis: str, low: float = 0.5, high: float = 8.0) -> DataFrame:
    """Distance of each pixel to the nearest break on its line, scaled and clipped.

    ``breaks`` has one row per gap; a gap at position p lies between p and p + 1.
    """
    at = F.when(F.col("broken"), F.col(axis) + 0.5)
    # Every pixel but the last of a line has a gap row; the last is added from it.
    tail = breaks.groupBy(*line).agg((F.max(axis) + 1).cast("int").alias(axis))
    ends = tail.withColumnRenamed(axis, "__last")
    pixels = breaks.select(*line, axis, at.alias("__at")).unionByName(
        tail.withColumn("__at", F.lit(None).cast("double"))
    )
    seen = along(
        pixels, line, [F.col(axis)],
        {"__left": last_seen(F.col("__at"), strict=True), "__right": next_seen(F.col("__at"))},
    ).join(ends, list(line))
    pos = F.col(axis)
    cap = F.least(pos - F.coalesce("__left", F.lit(0.0)), F.coalesce("__right", F.col("__last")) - pos)
    scaled = cap * (0.95 / 1.05)
    return seen.select(*line, axis, F.least(F.lit(high), F.greatest(F.lit(low), scaled)).alias("cap"))


def merge_intervals(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of touching or overlapping intervals per key; empty ones are dropped."""
    solid = rows.filter(F.col(start) < F.col(end)).select(*keys, start, end).distinct()
    order = [F.col(start), F.col(end)]
    fits = group_fits(rows, keys)
    reach = along(solid, keys, order, {"__reach": running_max(F.col(end), strict=True)}, fits)
    opens = (F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))).cast("long")
    islands = along(reach.withColumn("__open", opens), keys, order, {"__island": running_sum(F.col("__open"))}, fits)
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def visibility_delta(before: DataFrame, after: DataFrame, ranges: DataFrame, ident: str) -> DataFrame:
    """Merged row ranges of ids whose visibility changed, with the new value."""
    both = before.select(ident, F.lit(True).alias("__b")).join(
        after.select(ident, F.lit(True).alias("__a")), ident, "full_outer"
    )
    changed = both.filter("__a IS NULL OR __b IS NULL").select(
        ident, F.when(F.col("__a").isNull(), 0).otherwise(1).alias("visible")
    )
    return merge_intervals(changed.join(ranges, ident), ["visible"], "start", "end")


def neighbours(rows: DataFrame, ident: str) -> DataFrame:
    """Previous and next id in visible order."""
    return along(rows, [], [F.col(ident)], {"previous_id": lagged(F.col(ident)), "next_id": leading(F.col(ident))})


def interval_lookup(points: DataFrame, at: str, intervals: DataFrame, owner: str) -> DataFrame:
    """Owner of the half-open interval holding each position; null in gaps.

    Intervals do not overlap.  Both tables are merged into one order, and every
    position reads the last interval opened at or before it.
    """
    packed = F.struct(F.col("end").alias("end"), F.col(owner).alias("owner"))
    opened = intervals.select(
        F.col("start").alias("__pos"), F.lit(0).alias("__side"), packed.alias("__iv"), F.lit(None).cast("long").alias("__at")
    )
    asked = points.select(F.col(at).cast("long").alias("__at")).distinct().select(
        F.col("__at").alias("__pos"), F.lit(1).alias("__side"),
        F.lit(None).cast(opened.schema["__iv"].dataType).alias("__iv"), "__at",
    )
    merged = along(opened.union(asked), [], [F.col("__pos"), F.col("__side")], {"__last": last_seen(F.col("__iv"))})
    found = merged.filter("__side = 1").select(
        F.col("__at").alias(at), F.when(F.col("__at") < F.col("__last.end"), F.col("__last.owner")).alias(owner)
    )
    return points.join(found, at, "left")


def nearest_second(rows: DataFrame, ts: str, ident: str, step: float = 1.0) -> DataFrame:
    """For each whole second (or ``step``) from the first row, the row nearest in time.

    The candidates of a target are the last row at or before it and the first row
    after it; the earlier row wins a tie.
    """
    t0, t1 = rows.agg(F.min(ts), F.max(ts)).first()
    if t0 is None:  # no rows, no targets
        t0 = t1 = 0.0
        targets = rows.sparkSession.range(0)
    else:
        targets = rows.sparkSession.range(int((t1 - t0) // step) + 1)
    targets = targets.select(
        F.col("id").alias("second"), (F.lit(t0) + F.col("id") * float(step)).alias("__pos")
    )
    packed = F.struct(F.col(ts).alias("t"), F.col(ident).alias("i"))
    timed = rows.groupBy(ts).agg(F.min(ident).alias(ident)).select(
        F.col(ts).alias("__pos"), F.lit(0).alias("__side"), packed.alias("__row"), F.lit(None).cast("long").alias("second")
    )
    asked = targets.select(
        "__pos", F.lit(1).alias("__side"), F.lit(None).cast(timed.schema["__row"].dataType).alias("__row"), "second"
    )
    merged = along(
        timed.union(asked), [], [F.col("__pos"), F.col("__side"), F.col("second")],
        {"__prev": last_seen(F.col("__row")), "__next": next_seen(F.col("__row"))},
    ).filter("__side = 1")
    back, ahead = F.col("__pos") - F.col("__prev.t"), F.col("__next.t") - F.col("__pos")
    use_prev = F.col("__next").isNull() | (back <= ahead)
    pick = F.when(use_prev, F.col("__prev")).otherwise(F.col("__next"))
    return merged.select("second", pick["i"].alias(ident), F.least(back, F.coalesce(ahead, back)).alias("gap"))


def frame_alignment(a: DataFrame, b: DataFrame, ident: str) -> DataFrame:
    """Counts, coverage and perfect alignment of two id lists ``(ident, seq)``."""
    sides = a.groupBy(ident).agg(F.count(F.lit(1)).alias("na")).join(
        b.groupBy(ident).agg(F.count(F.lit(1)).alias("nb")), ident, "full_outer"
    )
    has_a, has_b = F.col("na").isNotNull(), F.col("nb").isNotNull()
    return sides.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("a_rows"), F.coalesce(F.sum("nb"), F.lit(0)).alias("b_rows"),
        F.count_if(has_a & has_b).alias("common"), F.count_if(has_a & ~has_b).alias("a_only"),
        F.count_if(~has_a & has_b).alias("b_only"),
        ratio(F.count_if(has_a & has_b), F.greatest(F.count_if(has_a), F.count_if(has_b))).alias("coverage"),
        (F.count_if(~(has_a & has_b)) == 0).alias("aligned"),
    )


def order_matches(a: DataFrame, b: DataFrame, ident: str, seq: str) -> DataFrame:
    """Whether ``a`` in its own order is exactly the sorted list of the common ids."""
    common = a.join(b.select(ident).distinct(), ident, "left_semi")
    steps = along(a, [], [F.col(seq)], {"__prev": lagged(F.col(ident))})
    sorted_ = steps.agg(F.coalesce(F.bool_and(F.col("__prev").isNull() | (F.col("__prev") < F.col(ident))), F.lit(True)).alias("ok"))
    return sorted_.select(
        (F.col("ok") & (a.agg(F.count(F.lit(1))).scalar() == common.agg(F.count(F.lit(1))).scalar())).alias("order_matches")
    )


def aligned_ids(a: DataFrame, b: DataFrame, ident: str, strict: bool = False) -> DataFrame:
    """The repaired list: common ids, to be read in id order.

    Without any common id the list is empty; ``strict`` makes that an error, which one small job finds out.
    """
    if strict and a.select(ident).join(b.select(ident), ident, "left_semi").isEmpty():
        raise ValueError(f"no {ident} is in both lists, nothing can be aligned")
    return a.select(ident).distinct().join(b.select(ident).distinct(), ident, "left_semi")


def frame_pairs(frames: DataFrame, keys: Sequence[str], index: str, mode: str, width: int = 1) -> DataFrame:
    """Planned frame pairs: ``next`` ring, ``window`` of following frames, ``all`` ordered pairs, or ``combinations``.

    The last two are quadratic in a sequence's frames by definition.
    """
    sized = along(frames, keys, [F.col(index)], {"__n": group_size()})
    i = F.col(index)
    if mode == "next":
        j = F.when(i + 1 < F.col("__n"), i + 1).otherwise(F.lit(0))
        return sized.filter("__n > 1").select(*keys, i.alias("i"), j.cast("int").alias("j"))
    if mode == "window":
        last = F.least(i + width, F.col("__n").cast("int") - 1)
        return sized.filter(last > i).select(*keys, i.alias("i"), F.explode(F.sequence(i + 1, last)).alias("j"))
    if mode == "all":
        every = F.sequence(F.lit(0), F.col("__n").cast("int") - 1)
        return sized.select(*keys, i.alias("i"), F.explode(every).alias("j")).filter("i <> j")
    if mode == "combinations":
        return sized.filter(i + 1 < F.col("__n")).select(*keys, i.alias("i"), F.explode(F.sequence(i + 1, F.col("__n").cast("int") - 1)).alias("j"))
    raise ValueError(f"unknown pair mode {mode}")


def first_source_wins(shards: DataFrame, keys: Sequence[str], shard: str) -> DataFrame:
    """All rows of the first shard in which a key occurs."""
    first = shards.groupBy(*keys).agg(F.min(shard).alias(shard))
    return shards.join(first, [*keys, shard], "left_semi")


def dense_pair_ids(tables: Sequence[DataFrame], pair: Sequence[str], name: str = "pair_id") -> DataFrame:
    """Numbers 1..n for the sorted distinct pairs over all tables."""
    pairs = None
    for t in tables:
        part = t.select(*pair).distinct()
        pairs = part if pairs is None else pairs.union(part)
    return numbered(pairs.distinct(), [F.col(c) for c in pair], name)


def record_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct records of two tables: each, common, one-sided, and overlap share."""
    cols = a.columns
    tagged = a.select(*cols, F.lit(1).alias("__a"), F.lit(0).alias("__b")).union(
        b.select(*cols, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    per = tagged.groupBy(*cols).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
    count = lambda c: F.sum(c.cast("long"))
    a_, b_ = F.col("a") == 1, F.col("b") == 1
    return per.agg(
        count(a_).alias("a_records"), count(b_).alias("b_records"), count(a_ & b_).alias("common"),
        count(a_ & ~b_).alias("a_only"), count(b_ & ~a_).alias("b_only"),
        ratio(count(a_ & b_), count(a_)).alias("overlap"),
    )


def repair_track_ids(rows: DataFrame, video: str, track: str) -> DataFrame:
    """New ids, after the maximum, for track ids used in more than one video."""
    pairs = rows.select(video, track).distinct()
    shared = pairs.groupBy(track).agg((F.count(F.lit(1)) > 1).alias("__shared"))
    clashing = pairs.join(shared.filter("__shared").select(track), track, "left_semi")
    fresh = attach(
        numbered(clashing, [F.col(track), F.col(video)], "__i"), [], rows.agg(F.max(track).alias("__max"))
    ).select(video, track, (F.col("__max") + F.col("__i")).alias("__new"))
    return rows.join(fresh, [video, track], "left").withColumn("new_track", F.coalesce("__new", track)).drop("__new")


def densest_window(rows: DataFrame, value: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Start and row count of the fullest window of a given width; the lowest start wins.

    The rows up to ``v + width`` minus the rows below ``v``: both counts are read from
    one running sum over the distinct values and their window ends.
    """
    keys = list(keys)
    counted = rows.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    starts = counted.select(*keys, F.col("__v").alias("__pos"), F.lit(0).alias("__side"), "__c", "__v")
    ends = counted.select(*keys, (F.col("__v") + width).alias("__pos"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__c"), "__v")
    scanned = along(
        starts.union(ends), keys, [F.col("__pos"), F.col("__side"), F.col("__v")],
        {"__cum": running_sum(F.col("__c"))},
    )
    spans = scanned.groupBy(*keys, "__v").agg(
        (F.sum(F.when(F.col("__side") == 1, F.col("__cum")))
         - F.sum(F.when(F.col("__side") == 0, F.col("__cum") - F.col("__c")))).alias("rows")
    )
    best = F.max_by(F.struct(F.col("__v").alias("start"), "rows"), F.struct("rows", -F.col("__v"))).alias("b")
    out = spans.groupBy(*keys).agg(best) if keys else spans.agg(best)
    return out.select(*keys, "b.start", "b.rows")
