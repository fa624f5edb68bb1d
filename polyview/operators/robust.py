"""Robust statistics: distributions, spill, weights, sensitivity, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.plans.scan import along, group_sum, number, running_sum
from polyview.plans.stats import attach, medians, quantiles, with_aggregates, with_quantiles


def distribution(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Count, min, p50, p95 and max with linear interpolation; empty groups have nulls."""
    named = rows.select(*keys, value.alias("__v"))
    ends = [F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")]
    base = named.groupBy(*keys).agg(*ends) if keys else named.agg(*ends)
    return attach(base, keys, quantiles(named, keys, F.col("__v"), {"p50": 0.5, "p95": 0.95}))


def spill_flags(rows: DataFrame, keys: Sequence[str], value: str, factor: float = 1.10) -> DataFrame:
    """Whether a row lies beyond ``factor`` times its group's median."""
    with_median = with_quantiles(rows, keys, F.col(value), {"__median": 0.5})
    return with_median.withColumn("spill", F.col(value) > factor * F.col("__median")).drop("__median")


def spill_trim(rows: DataFrame, keys: Sequence[str], value: str, factor: float = 1.10, most: float = 0.30) -> DataFrame:
    """Drop spilled rows of groups whose spill share is at most ``most``."""
    flagged = spill_flags(rows, keys, value, factor)
    shared = with_aggregates(flagged, keys, __share=F.avg(F.col("spill").cast("double")))
    return shared.filter(~F.col("spill") | (F.col("__share") > most)).drop("spill", "__share")


def adaptive_threshold(rows: DataFrame, value: str, floor: float = 1.05) -> DataFrame:
    """Rows at or above ``min(max(floor, p40), p90)``, with the threshold."""
    cut = quantiles(rows, [], F.col(value), {"__p40": 0.4, "__p90": 0.9})
    limit = cut.select(F.least(F.greatest(F.lit(floor), "__p40"), F.col("__p90")).alias("threshold"))
    return attach(rows, [], limit).filter(F.col(value) >= F.col("threshold"))


def clipped_weight(rows: DataFrame, value: str) -> DataFrame:
    """Value over the overall median, clipped to [0.25, 1]."""
    v, m = F.col(value), F.col("__median")
    flat = F.when(v > 0, 1.0).otherwise(0.25)
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.25), F.try_divide(v, m)))
    return with_quantiles(rows, [], v, {"__median": 0.5}).withColumn(
        "weight", F.when(m <= 0, flat).otherwise(scaled)
    ).drop("__median")


def robust_bounds(rows: DataFrame, axes: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Low and high quantile and median of each axis, in one row."""
    out = None
    for a in axes:
        one = quantiles(rows, [], F.col(a), {f"{a}_low": low, f"{a}_mid": 0.5, f"{a}_high": high})
        out = one if out is None else attach(out, [], one)
    return out


def centred(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Coordinates relative to the per-axis medians."""
    mids = medians(rows, [], {f"__{a}": F.col(a) for a in axes})
    placed = attach(rows, [], mids)
    return placed.withColumns({a: F.col(a) - F.col(f"__{a}") for a in axes}).drop(*[f"__{a}" for a in axes])


def weighted_scale(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], quantile: float = 0.9, power: float = 2.0
) -> DataFrame:
    """Weighted quantiles of depth ratios per chunk pair, from ``depth1/2`` and ``conf1/2``.

    Weights are the confidence product to a power; rows under a tenth of either side's
    median confidence or outside the depth range do not count.  Fewer than 100 rows or
    an implausible result gives scale 1.
    """
    keys = list(keys)
    mids = medians(rows, keys, {"__m1": F.col("conf1"), "__m2": F.col("conf2")})
    limit = F.greatest(F.col("__m1") * 0.1, F.col("__m2") * 0.1, F.lit(1e-6))
    good = attach(rows, keys, mids).filter(
        (F.col("conf1") > limit) & (F.col("conf2") > limit)
        & (F.col("depth1") > 1e-3) & (F.col("depth2") > 1e-3)
        & (F.col("depth1") < 100) & (F.col("depth2") < 100)
    )
    weighed = good.withColumns({
        "__w": F.pow(F.col("conf1") * F.col("conf2"), F.lit(power)),
        "__ratio": F.col("depth1") / (F.col("depth2") + 1e-8),
    })
    cum = along(
        weighed, keys, [F.col("__ratio"), *order],
        {"__cum": running_sum(F.col("__w")), "__all": group_sum(F.col("__w"))},
    )
    norm = F.col("__all") + 1e-8
    share = F.col("__w") / norm
    reach = lambda q: F.min_by("__ratio", F.when(F.round(F.col("__cum") / norm, 12) >= q, F.struct("__ratio", "__cum")))
    per = cum.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), reach(0.5).alias("__mid"), reach(quantile).alias("__high"),
        (-F.sum(share * F.ln(share + 1e-8))).alias("__entropy"),
    )
    middle = F.coalesce("__mid", F.lit(1.0))
    high = F.coalesce("__high", middle)
    enough = F.col("n") >= 100
    quality = F.when(F.ln("n") > 0, 1 - F.col("__entropy") / F.ln("n")).otherwise(0.0)
    scaled = per.select(
        *keys, "n",
        F.when(~enough, 1.0).when((high > 0.1) & (high < 10), high).otherwise(1.0).alias("scale"),
        F.when(enough, quality).otherwise(0.0).alias("quality"),
    )
    return rows.select(*keys).distinct().join(scaled, keys, "left").fillna({"n": 0, "scale": 1.0, "quality": 0.0})


def weighted_fusion(rows: DataFrame, cluster: Sequence[str], scale: str, conf: str, ident: str) -> DataFrame:
    """One fused point per cluster from confidence and distance-to-median weights."""
    keys, axes = list(cluster), ("x", "y", "z")
    mids = medians(rows, keys, {**{f"__m{a}": F.col(a) for a in axes}, "__scale": F.col(scale)})
    off = [F.col(a) - F.col(f"__m{a}") for a in axes]
    residual = F.sqrt(sum((o * o for o in off), F.lit(0.0)))
    weight = F.greatest(F.col(conf), F.lit(1e-6)) * F.least(
        F.lit(1.0), F.col("__scale") / F.greatest(residual, F.lit(1e-12))
    )
    weighed = attach(rows, keys, mids).withColumn("__w", F.round(weight, 12))
    w = F.col("__w")
    fused = weighed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support"),
        *[(F.sum(w * F.col(a)) / F.sum(w)).alias(f"f{a}") for a in axes],
        (F.sum(w * F.col(conf)) / F.sum(w)).alias("confidence"),
        F.max_by(ident, F.struct(w, -F.col(ident))).alias("primary_id"),
    )
    gap = F.sqrt(sum(((F.col(a) - F.col(f"f{a}")) * (F.col(a) - F.col(f"f{a}")) for a in axes), F.lit(0.0)))
    moved = rows.select(*keys, *axes).join(fused.select(*keys, *[f"f{a}" for a in axes]), keys)
    far = moved.groupBy(*keys).agg(F.max(gap).alias("displacement"))
    return fused.join(far, keys)


def quality_rules(rows: DataFrame) -> DataFrame:
    """Mark drops by rule: low confidence, weak edge, grazing view, slope middle.

    ``rows(valid, conf, edge, cosine, slope)``; percentiles are over valid rows.
    """
    cut = quantiles(rows.filter("valid"), [], F.col("conf"), {"__p20": 0.2, "__p40": 0.4})
    v = F.col("valid")
    rules = {
        "low_confidence": v & (F.col("conf") < F.col("__p20")),
        "edge_confidence": v & F.col("edge") & (F.col("conf") < F.col("__p40")),
        "grazing": v & (F.col("cosine") < 0.15),
        "mid_slope": v & F.col("slope"),
    }
    marked = attach(rows, [], cut).withColumns(rules).drop("__p20", "__p40")
    any_ = F.col("low_confidence") | F.col("edge_confidence") | F.col("grazing") | F.col("mid_slope")
    return marked.withColumn("drop", any_)


def rule_counts(marked: DataFrame) -> DataFrame:
    names = ["low_confidence", "edge_confidence", "grazing", "mid_slope", "drop"]
    return marked.agg(*[F.count_if(n).alias(n) for n in names])


def retained(marked: DataFrame, label: str, least: float = 0.5) -> DataFrame:
    """Rows to keep; a label that would lose more than half stays whole."""
    kept = with_aggregates(marked, [label], __kept=F.avg((~F.col("drop")).cast("double")))
    return kept.filter(~F.col("drop") | (F.col("__kept") < least)).drop("__kept")


def leave_one_out(rows: DataFrame, group: str, part: str, value: str) -> DataFrame:
    """Group mean and extent with each part removed, and their change.

    Sums, counts and the two outermost extremes of the per-part aggregates are enough,
    so no row is repeated per removed part.
    """
    per = rows.groupBy(group, part).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    full = per.groupBy(group).agg(
        F.sum("n").alias("all_n"), F.sum("s").alias("all_s"),
        F.min(F.struct("lo", part)).alias("low1"), F.max(F.struct("hi", part)).alias("high1"),
    )
    both = per.join(full, group)
    second = both.groupBy(group).agg(
        F.min(F.when(F.col(part) != F.col(f"low1.{part}"), F.col("lo"))).alias("low2"),
        F.max(F.when(F.col(part) != F.col(f"high1.{part}"), F.col("hi"))).alias("high2"),
    )
    j = both.join(second, group)
    low = F.when(F.col(part) == F.col(f"low1.{part}"), F.col("low2")).otherwise(F.col("low1.lo"))
    high = F.when(F.col(part) == F.col(f"high1.{part}"), F.col("high2")).otherwise(F.col("high1.hi"))
    left = F.col("all_n") - F.col("n")
    status = F.when(left < 32, "insufficient").when(left < 64, "weak").otherwise("available")
    mean = F.try_divide(F.col("all_s") - F.col("s"), left)
    return j.select(
        group, part, left.alias("remaining"), status.alias("status"), mean.alias("mean"),
        (mean - F.col("all_s") / F.col("all_n")).alias("mean_delta"),
        ((high - low) - (F.col("high1.hi") - F.col("low1.lo"))).alias("extent_delta"),
    )


def gate_table(rows: DataFrame, ident: str, gates: dict[str, Column], tie_terms: Sequence[Column]) -> DataFrame:
    """Candidates with named gates: score, eligibility and rank among the eligible."""
    passed = F.array(*[F.coalesce(c, F.lit(False)) for c in gates.values()])
    score = F.aggregate(passed, F.lit(0.0), lambda s, g: s + g.cast("double"))
    for t in tie_terms:
        score = score + t
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in gates.items()]))
    out = rows.select(
        ident, F.round(score, 9).alias("score"), F.forall(passed, lambda g: g).alias("eligible"),
        F.concat_ws(",", failed).alias("failed"),
    )
    ranked = along(out.filter("eligible"), [], [F.col("score").desc(), F.col(ident)], {"rank": number()})
    return out.join(ranked.select(ident, "rank"), ident, "left")


def gated_choice(
    gated: DataFrame, ident: str, normal: Sequence[str], near: float = 0.95, close: float = 0.95
) -> DataFrame:
    """The first eligible candidate of a ``gate_table`` with unit normals, and whether it is ambiguous.

    It is, if another eligible candidate of a different orientation (cosine under ``near``) scores at least ``close``
    of the best.  Without eligible candidates there is no row.
    """
    fit = gated.filter("eligible")
    best = fit.agg(F.min_by(F.struct(ident, "score", *normal), F.col("rank")).alias("b"))
    paired = fit.withColumn("b", best.scalar())
    cosine = F.abs(sum((F.col(n) * F.col(f"b.{n}") for n in normal), F.lit(0.0)))
    rival = (F.col(ident) != F.col(f"b.{ident}")) & (cosine < near) & (F.col("score") >= close * F.col("b.score"))
    return paired.groupBy(F.col(f"b.{ident}").alias(ident)).agg(F.bool_or(rival).alias("ambiguous"), F.count_if(rival).alias("rivals"))


def cell_spread(rows: DataFrame, method: str, cell: Sequence[str], height: str, reference: DataFrame, least: int = 3) -> DataFrame:
    """P90 - P10 of heights per (method, cell) on cells every method measured."""
    cells = list(cell)
    inside = rows.join(reference.select(*cells).distinct(), cells, "left_semi")
    spans = quantiles(inside, [method, *cells], F.col(height), {"__lo": 0.1, "__hi": 0.9})
    counts = inside.groupBy(method, *cells).agg(F.count(height).alias("rows")).filter(F.col("rows") >= least)
    spread = counts.join(spans, [method, *cells]).withColumn("spread", F.col("__hi") - F.col("__lo"))
    methods = rows.select(method).distinct().agg(F.count(F.lit(1)).alias("__m"))
    common = attach(spread.groupBy(*cells).agg(F.count(F.lit(1)).alias("__c")), [], methods)
    shared = common.filter(F.col("__c") == F.col("__m")).select(*cells)
    return spread.join(shared, cells, "left_semi").select(method, *cells, "rows", "spread")


def depth_agreement(truth: DataFrame, drawn: DataFrame, keys: Sequence[str], spacing: float) -> DataFrame:
    """Matched, nearer, farther, missing and outside counts per frame and pooled (frame null).

    ``truth(frame, …, depth, valid)`` against ``drawn(frame, …, drawn)``.
    """
    both = truth.join(drawn, list(keys), "full_outer")
    ok = F.coalesce("valid", F.lit(False))
    hit = F.col("drawn").isNotNull()
    tolerance = F.greatest(F.lit(2.0 * spacing), 0.005 * F.col("depth"))
    gap = F.col("drawn") - F.col("depth")
    count = F.count_if
    out = both.rollup("frame").agg(
        count(ok).alias("valid"), count(ok & hit & (F.abs(gap) <= tolerance)).alias("matched"),
        count(ok & hit & (gap < -tolerance)).alias("nearer"), count(ok & hit & (gap > tolerance)).alias("farther"),
        count(ok & ~hit).alias("missing"), count(~ok & hit).alias("outside"), count(~ok).alias("invalid"),
    )
    part = lambda n, d: F.col(n) / F.greatest(F.col(d), F.lit(1))
    return out.withColumns({
        "matched_share": part("matched", "valid"), "missing_share": part("missing", "valid"),
        "outside_share": part("outside", "invalid"),
    })
