"""Group statistics: exact quantiles and statistics attached to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyview.plans.scan import group_fits
from polyview.session import cut

BUCKETS = 4096


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: dict[str, float],
    fits: bool | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per group.

    Groups within the window limit use the built-in ``percentile`` aggregate, which
    keeps a map of distinct values in memory.  For larger groups histograms narrow down to
    the wanted ranks (see ``_at_ranks``).
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("__v")).filter("__v IS NOT NULL")
    if fits is None:
        fits = group_fits(rows, keys)
    if fits:
        array = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs.values()]))
        grouped = rows.groupBy(*keys).agg(array.alias("__q"))
        return grouped.select(
            *keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)]
        )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    places = [f(F.lit(float(p)) * (F.col("__all") - 1)) for p in probs.values() for f in (F.floor, F.ceil)]
    ranks = sizes.withColumn("__rank", F.explode(F.array_distinct(F.array(*places))))
    found = _at_ranks(rows, keys, ranks)
    out = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("__all") - 1)
        lo, hi = [F.element_at("__at", f(rank)) for f in (F.floor, F.ceil)]
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    listed = found.groupBy(*keys).agg(F.max("__all").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__rank", "__lo"))).alias("__at"))
    return listed.select(*keys, *out)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``names``, which stay once."""
    renamed = right.select(*[F.col(n).alias(f"__r_{n}") if n in names else F.col(n) for n in right.columns])
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__r_{n}"))
    return left.join(renamed if names else F.broadcast(renamed), on, how).drop(*[f"__r_{n}" for n in names])


def _at_ranks(rows: DataFrame, keys: Sequence[str], ranks: DataFrame) -> DataFrame:
    """The values at ``ranks(keys, __all, __lo, __hi, __rank)`` in the column ``__lo``, by histograms that narrow down.

    A pass counts the values of each open range in ``BUCKETS`` equal parts, map-side, and goes on with the least and the largest value of
    the part that holds the rank.  These two stand in different parts of the next pass, so ranges shrink until they hold one
    value; neither all values nor all distinct values of a group ever meet.  Without keys there are two ranges a quantile at most.
    """
    state = cut(ranks.withColumn("__below", F.lit(0).cast("long")))
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    part = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BUCKETS)
    part = F.when(v == lo, 0).when(v == hi, BUCKETS - 1).when(F.isnan((v / 2 - lo / 2) / (hi / 2 - lo / 2)), BUCKETS // 2).otherwise(F.least(part, F.lit(BUCKETS - 1)))
    ends = ["__lo", "__hi"]
    while not (open_ := state.filter("__lo < __hi")).isEmpty():
        inside = _same(rows, open_.select(*keys, *ends).distinct(), keys).filter((v >= lo) & (v <= hi))
        counted = inside.groupBy(*keys, *ends, part.cast("int").alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        before = Window.partitionBy(*keys, *ends).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        place = F.col("__rank") - F.col("__below")
        narrowed = _same(open_, counted, [*keys, *ends]).filter((place >= F.col("__before")) & (place < F.col("__before") + F.col("__n")))
        narrowed = narrowed.select(*keys, "__all", F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), "__rank", (F.col("__below") + F.col("__before")).alias("__below"))
        state = cut(state.filter("NOT __lo < __hi").unionByName(narrowed))
    return state


def attach(df: DataFrame, keys: Sequence[str], per_group: DataFrame) -> DataFrame:
    """Join per-group statistics back to the rows.

    The aggregate was combined map-side, so no group ever meets in one task; the
    join back splits hot keys by AQE.  Without keys the statistics are a single row
    and become a scalar subquery.
    """
    if keys:
        return df.join(per_group, list(keys), "left")
    names = per_group.columns
    one = per_group.select(F.struct(*names).alias("s"))
    return (
        df.withColumn("__s", one.scalar())
        .withColumns({n: F.col(f"__s.{n}") for n in names})
        .drop("__s")
    )


def with_aggregates(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group aggregates as extra columns of every row."""
    named = [c.alias(n) for n, c in aggs.items()]
    grouped = df.groupBy(*keys).agg(*named) if keys else df.agg(*named)
    return attach(df, keys, grouped)


def with_quantiles(df, keys, value, probs, fits=None):
    return attach(df, keys, quantiles(df, keys, value, probs, fits))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num, den))


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column], fits: bool | None = None) -> DataFrame:
    """Medians of several columns per group, in one pass while groups are small."""
    keys = list(keys)
    if fits is None:
        fits = group_fits(df.select(*keys), keys)
    if fits:
        return df.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(n) for n, c in values.items()])
    out = None
    for name, col in values.items():
        one = quantiles(df, keys, col, {name: 0.5}, fits=False)
        out = one if out is None else out.join(one, keys)
    return out
