"""Nearest-neighbour operators over vectors and points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.plans.knn import nearest
from polyview.plans.octree import nearest_rows
from polyview.plans.stats import attach, with_aggregates
from polyview.session import cut_counted


def knn(targets: DataFrame, sources: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """k nearest sources by plain L2; a target without any source has source -1, distance 0."""
    found = nearest(targets, sources, k, "l2", exclude_self)
    out = targets.select(F.col("id").cast("long").alias("target")).join(found, "target", "left")
    return out.select(
        "target", F.coalesce("source", F.lit(-1)).alias("source"), F.coalesce("value", F.lit(0.0)).alias("distance"),
        F.coalesce("rank", F.lit(1)).alias("rank"),
    )


def mutual_matches(a: DataFrame, b: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Pairs that are each other's nearest and beat the second nearest by ``ratio`` both ways."""

    def distinct_best(x, y):
        two = nearest(x, y, 2).groupBy("target").agg(
            F.max(F.when(F.col("rank") == 1, F.struct("source", "value"))).alias("first"),
            F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("second"),
        )
        return two.filter(F.col("first.value") < ratio * F.col("second")).select("target", "first.*")

    ab = distinct_best(a, b)
    ba = distinct_best(b, a).select(F.col("source").alias("target"), F.col("target").alias("source"))
    return ab.join(ba, ["target", "source"], "left_semi").select(
        F.col("target").alias("a_id"), F.col("source").alias("b_id"), F.col("value").alias("distance")
    )


def similar_frames(frames: DataFrame, top_k: int, threshold: float, gap: int = 10) -> DataFrame:
    """Canonical pairs of similar, well separated frames.

    Each frame's ``top_k + 1`` best inner products are taken and the first one skipped.
    """
    hits = nearest(frames, frames, top_k + 1, "dot").filter(
        (F.col("rank") > 1) & (F.col("value") > threshold) & (F.abs(F.col("target") - F.col("source")) > gap)
    )
    return hits.groupBy(F.least("target", "source").alias("i"), F.greatest("target", "source").alias("j")).agg(
        F.max("value").alias("sim")
    )


def cloud_scores(pred: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """Accuracy, completeness, precision, recall and F-score of one cloud against another."""
    mean = lambda a, b, n, s: nearest(a, b, 1).agg(
        F.avg("value").alias(n), F.avg((F.col("value") < threshold).cast("double")).alias(s)
    )
    both = attach(mean(pred, truth, "accuracy", "precision"), [], mean(truth, pred, "completeness", "recall"))
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    inf = F.lit(float("inf"))
    return both.select(
        F.coalesce("accuracy", inf).alias("accuracy"), F.coalesce("completeness", inf).alias("completeness"),
        p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("fscore"),
    )


def farthest_first(rows: DataFrame, k: int, start: int) -> DataFrame:
    """``k`` rows: each next one is the farthest, not chosen before, from the last one.

    One small aggregation per step; only the last chosen vector travels.
    """
    spark = rows.sparkSession
    first = rows.filter(F.col("id") == start).select("id", "vec").first()
    if first is None:
        raise ValueError(f"start row {start} is missing")
    chosen, last = [(0, int(first["id"]), 0.0)], first["vec"]
    for step in range(1, k):
        here = F.array(*[F.lit(float(v)) for v in last])
        gap = F.sqrt(F.aggregate(
            F.zip_with(F.col("vec").cast("array<double>"), here, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
        ))
        free = rows.filter(~F.col("id").isin([c[1] for c in chosen]))
        pick = free.select("id", "vec", F.round(gap, 9).alias("gap")).agg(
            F.max_by(F.struct("id", "vec", "gap"), F.struct("gap", -F.col("id"))).alias("r")
        ).first()["r"]
        if pick is None:
            break
        chosen.append((step, int(pick["id"]), float(pick["gap"])))
        last = pick["vec"]
    return spark.createDataFrame(chosen, "step int, id long, gap double")


def balanced_representative(rows: DataFrame, group: str) -> DataFrame:
    """Row nearest the middle of its group's mean similarity, norm and variance.

    The mean similarity of a row to the rest is its product with the group's vector sum
    minus one, so no pair is formed: the sum is one row per group and dimension.
    """
    vec = F.col("vec").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    base = rows.select(group, "id", vec.alias("vec")).withColumns({
        "norm": F.sqrt(total(F.transform(vec, lambda v: v * v))), "n_dim": F.size(vec),
    })
    unit = base.withColumn("unit", F.transform("vec", lambda v: v / F.col("norm")))
    dims = unit.select(group, F.posexplode("unit").alias("d", "v")).groupBy(group, "d").agg(F.sum("v").alias("v"))
    sums = dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("sum"))
    sizes = base.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    joined = unit.join(sums, group).join(sizes, group)
    mean = total(F.col("unit")) / F.col("n_dim")
    scored = joined.select(
        group, "id",
        F.when(F.col("n") > 1, (total(F.zip_with("unit", "sum", lambda x, y: x * y)) - 1) / (F.col("n") - 1)).otherwise(0.0).alias("sim"),
        "norm", (total(F.transform("unit", lambda v: v * v)) - F.col("n_dim") * mean * mean).alias("__sq"), "n_dim",
    ).withColumn("variance", F.col("__sq") / (F.col("n_dim") - 1))
    names = ["sim", "norm", "variance"]
    ends = with_aggregates(scored, [group], **{f"lo_{c}": F.min(c) for c in names}, **{f"hi_{c}": F.max(c) for c in names})
    off = sum(
        (F.abs((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1e-8) - 0.5) for c in names), F.lit(0.0)
    )
    best = F.min_by(F.struct("id", F.round(off, 9).alias("balance")), F.struct(F.round(off, 9), "id")).alias("b")
    return ends.groupBy(group).agg(best).select(group, "b.*")


def mean_neighbour_distance(points: DataFrame, ident: str, k: int) -> DataFrame:
    """Mean distance of each 3-D point to its k nearest rows, itself included (all rows, if they are fewer).

    Equal points are folded into one location with a count.
    """
    axes = ["x", "y", "z"]
    located, count = cut_counted(points.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("loc")))
    if not count:
        return points.select(ident).withColumn("mean_distance", F.lit(None).cast("double"))
    rows = located.agg(F.sum("n")).first()[0]
    out = located.join(nearest_rows(located, min(k, rows)), "loc").select(*axes, "mean_distance")
    return points.join(out, axes)


def outlier_removal(points: DataFrame, ident: str, k: int = 20, sigmas: float = 2.0) -> DataFrame:
    """Rows whose mean neighbour distance is positive and below mean + sigmas * deviation.

    The statistics run over all rows; a row whose neighbours all coincide counts as 0.
    """
    marked = mean_neighbour_distance(points, ident, k)
    limits = with_aggregates(marked, [], __mu=F.avg("mean_distance"), __sd=F.coalesce(F.stddev_samp("mean_distance"), F.lit(0.0)))
    keep = (F.col("mean_distance") > 0) & (F.col("mean_distance") < F.col("__mu") + sigmas * F.col("__sd"))
    return limits.filter(keep).drop("__mu", "__sd")
