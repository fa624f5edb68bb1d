"""Match accuracy, roll-ups and comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.functions import geometry as G
from polyview.plans.scan import along, number, running_max, running_sum
from polyview.plans.stats import ratio, with_aggregates


def _flags(truth: DataFrame, pred: DataFrame, pair: Sequence[str]) -> DataFrame:
    cols = [*pair, "ref_id", "tgt_id", "seq"]
    return truth.select(*cols, F.lit(True).alias("is_gt")).union(
        pred.select(*cols, F.lit(False).alias("is_gt"))
    )


def _per_match(truth: DataFrame, pred: DataFrame, pair: Sequence[str]) -> DataFrame:
    """One row per distinct (pair, ref, target) with its sides and its ref's last mappings."""
    rows = _flags(truth, pred, pair)
    gt = F.col("is_gt")
    cells = rows.groupBy(*pair, "ref_id", "tgt_id").agg(
        F.max(gt).alias("g"), F.max(~gt).alias("p"),
        F.sum(gt.cast("long")).alias("n_gt"), F.sum((~gt).cast("long")).alias("n_pred"),
        F.max(F.when(gt, F.col("seq"))).alias("gt_seq"), F.max(F.when(~gt, F.col("seq"))).alias("pred_seq"),
    )
    last = cells.groupBy(*pair, "ref_id").agg(
        F.max_by("tgt_id", "gt_seq").alias("gt_last"), F.max_by("tgt_id", "pred_seq").alias("pred_last")
    )
    return cells.join(last, [*pair, "ref_id"])


def match_outcomes(truth: DataFrame, pred: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Class of every distinct match: correct, missed, extra, or part of a wrong mapping."""
    other = lambda last: F.coalesce(F.col(last) != F.col("tgt_id"), F.lit(False))
    g, p = F.col("g"), F.col("p")
    outcome = (
        F.when(g & p, "correct")
        .when(g & other("pred_last"), "wrong")
        .when(g, "missed")
        .when(other("gt_last"), "wrong")
        .otherwise("extra")
    )
    return _per_match(truth, pred, pair).select(*pair, "ref_id", "tgt_id", outcome.alias("outcome"))


def pair_metrics(truth: DataFrame, pred: DataFrame, evaluated: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Recall, effectiveness and mapping precision per evaluated pair.

    A pair counts when it has ground truth and is listed in ``evaluated``; a listed
    pair without predictions scores zero.
    """
    g, p = F.col("g"), F.col("p")
    other = lambda last: F.coalesce(F.col(last) != F.col("tgt_id"), F.lit(False))
    count = lambda cond: F.sum(cond.cast("long"))
    cells = _per_match(truth, pred, pair)
    sets = cells.groupBy(*pair, "ref_id").agg(
        F.sum("n_gt").alias("gt_rows"), F.sum("n_pred").alias("pred_rows"),
        count(g).alias("gt_set"), count(p).alias("pred_set"), count(g & p).alias("tp"),
        count(g & ~p & ~other("pred_last")).alias("missed"),
        count(p & ~g & ~other("gt_last")).alias("extra"),
        F.first("gt_last").alias("gt_last"), F.first("pred_last").alias("pred_last"),
    )
    common = F.col("gt_last").isNotNull() & F.col("pred_last").isNotNull()
    correct = F.coalesce(F.col("gt_last") == F.col("pred_last"), F.lit(False))
    names = ["gt_rows", "pred_rows", "gt_set", "pred_set", "tp", "missed", "extra"]
    out = (
        sets.groupBy(*pair)
        .agg(*[F.sum(n).alias(n) for n in names], count(common).alias("map_total"), count(correct).alias("map_correct"))
        .filter("gt_rows > 0")
        .join(evaluated.select(*pair).distinct(), list(pair), "left_semi")
    )
    return out.withColumns({
        "wrong": F.col("map_total") - F.col("map_correct"),
        "recall": ratio(F.col("tp"), F.col("gt_set")),
        "effectiveness": ratio(F.col("tp"), F.col("pred_set")),
        "precision": ratio(F.col("map_correct"), F.col("map_total")),
    })


def overall_metrics(per_pair: DataFrame) -> DataFrame:
    """Totals over pairs; the denominators are list sizes, not set sizes."""
    names = ["gt_rows", "pred_rows", "tp", "missed", "extra", "wrong", "map_total", "map_correct"]
    total = per_pair.agg(F.count(F.lit(1)).alias("pairs"), *[F.sum(n).alias(n) for n in names])
    return total.withColumns({
        "recall": ratio(F.col("tp"), F.col("gt_rows")),
        "effectiveness": ratio(F.col("tp"), F.col("pred_rows")),
        "precision": ratio(F.col("map_correct"), F.col("map_total")),
    })


def weighted_rollup(rows: DataFrame, run: str, weight: str, metrics: Sequence[str]) -> DataFrame:
    """Weighted and simple means per run over its datasets, ranked by each weighted mean."""
    w = F.col(weight)
    per_run = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("datasets"), F.sum(w).alias("total"),
        *[ratio(F.sum(F.col(m) * w), F.sum(w)).alias(f"w_{m}") for m in metrics],
        *[F.avg(m).alias(f"s_{m}") for m in metrics],
    )
    for m in metrics:
        per_run = along(per_run, [], [F.col(f"w_{m}").desc(), F.col(run)], {f"rank_{m}": number()})
    return per_run


def match_summary(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per target: matches, mean hit ratio, mean matched share."""
    share = F.col("matched") / F.greatest(F.lit(1), F.col("total"))
    return edges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("match_count"), F.avg("hit_ratio").alias("avg_ratio"), F.avg(share).alias("avg_share")
    )


def mean_rows(rows: DataFrame, scene: str, metrics: Sequence[str], label: str = "mean") -> DataFrame:
    """Scene rows plus one row with the plain mean of each metric."""
    out = rows.withColumn(scene, F.col(scene).cast("string")).rollup(scene)
    return out.agg(*[F.avg(m).alias(m) for m in metrics], F.grouping(scene).alias("__all")).withColumn(
        scene, F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(scene))
    ).drop("__all")


def psnr(rows: DataFrame, view: str, a: Column, b: Column, valid: Column, peak: float = 255.0) -> DataFrame:
    """Masked MSE and PSNR per view and pooled over all pixels (view null)."""
    squared = F.when(valid, (a - b) * (a - b))
    sums = rows.groupBy(view).agg(F.sum(squared).alias("sq"), F.count(squared).alias("pixels"))
    pooled = sums.rollup(view).agg(F.sum("sq").alias("sq"), F.sum("pixels").alias("pixels"))
    mse = F.try_divide("sq", "pixels")
    return pooled.select(
        view, "pixels", mse.alias("mse"),
        F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse)).alias("psnr"),
    )


def agreement(rows: DataFrame, truth: str, assigned: str, baseline: str) -> DataFrame:
    """Coverage and agreement of assigned labels, and what was lost against a baseline."""
    has, had = F.col(assigned).isNotNull(), F.col(baseline).isNotNull()
    hit = F.coalesce(F.col(assigned) == F.col(truth), F.lit(False))
    count = lambda cond: F.sum(cond.cast("long"))
    return rows.agg(
        F.count(F.lit(1)).alias("samples"), count(has).alias("assigned"), count(hit).alias("matched"),
        count(had & ~has).alias("lost"),
        ratio(count(has), F.count(F.lit(1))).alias("coverage"),
        ratio(count(hit), F.count(F.lit(1))).alias("match_all"),
        ratio(count(hit), count(has)).alias("match_assigned"),
    )


def transitions(rows: DataFrame, before: str, after: str, weight: Column) -> DataFrame:
    """Before/after classes with counts and weighted share."""
    b, a = F.col(before), F.col(after)
    change = (
        F.when(b.isNull() & a.isNull(), "none").when(b.isNull(), "new").when(a.isNull(), "lost")
        .when(a == b, "same").otherwise("changed")
    )
    per = rows.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    total = with_aggregates(per, [], total=F.sum("w"))
    return total.select("change", "n", F.coalesce(F.try_divide("w", "total"), F.lit(0.0)).alias("share"))


def compare_runs(rows: DataFrame, run: str, reference: str, metric: str, value: str) -> DataFrame:
    """Difference of each run's metrics to its own reference run, in points; missing stays null."""
    base = rows.select(
        F.col(run).alias("__ref"), F.col(metric).alias("__metric"), F.col(value).alias("reference_value")
    )
    joined = rows.join(base, (F.col(reference) == F.col("__ref")) & (F.col(metric) == F.col("__metric")), "left")
    return joined.select(
        run, metric, value, "reference_value", ((F.col(value) - F.col("reference_value")) * 100).alias("delta")
    )


def macro_micro(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean per group, mean of those means, mean over all rows."""
    per = rows.groupBy(group).agg(F.avg(value).alias("mean"), F.sum(value).alias("s"), F.count(value).alias("n"))
    one = per.select(F.col(group).cast("string").alias("name"), "mean")
    all_ = per.agg(F.avg("mean").alias("macro"), F.try_divide(F.sum("s"), F.sum("n")).alias("micro"))
    tail = all_.selectExpr("stack(2, 'macro', macro, 'micro', micro) AS (name, mean)")
    return one.union(tail.select("name", F.coalesce("mean", F.lit(0.0)).alias("mean")))


def complete_cases(receipts: DataFrame, stages: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Stage means over cases whose every required stage succeeded, and the excluded cases.

    ``receipts(case, stage, seq, ok, wall)``; the last receipt of a stage counts.
    """
    last = receipts.groupBy("case", "stage").agg(
        F.max_by(F.struct("ok", "wall"), "seq").alias("r"), F.count(F.lit(1)).alias("calls"),
        F.sum("wall").alias("total"),
    )
    needed = F.col("stage").isin(list(stages)) & F.col("r.ok")
    done = last.groupBy("case").agg((F.count_if(needed) == len(stages)).alias("complete"))
    good = last.join(done.filter("complete"), "case", "left_semi").filter(F.col("stage").isin(list(stages)))
    means = good.groupBy("stage").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("r.wall").alias("mean_wall"), F.max("r.wall").alias("peak_wall"),
        F.sum("calls").alias("calls"), F.sum("total").alias("total_wall"),
    )
    return means, done.filter(~F.col("complete")).select("case")


def error_auc(errors: DataFrame, error: Column, threshold: int) -> DataFrame:
    """Area under the cumulative error histogram with integer bins up to the threshold."""
    e = error
    slot = F.when(e == threshold, F.lit(threshold - 1)).otherwise(F.floor(e)).cast("int")
    # Summing the cumulative counts of all bins counts an error of bin b (T - b) times.
    inside = F.when((e >= 0) & (e <= threshold), threshold - slot)
    return errors.agg(
        F.count(F.lit(1)).alias("n"),
        (F.coalesce(F.sum(inside), F.lit(0)) / F.count(F.lit(1)) / threshold).alias("auc"),
    )


def average_precision(scored: DataFrame, recall_points: int = 101) -> DataFrame:
    """Interpolated average precision of scored hits ``(klass, score, id, hit, npos)``.

    Precision is made monotone from the tail and read at evenly spaced recalls.  Only
    the rows where recall grows matter, so the reverse running maximum and the lookup
    run on hits alone.
    """
    counted = along(
        scored.select("klass", "score", "id", "npos", F.col("hit").cast("long").alias("hit")),
        ["klass"], [F.col("score").desc(), F.col("id")],
        {"seen": number(), "tp": running_sum(F.col("hit"))},
    )
    npos = F.col("npos")
    hits = counted.filter("hit = 1").withColumn("precision", F.col("tp") / F.col("seen"))
    # The envelope at rank tp is the best precision among later hits.
    flipped = along(hits, ["klass"], [F.col("tp").desc()], {"envelope": running_max(F.col("precision"))})
    step = F.lit(recall_points - 1)
    # Grid points g (0..100) with (tp-1)/npos < g/100 <= tp/npos belong to this hit.
    low = F.when(F.col("tp") == 1, F.lit(-1)).otherwise(F.floor((F.col("tp") - 1) * step / npos))
    points = F.floor(F.col("tp") * step / npos) - low
    return flipped.groupBy("klass").agg(
        (F.sum(points * F.col("envelope")) / recall_points).alias("ap"), F.count(F.lit(1)).alias("hits")
    )



def relative_pose_errors(poses: DataFrame, pairs: DataFrame, sequence: str, frame: str) -> DataFrame:
    """Rotation and translation errors in degrees of relative poses, for planned frame pairs ``(sequence, i, j)``.

    ``poses(sequence, frame, q, t, pred_q, pred_t)`` hold true and predicted quaternions and positions as arrays.  Translations
    compare by direction, opposite ones as equal.
    """
    # matrices are columns of their own, built once per pose, and relative ones once per pair
    matrix = lambda q: F.array(*[F.array(*row) for row in G.quaternion_matrix([F.col(q)[c] for c in range(4)])])
    turned = poses.select(sequence, frame, matrix("q").alias("r"), "t", matrix("pred_q").alias("pred_r"), "pred_t")
    end = lambda name: turned.select(sequence, F.col(frame).alias(name), F.struct("r", "t", "pred_r", "pred_t").alias(f"__{name}"))
    both = pairs.join(end("i"), [sequence, "i"]).join(end("j"), [sequence, "j"])
    cells = lambda r: [[F.col(r)[i][k] for k in range(3)] for i in range(3)]
    items = lambda t: [F.col(t)[i] for i in range(3)]
    seen = {}
    for name, r, t in (("", "r", "t"), ("pred_", "pred_r", "pred_t")):
        turn, way = G.relative_pose(cells(f"__i.{r}"), items(f"__i.{t}"), cells(f"__j.{r}"), items(f"__j.{t}"))
        seen |= {f"__{name}turn": F.array(*[F.array(*row) for row in turn]), f"__{name}way": F.array(*way)}
    return both.withColumns(seen).select(
        sequence, "i", "j", G.rotation_angle(cells("__turn"), cells("__pred_turn")).alias("rotation_error"),
        G.direction_angle(items("__way"), items("__pred_way")).alias("translation_error"),
    )


def pose_auc(errors: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """Per group: pairs and the area under the cumulative histogram of the larger error, in whole degrees up to the threshold.

    A pair without a direction (equal positions) counts as an error beyond it.
    """
    worse = F.when(F.col("rotation_error").isNotNull() & F.col("translation_error").isNotNull(), F.greatest("rotation_error", "translation_error"))
    slot = F.when(worse == threshold, F.lit(threshold - 1)).otherwise(F.floor(worse))
    inside = F.when(worse <= threshold, threshold - slot)
    return errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), (F.coalesce(F.sum(inside), F.lit(0)) / F.count(F.lit(1)) / threshold).alias("auc")
    )
