"""Detection and tracking evaluation on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyview.functions import boxes as B
from polyview.operators.linking import match_one_to_one
from polyview.plans.spatial import overlapping
from polyview.plans.stats import attach
from polyview.session import cut

# Localisation thresholds and the guards of the gated F1 family.
ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]
COUNT_EPS = 1e-4
IMAGE_EPS = 1e-6
TINY = 2.220446049250313e-16


def duplicate_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once where they must be unique."""
    return rows.groupBy(*keys).count().filter("count > 1").select(*keys)


def step_matches(sim: DataFrame, score: Column) -> DataFrame:
    """One-to-one matches per (seq, t) by score, then ids; zero scores never match."""
    scored = sim.withColumns({"score": F.round(score, 9), "order": F.struct("seq", "t", "gt_id", "trk_id")}).filter("score > 0")
    gt = F.struct("seq", "t", F.col("gt_id").cast("string").alias("id"))
    trk = F.struct("seq", "t", F.col("trk_id").cast("string").alias("id"))
    return match_one_to_one(scored, gt, trk, "score", "order", ["seq", "t"]).drop("order")


def alignment(sim: DataFrame, gt: DataFrame, trk: DataFrame) -> DataFrame:
    """Similarities with each track pair's alignment over the whole sequence."""
    per_gt = sim.groupBy("seq", "t", "gt_id").agg(F.sum("sim").alias("__g"))
    per_trk = sim.groupBy("seq", "t", "trk_id").agg(F.sum("sim").alias("__k"))
    with_sums = sim.join(per_gt, ["seq", "t", "gt_id"]).join(per_trk, ["seq", "t", "trk_id"])
    rest = F.col("__g") + F.col("__k") - F.col("sim")
    soft = F.when(rest > TINY, F.col("sim") / rest).otherwise(0.0)
    potential = with_sums.groupBy("seq", "gt_id", "trk_id").agg(F.sum(soft).alias("__p"))
    counts = lambda df, key, name: df.groupBy("seq", key).agg(F.count(F.lit(1)).alias(name))
    pairs = potential.join(counts(gt, "gt_id", "gt_count"), ["seq", "gt_id"]).join(
        counts(trk, "trk_id", "trk_count"), ["seq", "trk_id"]
    )
    pairs = pairs.withColumn("align", F.col("__p") / (F.col("gt_count") + F.col("trk_count") - F.col("__p")))
    return sim.join(pairs.drop("__p"), ["seq", "gt_id", "trk_id"])


def _by_alpha(matches: DataFrame) -> DataFrame:
    reached = F.filter(F.array(*[F.lit(a) for a in ALPHAS]), lambda a: F.col("sim") >= a - TINY)
    return matches.withColumn("alpha", F.explode(reached))


def _alphas(df: DataFrame) -> DataFrame:
    return df.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))


def _association(hit: DataFrame) -> DataFrame:
    per = hit.groupBy("seq", "alpha", "gt_id", "trk_id", "gt_count", "trk_count").agg(F.count(F.lit(1)).alias("m"))
    m, g, k = F.col("m"), F.col("gt_count"), F.col("trk_count")
    one = F.lit(1)
    return per.groupBy("seq", "alpha").agg(
        F.sum(m * m / F.greatest(one, g + k - m)).alias("ass"), F.sum(m * m / F.greatest(one, g)).alias("re"),
        F.sum(m * m / F.greatest(one, k)).alias("pr"),
    )


def hota(sim: DataFrame, gt: DataFrame, trk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracking accuracy per (sequence, alpha), and combined over sequences per alpha.

    Matching is greedy by alignment times similarity.
    """
    aligned = cut(alignment(sim, gt, trk))
    matches = cut(step_matches(aligned, F.col("align") * F.col("sim")))
    hit = _by_alpha(matches)
    tp = hit.groupBy("seq", "alpha").agg(F.count(F.lit(1)).alias("tp"), F.sum("sim").alias("loc"))
    totals = gt.groupBy("seq").agg(F.count(F.lit(1)).alias("gts")).join(
        trk.groupBy("seq").agg(F.count(F.lit(1)).alias("trks")), "seq", "full_outer"
    ).fillna(0)
    base = _alphas(totals).join(tp, ["seq", "alpha"], "left").join(_association(hit), ["seq", "alpha"], "left").fillna(0)
    sums = base.select(
        "seq", "alpha", "tp", (F.col("gts") - F.col("tp")).alias("fn"), (F.col("trks") - F.col("tp")).alias("fp"), "loc", "ass", "re", "pr"
    )
    combined = sums.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "loc", "ass", "re", "pr")])
    return _hota_final(sums), _hota_final(combined)


def _hota_final(sums: DataFrame) -> DataFrame:
    tp, one = F.col("tp"), F.lit(1)
    det = tp / F.greatest(one, tp + F.col("fn") + F.col("fp"))
    det_re = tp / F.greatest(one, tp + F.col("fn"))
    ass = F.col("ass") / F.greatest(one, tp)
    keys = [c for c in ("seq", "alpha") if c in sums.columns]
    return sums.select(
        *keys, "tp", "fn", "fp", (F.greatest(F.lit(1e-10), "loc") / F.greatest(F.lit(1e-10), tp)).alias("loc_a"),
        ass.alias("ass_a"), (F.col("re") / F.greatest(one, tp)).alias("ass_re"), (F.col("pr") / F.greatest(one, tp)).alias("ass_pr"),
        det.alias("det_a"), F.sqrt(det * ass).alias("hota"), F.sqrt(det_re * ass).alias("owta"),
    )


def class_mean(per_class: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Plain mean over classes of the given fields."""
    return per_class.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in fields])


def teta(sim: DataFrame, gt: DataFrame, trk: DataFrame, candidate: float = 0.5) -> DataFrame:
    """Localisation, association and class accuracy per alpha over all sequences.

    ``sim`` carries ``gt_class`` and ``trk_class``.  A track counts as a false
    localisation only when it overlaps some truth at ``candidate`` and is not matched.
    """
    aligned = cut(alignment(sim, gt, trk))
    matches = cut(step_matches(aligned, F.col("align") * F.col("sim")))
    hit = _by_alpha(matches)
    same = F.count_if(F.col("gt_class") == F.col("trk_class"))
    tp = hit.groupBy("alpha").agg(F.count(F.lit(1)).alias("tp"), same.alias("cls_tp"))
    near = sim.filter(F.col("sim") >= candidate).select("seq", "t", "trk_id").distinct()
    pool = near.agg(F.count(F.lit(1)).alias("pool"))
    claimed = hit.join(near, ["seq", "t", "trk_id"], "left_semi").groupBy("alpha").agg(F.count(F.lit(1)).alias("claimed"))
    ass = _association(hit).groupBy("alpha").agg(F.sum("ass").alias("ass"), F.sum("re").alias("re"), F.sum("pr").alias("pr"))
    base = attach(attach(_alphas(gt.agg(F.count(F.lit(1)).alias("gts"))), [], pool), [], trk.agg(F.count(F.lit(1)).alias("trks")))
    out = base.join(tp, "alpha", "left").join(claimed, "alpha", "left").join(ass, "alpha", "left").fillna(0)
    one = F.lit(1)
    t, fn, fp = F.col("tp"), F.col("gts") - F.col("tp"), F.col("pool") - F.col("claimed")
    loc = t / F.greatest(one, t + fn + fp)
    assoc = F.col("ass") / F.greatest(one, t)
    cls = F.when(F.col("alpha") >= 0.5, F.col("cls_tp") / F.greatest(one, t))
    return out.select(
        "alpha", "tp", fn.alias("fn"), fp.alias("fp"), "cls_tp", loc.alias("loc_a"), assoc.alias("assoc_a"), cls.alias("cls_a"),
        ((loc + assoc + F.coalesce(cls, F.lit(0.0))) / 3).alias("teta"),
    )


def wrong_class_hits(matches_by_alpha: DataFrame) -> DataFrame:
    """False positives a predicted class collects from matches of another class."""
    return matches_by_alpha.filter(F.col("gt_class") != F.col("trk_class")).groupBy("alpha", "trk_class").agg(
        F.count(F.lit(1)).alias("cls_fp")
    )


def eval_prefilter(sim: DataFrame, gt: DataFrame, trk: DataFrame, rules: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions to score: unmatched ones are dropped where the class cannot judge them.

    ``rules(seq, klass, negative, exhaustive)``: without truth in the step, unmatched
    predictions stay only if the class is a listed negative; of a class that is not
    exhaustively labelled they are always dropped.
    """
    strong = sim.filter(F.col("sim") >= least - TINY)
    matched = step_matches(strong, F.col("sim")).select("seq", "t", "klass", "trk_id")
    has_gt = gt.select("seq", "t", "klass").distinct().withColumn("__gt", F.lit(True))
    marked = (
        trk.join(matched.withColumn("__m", F.lit(True)), ["seq", "t", "klass", "trk_id"], "left")
        .join(has_gt, ["seq", "t", "klass"], "left").join(rules, ["seq", "klass"], "left")
    )
    off = F.when(F.col("__gt").isNull() & ~F.coalesce("negative", F.lit(False)), True).otherwise(
        ~F.coalesce("exhaustive", F.lit(True))
    )
    return marked.filter(F.col("__m").isNotNull() | ~off).select(*trk.columns)


def gated_f1(images: DataFrame, gt: DataFrame, dt: DataFrame, thresholds: Sequence[float], fits=None) -> DataFrame:
    """Gated F1 family per IoU threshold over all images ``(image_id)``.

    ``gt`` and ``dt`` hold boxes ``(image_id, object_id, x1, y1, x2, y2)``.
    """
    pairs = overlapping(
        gt.select("image_id", "object_id", *B.SIDES), dt.select("image_id", "object_id", *B.SIDES), ["image_id"], fits
    ).select(
        "image_id", F.col("a.object_id").alias("g"), F.col("b.object_id").alias("d"),
        F.round(B.iou(B.sides("a."), B.sides("b.")), 9).alias("iou"),
    ).filter("iou > 0").withColumn("seq", F.struct("image_id", "g", "d"))
    matched = match_one_to_one(pairs, F.struct("image_id", "g"), F.struct("image_id", "d"), "iou", "seq", ["image_id"])
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    tp = matched.withColumn("thr", F.explode(F.filter(levels, lambda t: F.col("iou") >= t))).groupBy("image_id", "thr").agg(
        F.count(F.lit(1)).alias("tp")
    )
    count = lambda df, n: df.groupBy("image_id").agg(F.count(F.lit(1)).alias(n))
    sized = images.select("image_id").join(count(gt, "ng"), "image_id", "left").join(count(dt, "nd"), "image_id", "left").fillna(0)
    per = sized.withColumn("thr", F.explode(levels)).join(tp, ["image_id", "thr"], "left").fillna(0)
    t, fp, fn = F.col("tp"), F.col("nd") - F.col("tp"), F.col("ng") - F.col("tp")
    f1 = lambda p, r: 2 * p * r / (p + r + COUNT_EPS)
    local = f1(t / (F.col("nd") + COUNT_EPS), t / (F.col("ng") + COUNT_EPS))
    pos = F.col("ng") > 0
    sums = per.groupBy("thr").agg(
        F.sum(t).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"), F.sum(F.when(pos, fp).otherwise(0)).alias("pos_fp"),
        F.sum(F.when(pos, local).otherwise(0.0)).alias("local"), F.count_if(pos & (F.col("nd") > 0)).alias("il_tp"),
        F.count_if(~pos & (F.col("nd") > 0)).alias("il_fp"), F.count_if(pos & (F.col("nd") == 0)).alias("il_fn"),
        F.count_if(~pos & (F.col("nd") == 0)).alias("il_tn"),
    )
    c = F.col
    prec, rec = c("tp") / (c("tp") + c("fp") + COUNT_EPS), c("tp") / (c("tp") + c("fn") + COUNT_EPS)
    pos_prec = c("tp") / (c("tp") + c("pos_fp") + COUNT_EPS)
    d = lambda n: c(n).cast("double")
    mcc = (d("il_tp") * d("il_tn") - d("il_fp") * d("il_fn")) / (
        F.sqrt((d("il_tp") + d("il_fp")) * (d("il_tp") + d("il_fn")) * (d("il_tn") + d("il_fp")) * (d("il_tn") + d("il_fn"))) + IMAGE_EPS
    )
    il_rec, il_prec = c("il_tp") / (c("il_tp") + c("il_fn") + IMAGE_EPS), c("il_tp") / (c("il_tp") + c("il_fp") + IMAGE_EPS)
    out = sums.select(
        "thr", "tp", "fp", "fn", "il_tp", "il_fp", "il_fn", "il_tn", prec.alias("precision"), rec.alias("recall"), f1(prec, rec).alias("f1"),
        f1(pos_prec, rec).alias("positive_micro_f1"), F.coalesce(F.try_divide("local", "il_tp"), F.lit(0.0)).alias("positive_macro_f1"),
        (2 * il_prec * il_rec / (il_prec + il_rec + IMAGE_EPS)).alias("il_f1"),
        (c("il_fp") / (c("il_fp") + c("il_tn") + IMAGE_EPS)).alias("il_fpr"), mcc.alias("il_mcc"),
    )
    return out.withColumn("cg_f1", F.col("positive_micro_f1") * F.col("il_mcc"))


def filter_targets(targets: DataFrame, least_area: float = 1e-6) -> DataFrame:
    """Drop crowd targets and targets without area."""
    return targets.filter(~F.col("crowd") & (B.clipped_area(B.sides()) >= least_area))


def filter_queries(
    queries: DataFrame, targets: DataFrame, excluded: Sequence[str], most_outputs: int, per_image: int, seed: int = 42
) -> DataFrame:
    """Usable queries: allowed text, exhaustive, no flat object, not too many outputs.

    At most ``per_image`` stay per image, those with outputs first, then in hash order.
    """
    flat = targets.filter(B.clipped_area(B.sides()) <= 0).select("query_id").distinct()
    outputs = filter_targets(targets).groupBy("query_id").agg(F.count(F.lit(1)).alias("outputs"))
    good = (
        queries.filter(~F.col("text").isin(list(excluded)) & F.col("exhaustive"))
        .join(flat, "query_id", "left_anti").join(outputs, "query_id", "left").fillna(0, ["outputs"])
        .filter(F.col("outputs") <= most_outputs)
    )
    shuffled = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string")), 256)
    order = [(F.col("outputs") > 0).desc(), shuffled, F.col("query_id")]
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(*order))
    return good.withColumn("pos", rank).filter(F.col("pos") <= per_image)
