"""Operators over detection boxes: features, pairs, contracts, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyview.functions import boxes as B
from polyview.plans.spatial import overlapping

def large_boxes(det: DataFrame, min_score: float, min_area: float) -> DataFrame:
    """Complete boxes that are large and confident, with their area."""
    rows = det.dropna(subset=list(B.SIDES)).withColumn("area", B.clipped_area(B.sides()))
    return rows.filter((F.col("score") >= min_score) & (F.col("area") >= min_area))


def boxes_over_limit(det: DataFrame, min_score: float, min_area: float, max_boxes: int) -> DataFrame:
    """How many of an image's boxes ``box_features`` keeps and how many its limit drops."""
    counts = large_boxes(det, min_score, min_area).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("image_id", F.least("n", F.lit(max_boxes).cast("long")).alias("kept"), F.greatest(F.col("n") - max_boxes, F.lit(0).cast("long")).alias("dropped"))


def box_features(det: DataFrame, min_score: float, min_area: float, max_boxes: int) -> DataFrame:
    """Large and confident boxes with centre and area, at most ``max_boxes`` per image (see ``boxes_over_limit``).

    The rank filter runs map-side first, so a crowded image ships only its top rows.
    """
    box = B.sides()
    cx, cy = B.center(box)
    rank = F.row_number().over(
        Window.partitionBy("image_id").orderBy(F.col("area").desc(), "object_id")
    )
    return (
        large_boxes(det, min_score, min_area)
        .withColumns({"cx": cx, "cy": cy})
        .withColumn("area_rank", rank)
        .filter(F.col("area_rank") <= max_boxes)
    )


def iou_pairs(det: DataFrame, threshold: float, fits: bool | None = None) -> DataFrame:
    """Pairs of one image's boxes with IoU above the threshold, lower id first."""
    side = det.select("image_id", "object_id", *B.SIDES)
    pairs = overlapping(side, side, ["image_id"], fits)
    return (
        pairs.filter(F.col("a.object_id") < F.col("b.object_id"))
        .select(
            "image_id",
            F.col("a.object_id").alias("a_id"),
            F.col("b.object_id").alias("b_id"),
            B.iou(B.sides("a."), B.sides("b.")).alias("iou"),
        )
        .filter(F.col("iou") > threshold)
    )


def overlap_stats(det: DataFrame, threshold: float, fits: bool | None = None) -> DataFrame:
    """Per image: boxes, boxes in an overlap, overlapping pairs, max and mean IoU.

    Equal boxes are folded into one row with a count first, so many copies of a box
    cost one row and their pairs are counted, not listed.
    """
    folded = det.groupBy("image_id", *B.SIDES).agg(F.count(F.lit(1)).alias("n"))
    pairs = overlapping(folded, folded, ["image_id"], fits)
    sides_a, sides_b = B.sides("a."), B.sides("b.")
    before = F.struct(*sides_a) < F.struct(*sides_b)
    across = pairs.filter(before).select(
        "image_id",
        F.col("a").alias("p"),
        F.col("b").alias("q"),
        B.iou(sides_a, sides_b).alias("iou"),
        (F.col("a.n") * F.col("b.n")).alias("pairs"),
    )
    own = F.struct("x1", "y1", "x2", "y2", "n")
    inside = folded.filter("n > 1").select(
        "image_id",
        own.alias("p"),
        own.alias("q"),
        B.iou(B.sides(), B.sides()).alias("iou"),
        (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"),
    )
    names = ["image_id", "p", "q", "iou", "pairs"]
    shape = lambda df: df.select(
        "image_id",
        *[F.struct(*[F.col(f"{s}.{c}") for c in (*B.SIDES, "n")]).alias(s) for s in ("p", "q")],
        "iou",
        "pairs",
    )
    hits = shape(across).union(shape(inside.select(*names))).filter(F.col("iou") > threshold)
    touched = (
        hits.select("image_id", F.explode(F.array("p", "q")).alias("box"))
        .distinct()
        .groupBy("image_id")
        .agg(F.sum("box.n").alias("in_overlap"))
    )
    per_pair = hits.groupBy("image_id").agg(
        F.sum("pairs").alias("pairs"),
        F.max("iou").alias("max_iou"),
        (F.sum(F.col("iou") * F.col("pairs")) / F.sum("pairs")).alias("mean_iou"),
    )
    zero = {"in_overlap": 0, "pairs": 0, "max_iou": 0.0, "mean_iou": 0.0}
    return (
        folded.groupBy("image_id")
        .agg(F.sum("n").alias("boxes"))
        .join(touched, "image_id", "left")
        .join(per_pair, "image_id", "left")
        .fillna(zero)
    )


def prune_containers(det: DataFrame, key: str = "image_id", fits: bool | None = None) -> DataFrame:
    """Drop every box that strictly contains another candidate of its group.

    Strict containment is transitive, so this keeps what a pairwise scan keeps.
    Equal boxes do not contain each other, so copies are folded before pairing.
    """
    folded = det.select(key, *B.SIDES).distinct()
    outer = (
        overlapping(folded, folded, [key], fits)
        .filter(B.strictly_contains(B.sides("a."), B.sides("b.")))
        .select(key, *[F.col(f"a.{c}").alias(c) for c in B.SIDES])
        .distinct()
    )
    return det.join(outer, [key, *B.SIDES], "left_anti")


def enrich_ids(det: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach global ids; a detection without one gets null and ``is_deduplicated`` false."""
    known = mapping.select("image_id", "object_id", "global_id", "removed")
    return (
        det.join(known, ["image_id", "object_id"], "left")
        .withColumn("is_deduplicated", F.coalesce("removed", F.lit(False)))
        .drop("removed")
    )


def coverage_report(det: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows that break exactly-once coverage: missing, extra, duplicate, mismatched box."""
    keys = ["image_id", "object_id"]
    want = det.select(*keys, F.struct(*B.SIDES).alias("want"))
    have = mapping.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(*B.SIDES)).alias("low"),
        F.max(F.struct(*B.SIDES)).alias("high"),
    )
    reason = (
        F.when(F.col("copies").isNull(), "missing")
        .when(F.col("want").isNull(), "extra")
        .when(F.col("copies") > 1, "duplicate")
        .when((F.col("low") != F.col("want")) | (F.col("high") != F.col("want")), "mismatched")
    )
    both = want.join(have, keys, "full_outer")
    return both.select(*keys, reason.alias("reason")).filter("reason IS NOT NULL")


def tracklet_iou(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Σ intersection / Σ union of every (prediction, truth) track pair of a video.

    Only frames both tracks share need a join; the union is the two tracks' total
    areas minus the shared intersections, so frames of one side alone are counted
    without forming pairs for them.
    """
    total = lambda df, name: df.groupBy("video", "track").agg(
        F.sum(B.clipped_area(B.sides())).alias(name)
    )
    pairs = overlapping(
        pred.select("video", "frame", "track", *B.SIDES),
        truth.select("video", "frame", "track", *B.SIDES),
        ["video", "frame"],
    )
    shared = pairs.groupBy(
        "video", F.col("a.track").alias("pred"), F.col("b.track").alias("truth")
    ).agg(F.sum(B.intersection(B.sides("a."), B.sides("b."))).alias("inter"))
    joined = shared.join(
        total(pred, "area_p").withColumnRenamed("track", "pred"), ["video", "pred"]
    ).join(total(truth, "area_t").withColumnRenamed("track", "truth"), ["video", "truth"])
    union = F.col("area_p") + F.col("area_t") - F.col("inter")
    return joined.select(
        "video", "pred", "truth", "inter",
        F.coalesce(F.try_divide("inter", union), F.lit(0.0)).alias("iou"),
    ).filter("inter > 0")


def subtract(box: Column, other: Column) -> Column:
    """A box minus another: up to four strips (top, bottom, left, right)."""
    ix1, iy1 = F.greatest(box["x1"], other["x1"]), F.greatest(box["y1"], other["y1"])
    ix2, iy2 = F.least(box["x2"], other["x2"]), F.least(box["y2"], other["y2"])
    strip = lambda a, b, c, d: F.struct(
        a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")
    )
    strips = F.array(
        strip(box["x1"], box["y1"], box["x2"], iy1),
        strip(box["x1"], iy2, box["x2"], box["y2"]),
        strip(box["x1"], iy1, ix1, iy2),
        strip(ix2, iy1, box["x2"], iy2),
    )
    kept = F.filter(strips, lambda r: (r["x2"] > r["x1"]) & (r["y2"] > r["y1"]))
    apart = (ix1 >= ix2) | (iy1 >= iy2)
    return F.when(apart, F.array(strip(*[box[c] for c in B.SIDES]))).otherwise(kept)


def free_regions(
    det: DataFrame, threshold: float, min_area: float = 100.0, fits: bool | None = None
) -> DataFrame:
    """What is left of each box after cutting away its overlapping neighbours.

    Neighbours are cut in id order; strips below ``min_area`` are dropped, and a box
    with nothing left falls back to a small centred square.  The only box of an image
    stays as it is.  Equal boxes are folded: they share their neighbours and result.
    """
    side = det.select("image_id", "object_id", *B.SIDES)
    folded = side.groupBy("image_id", *B.SIDES).agg(
        F.min("object_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    same = F.struct(*B.sides("a.")) == F.struct(*B.sides("b."))
    hits = overlapping(folded, folded, ["image_id"], fits).filter(
        (~same | (F.col("b.n") > 1)) & (B.iou(B.sides("a."), B.sides("b.")) > threshold)
    )
    others = hits.groupBy("image_id", *[F.col(f"a.{c}").alias(c) for c in B.SIDES]).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("b.first_id").alias("id"), *B.sides("b.")))
        ).alias("others")
    )
    crowd = folded.groupBy("image_id").agg(F.sum("n").alias("boxes"))
    box = F.struct(*B.SIDES)
    cut = F.aggregate(
        F.coalesce("others", F.array().cast(others.schema["others"].dataType)),
        F.array(box),
        lambda acc, o: F.flatten(F.transform(acc, lambda r: subtract(r, o))),
    )
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    half = F.least(w * 0.3, h * 0.3, F.lit(50.0)) / 2
    cx, cy = B.center(B.sides())
    square = F.struct(
        (cx - half).alias("x1"), (cy - half).alias("y1"),
        (cx + half).alias("x2"), (cy + half).alias("y2"),
    )
    big = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) >= min_area
    kept = F.when(F.col("boxes") == 1, F.array(box)).otherwise(F.filter(cut, big))
    regions = (
        folded.join(others, ["image_id", *B.SIDES], "left")
        .join(crowd, "image_id")
        .withColumn("regions", kept)
        .withColumn("regions", F.when(F.size("regions") > 0, F.col("regions")).otherwise(F.array(square)))
        .select("image_id", *B.SIDES, "regions")
    )
    return side.join(regions, ["image_id", *B.SIDES])
