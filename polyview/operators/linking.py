"""Match edges to conflict-free global ids, and the graph operators around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.functions import boxes as B
from polyview.plans import folds, rounds
from polyview.plans.scan import along, number, numbered
from polyview.plans.octree import box_columns, box_gaps, occupied_pairs
from polyview.plans.spatial import SLACK, overlapping
from polyview.plans.stats import with_aggregates
from polyview.session import cut, cut_counted

CROWD = 4  # points that the first balls' cells hold, as their points see it
MOST_HALVINGS = 16


def allowed_pairs(edges: DataFrame, keys: Sequence[str], min_ratio: float = 0.0) -> DataFrame:
    """Forward frame pairs plus the one pair from the last frame back to the first."""
    ends = with_aggregates(
        edges, keys,
        __hi=F.max(F.greatest("ref_idx", "tgt_idx")), __lo=F.min(F.least("ref_idx", "tgt_idx")),
    )
    wrap = (F.col("ref_idx") == F.col("__hi")) & (F.col("tgt_idx") == F.col("__lo"))
    kept = ends.filter((F.col("ref_idx") < F.col("tgt_idx")) | wrap)
    if min_ratio > 0:
        kept = kept.filter(F.col("hit_ratio") >= min_ratio)
    return kept.select(*edges.columns)


def _ranked(ratio: str, seq: str, a: Column, b: Column) -> Column:
    """Priority of an edge: ratio descending, input order, then its ends, which makes it unique."""
    return F.struct((-F.col(ratio)).alias("r"), F.col(seq).alias("s"), a.alias("a"), b.alias("b"))


def match_one_to_one(
    edges: DataFrame, ref: Column, target: Column, ratio: str, seq: str, groups: Sequence[str] | None = None
) -> DataFrame:
    """Greedy one-to-one matching by ratio descending, then input order.

    ``groups`` names columns that both ends of every edge share: groups are scanned one by one.  Without
    them, all edges take rounds together.
    """
    kind = edges.select(ref.alias("id")).schema["id"].dataType
    side = lambda n, c: F.struct(F.lit(n).alias("side"), c.cast(kind).alias("id"))
    keyed = edges.select(
        _ranked(ratio, seq, ref, target).alias("p"), side(0, ref).alias("a"), side(1, target).alias("b"),
        F.struct(*edges.columns).alias("e"),
    )
    found = folds.matched(keyed, [F.col(f"e.{g}").alias(g) for g in groups]) if groups else rounds.greedy_match(keyed)
    return found.select("e.*")


def global_ids(nodes: DataFrame, edges: DataFrame, ratio: str, seq: str, sequence: str) -> DataFrame:
    """Global ids of all detections: edges merge unless a cluster would hold an image twice.

    ``nodes(node, part, <sequence>, ...)`` lists every detection; ``edges(a, b, ...)`` name nodes of one sequence, which
    they may carry as ``<sequence>``.  Whole sequences are scanned in packs, those beyond the limit by components.  Ids count from 1
    in the order of each cluster's first node within its sequence; every other member is ``removed``.
    """
    if sequence in edges.columns:
        checked = edges.select("a", "b", sequence, (-F.col(ratio)).alias("__r"), F.col(seq).alias("__s"))
    else:
        nodes = cut(nodes)
        side = lambda e: nodes.select(F.col("node").alias(e), F.col("part").alias(f"{e}_part"), F.col(sequence).alias(f"{e}_seq"))
        known = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
        wrong = F.when(F.col("a_part").isNull() | F.col("b_part").isNull(), "unknown detection in match edge").when(
            F.col("a_seq") != F.col("b_seq"), "match edge between sequences"
        )
        failed = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean").cast("int").cast(nodes.schema[sequence].dataType))
        checked = known.select("a", "b", failed.otherwise(F.col("a_seq")).alias(sequence), (-F.col(ratio)).alias("__r"), F.col(seq).alias("__s"))
    found, wide, links = folds.grouped_clusters(nodes, cut(checked), sequence, ["__r", "__s"])
    found = found.select(*nodes.columns, F.col("head").alias("cluster"), F.col("place").alias("global_id"), "removed")
    if wide is None:
        return found
    wide = cut(wide)
    side = lambda e: wide.select(F.col("node").alias(e), F.col("part").alias(f"{e}_part"), F.col(sequence))
    ranked = links.join(side("a"), [sequence, "a"], "left").join(side("b"), [sequence, "b"], "left")
    lost = F.when(F.col("a_part").isNull() | F.col("b_part").isNull(), F.raise_error(F.lit("unknown detection in match edge")).cast("boolean"))
    ranked = ranked.filter(lost.isNull()).select(F.struct(F.col("__r").alias("r"), F.col("__s").alias("s"), "a", "b").alias("p"), "a", "a_part", "b", "b_part", sequence)
    clusters = wide.join(folds.clustered(ranked, [sequence]), "node", "left")
    clusters = cut(clusters.withColumn("cluster", F.coalesce("cluster", "node")))
    heads = clusters.filter(F.col("node") == F.col("cluster")).select(sequence, "cluster")
    ids = along(heads, [sequence], [F.col("cluster")], {"global_id": number()})
    out = clusters.join(ids.select("cluster", "global_id"), "cluster").withColumn("removed", F.col("node") != F.col("cluster"))
    return found.unionByName(out)


def survivors(mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections and remaining detections per frame."""
    return mapping.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detections"), F.count_if(~F.col("removed")).alias("kept"),
        F.countDistinct("global_id").alias("ids"),
    )


def component_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def small_component_share(parts: DataFrame, limit: int = 500) -> DataFrame:
    """Components and the share of rows in components under ``limit``."""
    sizes = component_sizes(parts)
    small = F.sum(F.when(F.col("size") < limit, F.col("size")).otherwise(0))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"),
        F.coalesce(F.try_divide(small, F.sum("size")), F.lit(1.0)).alias("small_share"),
    )


def box_nms(det: DataFrame, keys: Sequence[str], ident: str, score: str, threshold: float, fits=None) -> DataFrame:
    """Boxes kept by score; a kept box suppresses later boxes with IoU at or above the threshold.

    Equal boxes are folded to their best one first: the best copy suppresses the rest,
    and whatever suppresses it would suppress them too.
    """
    keys = list(keys)
    p = F.struct((-F.col(score)).alias("s"), F.col(ident).alias("i"))
    best = det.groupBy(*keys, *B.SIDES).agg(F.min(p).alias("p"))
    pairs = overlapping(best, best, keys, fits).filter(
        (F.col("a.p") < F.col("b.p")) & (B.iou(B.sides("a."), B.sides("b.")) >= threshold)
    )
    node = lambda s: F.struct(*keys, F.col(f"{s}.p.i").alias("i"))
    ranked = pairs.select(node("a").alias("better"), node("b").alias("worse"), F.col("a.p").alias("p"))
    lost = folds.suppressed(ranked, [F.col(f"better.{k}").alias(k) for k in keys] or [F.lit(0)], ["p"])
    kept = best.select(F.struct(*keys, F.col("p.i").alias("i")).alias("node")).join(lost, "node", "left_anti")
    flat = kept.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.i").alias(ident))
    return det.join(flat, [*keys, ident], "left_semi")


def track_nms(rows: DataFrame, video: str, track: str, frame: str, scores: DataFrame, threshold: float) -> DataFrame:
    """Tracks kept by score; IoU is taken over the frames both tracks have.

    ``rows`` holds one box per (video, track, frame), ``scores`` one score per track.
    """
    side = rows.select(video, frame, F.col(track).alias("track"), *B.SIDES)
    both = overlapping(side, side, [video, frame]).filter(F.col("a.track") < F.col("b.track"))
    inter = both.groupBy(video, F.col("a.track").alias("x"), F.col("b.track").alias("y")).agg(
        F.sum(B.intersection(B.sides("a."), B.sides("b."))).alias("inter")
    ).filter("inter > 0")
    # Union areas need the frames both tracks have, for pairs that overlap at all.
    areas = side.select(video, frame, "track", B.area(B.sides()).alias("area"))
    shared = inter.join(areas.withColumnRenamed("track", "x").withColumnRenamed("area", "ax"), [video, "x"]).join(
        areas.withColumnRenamed("track", "y").withColumnRenamed("area", "ay"), [video, "y", frame]
    )
    union = shared.groupBy(video, "x", "y", "inter").agg((F.sum("ax") + F.sum("ay")).alias("areas"))
    hits = union.filter(F.col("inter") / (F.col("areas") - F.col("inter")) >= threshold)
    score = lambda t, n: scores.select(video, F.col(track).alias(t), F.col("score").alias(n))
    ranked = hits.join(score("x", "sx"), [video, "x"]).join(score("y", "sy"), [video, "y"])
    first = (F.col("sx") > F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("x") < F.col("y")))
    node = lambda c: F.struct(F.col(video), c.alias("track"))
    edges = ranked.select(
        node(F.when(first, F.col("x")).otherwise(F.col("y"))).alias("better"),
        node(F.when(first, F.col("y")).otherwise(F.col("x"))).alias("worse"),
        F.when(first, F.col("sx")).otherwise(F.col("sy")).alias("s"),
    )
    lost = folds.suppressed(edges, [F.col(f"better.{video}").alias("v")], [F.desc("s"), "better.track"]).select(F.col(f"node.{video}").alias(video), F.col("node.track").alias(track))
    return scores.join(lost, [video, track], "left_anti")


def window_nms(pairs: DataFrame, width: int) -> DataFrame:
    """Similar index pairs thinned by similarity; ``pairs(i, j, sim)`` with i < j."""
    p = F.struct((-F.col("sim")).alias("s"), "i", "j")
    return rounds.window_suppress(pairs.select(p.alias("p"), "i", "j"), width).select(
        "i", "j", (-F.col("p.s")).alias("sim")
    )


def associate(det: DataFrame, trk: DataFrame, keys: Sequence[str], threshold: float, track_threshold: float, new_score: float, fits=None):
    """Detections against tracks of a frame: one-to-one matches, unmatched tracks, new detections, links.

    Matches are greedy by IoU; a track is matched when its pair reaches ``track_threshold``.
    A detection without any IoU at ``threshold`` and with a high score starts a new track.
    """
    keys = list(keys)
    pairs = overlapping(
        det.select(*keys, "det_id", "score", *B.SIDES), trk.select(*keys, "trk_id", *B.SIDES), keys, fits
    ).select(
        *keys, F.col("a.det_id").alias("det_id"), F.col("b.trk_id").alias("trk_id"),
        F.round(B.iou(B.sides("a."), B.sides("b.")), 9).alias("iou"),
    ).filter("iou > 0")
    pairs = cut(pairs)
    seq = pairs.withColumn("seq", F.struct(*keys, "det_id", "trk_id"))
    matched = match_one_to_one(seq, F.struct(*keys, "det_id"), F.struct(*keys, "trk_id"), "iou", "seq", keys or None).drop("seq")
    links = pairs.filter(F.col("iou") >= threshold)
    lone = trk.join(matched.filter(F.col("iou") >= track_threshold), [*keys, "trk_id"], "left_anti")
    fresh = det.filter(F.col("score") >= new_score).join(links, [*keys, "det_id"], "left_anti")
    return matched, lone.select(*keys, "trk_id"), fresh.select(*keys, "det_id"), links


def _gap(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz"), F.lit(0.0)))


def _meeting(pairs: DataFrame, core: DataFrame, eps: float) -> DataFrame:
    """``(a, b)``: components joined by core points at most ``eps`` apart, of paired cells of different components.

    ``pairs`` holds the cells, as columns, the boxes ``a`` and ``b`` of their core points and the two components.  Points
    farther than ``eps`` from the other cell's box don't meet.
    """
    cells = ["cx", "cy", "cz"]
    keys = [f"{s}{c}" for s in "ab" for c in cells]

    def facing(side: str, other: str) -> DataFrame:
        point = core.select(F.struct("x", "y", "z").alias(f"{side}_at"), *[F.col(c).alias(f"{side}{c}") for c in cells])
        out = [F.greatest(F.col(f"{other}.lo{c}") - F.col(f"{side}_at.{c}"), F.col(f"{side}_at.{c}") - F.col(f"{other}.hi{c}"), F.lit(0.0)) for c in "xyz"]
        return pairs.join(point, [f"{side}{c}" for c in cells]).filter(F.sqrt(sum((o * o for o in out), F.lit(0.0))) <= eps)

    both = facing("a", "b").select(*keys, "a_part", "b_part", "a_at").join(facing("b", "a").select(*keys, "b_at"), keys)
    return both.filter(_gap(F.col("a_at"), F.col("b_at")) <= eps).select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()


def dbscan(points: DataFrame, ident: str, eps: float, least: int) -> DataFrame:
    """Density clusters of 3-D points ``(ident, x, y, z)``; noise is -1.

    Equal points are folded.  Cells have a diagonal of ``eps``, so the points of a cell
    are neighbours: a cell with ``least`` points is all core without looking at pairs,
    and the core points of a cell always share a cluster.  Only occupied cells near each other
    are paired; the boxes of their core points and the outermost of these, six a cell, settle most pairs.  Points meet only where
    two cells lie in different components of the links so far, so full cells cost nothing more the fuller they are.
    """
    axes = ["x", "y", "z"]
    cells = ["cx", "cy", "cz"]
    size = eps / 3**0.5 * (1 - 1e-9)
    located = points.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("loc"))
    located = cut(located.withColumns({c: F.floor(F.col(a) / size) for c, a in zip(cells, axes)}))
    boxed = lambda df, *more: df.groupBy(*cells).agg(*box_columns(), *more)
    of = lambda side: [F.col(f"{side}.{c}").alias(f"{side}{c}") for c in cells]
    least_gap, largest_gap = box_gaps("a", "b")

    def met(asking: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
        """Locations ``a`` and ``b`` of paired cells at most ``eps`` apart."""
        packed = lambda df, side: df.select(F.struct(*df.columns).alias(side), *[F.col(c).alias(f"{side}{c}") for c in cells])
        near = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in axes), F.lit(0.0))
        both = packed(asking, "a").join(pairs, [f"a{c}" for c in cells]).join(packed(held, "b"), [f"b{c}" for c in cells])
        return both.filter(F.sqrt(near) <= eps)

    full = cut(boxed(located, (F.sum("n") >= least).alias("dense")))
    pairs = cut(occupied_pairs(full).filter(least_gap <= eps))
    placed = located.join(full.select(*cells, "dense"), cells)
    sparse = placed.filter(~F.col("dense")).select(*located.columns)
    counted = met(sparse, located, pairs.filter("NOT a.dense").select(*of("a"), *of("b")))
    found = counted.groupBy(F.col("a.loc").alias("loc")).agg(F.sum("b.n").alias("degree")).filter(F.col("degree") >= least)
    core = cut(
        placed.filter("dense").select(*located.columns).union(
            sparse.join(found, "loc", "left_semi").select(*located.columns)
        )
    )
    cell = F.struct(*cells)
    struct = lambda side: F.struct(*[F.col(f"{side}{c}").alias(c) for c in cells])
    place = F.struct(*axes)
    tips = F.array(*[f(place, F.col(c)) for c in axes for f in (F.min_by, F.max_by)]).alias("tips")
    touching = F.exists("a.tips", lambda p: F.exists("b.tips", lambda q: _gap(p, q) <= eps))
    held = [*cells, *[f"{n}{c}" for c in axes for n in ("lo", "hi")]]
    boxes = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in held]).alias(side)
    forward = cut(
        occupied_pairs(boxed(core, tips)).filter(struct("a.") < struct("b.")).filter(least_gap <= eps)
        .withColumn("sure", (largest_gap <= eps) | touching).select(boxes("a"), boxes("b"), "sure")
    )
    per_cell = core.groupBy(*cells).agg(F.min("loc").alias("first")).select(cell.alias("node"), "first")
    parts = cut(rounds.components(per_cell, forward.filter("sure").select(struct("a.").alias("a"), struct("b.").alias("b"))))
    # Only cells that are not in one component yet can still add something; points far from the other cell's box can't.
    named = lambda side: parts.select(*[F.col(f"node.{c}").alias(f"{side}{c}") for c in cells], F.col("component").alias(f"{side}_part"))
    open_ = forward.filter(~F.col("sure")).select(*of("a"), *of("b"), "a", "b")
    open_, left = cut_counted(
        open_.join(named("a"), [f"a{c}" for c in cells]).join(named("b"), [f"b{c}" for c in cells]).filter("a_part <> b_part")
    )
    if left:
        more = _meeting(open_, core, eps)
        joined = rounds.components(parts.select("component").distinct().withColumnRenamed("component", "node"), more)
        parts = parts.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component").select(
            "node", "first", F.col("whole").alias("component")
        )
    # Clusters are numbered by their first core point.
    firsts = parts.groupBy("component").agg(F.min("first").alias("first"))
    named = numbered(firsts, [F.col("first")], "cluster", start=0).select("component", "cluster")
    cores = cut(
        core.withColumn("node", cell).join(parts.select("node", "component"), "node").join(named, "component")
        .select(*located.columns, "cluster")
    )
    rest = located.join(cores.select("loc"), "loc", "left_anti")
    border = met(rest, cores.drop("node"), pairs.select(*of("a"), *of("b")))
    owned = border.groupBy(F.col("a.loc").alias("loc")).agg(F.min("b.cluster").alias("cluster"))
    label = cores.select(*axes, "cluster").union(
        rest.join(owned, "loc", "left").select(*axes, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    )
    return points.join(label, axes)


def main_cluster(labelled: DataFrame) -> DataFrame:
    """Largest cluster (lowest label on ties) and whether the second one is too big to ignore:
    at least 32 rows or a fifth of all clustered ones, whichever is less."""
    sizes = labelled.filter("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.withColumn("all", sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar())
    top = top.orderBy(F.col("size").desc(), "cluster").limit(2)
    ranked = along(top, [], [F.col("size").desc(), F.col("cluster")], {"r": number()}, fits=True)
    one = ranked.agg(
        F.max(F.when(F.col("r") == 1, F.col("cluster"))).alias("cluster"),
        F.max(F.when(F.col("r") == 1, F.col("size"))).alias("size"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("size"))), F.lit(0)).alias("second"), F.max("all").alias("clustered"),
    )
    limit = F.least(F.lit(32), F.ceil(F.col("clustered") * 0.2))
    return one.withColumn("ambiguous", (F.col("second") > 0) & (F.col("second") >= limit)).drop("clustered")


def scene_clusters(labelled: DataFrame, share: float = 0.01) -> DataFrame:
    """Rows of clusters with at least ``share`` of all rows, else of the largest cluster."""
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ranked = with_aggregates(
        sizes, [], __n=F.sum("size"),
        __top=F.max(F.when(F.col("cluster") >= 0, F.struct("size", (-F.col("cluster")).alias("c")))),
    )
    big = (F.col("cluster") >= 0) & (F.col("size") >= share * F.col("__n"))
    any_ = with_aggregates(ranked.withColumn("__big", big), [], __any=F.max("__big"))
    keep = F.when(F.col("__any"), F.col("__big")).otherwise(F.col("cluster") == -F.col("__top.c"))
    return labelled.join(any_.filter(keep).select("cluster"), "cluster", "left_semi")


def _nearest_by_part(points: DataFrame, reach: float) -> DataFrame:
    """``(a, a_part, b_part, b, dist)``: each point's nearest point of every other part within ``reach``; the lowest id wins ties.

    Balls grow by factors of two up to ``reach``; the first ones hold few points.  A part that a ball holds a point of is settled,
    so what is still open has few points in the next ball, however many lie within ``reach``.  Joins are sorted ones (``rounds.sorted_side``).
    """
    axes = ["x", "y", "z"]

    def celled(df: DataFrame, width: float) -> DataFrame:
        return df.withColumns({f"c{c}": F.floor(F.col(c) / width) for c in axes})

    def spread(df: DataFrame, size: float) -> DataFrame:
        """A row for each cell, two balls' radii wide, that the ball of a point touches: eight on average."""
        for c in axes:
            far = size * (1 + SLACK) + F.abs(F.col(c)) * 4e-15  # so that rounding loses no pair
            ends = [F.floor((F.col(c) + sign * far) / (2 * size * (1 + 2 * SLACK))) for sign in (-1, 1)]
            df = df.withColumn(f"c{c}", F.explode(F.array_distinct(F.array(F.floor(F.col(c) / (2 * size * (1 + 2 * SLACK))), *ends))))
        return df

    cells = [f"c{c}" for c in axes]
    size, halvings = reach, 0
    while halvings < MOST_HALVINGS:  # points that a point shares its cell with, on average
        crowd = celled(points, size).groupBy(*cells).agg(F.count(F.lit(1)).cast("double").alias("n"))
        if (crowd.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0) <= CROWD:
            break
        size, halvings = size / 2, halvings + 1
    parts = points.select("part").distinct().count()
    asking = points.select(F.col("node").alias("a"), F.col("part").alias("a_part"), *axes)
    held = points.select(F.col("node").alias("b"), F.col("part").alias("b_part"), *axes)
    gap = sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in axes), F.lit(0.0))
    found = None
    for k in range(halvings, -1, -1):
        size = reach / 2**k
        lying = rounds.sorted_side(celled(held, 2 * size * (1 + 2 * SLACK)).withColumnsRenamed({c: f"b_{c}" for c in axes}))
        if found is None:
            met = spread(asking, size).join(lying, cells).filter("a_part <> b_part")
        else:
            known = found.groupBy("a").agg(F.collect_set("b_part").alias("known"))
            asking = asking.select("a", "a_part", *axes).join(rounds.sorted_side(known), "a", "left").withColumn("known", F.array_append(F.coalesce("known", F.array().cast(known.schema["known"].dataType)), F.col("a_part")))
            asking = cut(asking.filter(F.size("known") < parts))
            there = lying.groupBy(*cells).agg(F.collect_set("b_part").alias("there"))
            near = spread(asking, size).join(rounds.sorted_side(there), cells).withColumn("b_part", F.explode(F.array_except("there", "known"))).drop("there", "known")
            met = near.join(lying, [*cells, "b_part"])
        met = met.withColumn("dist", F.sqrt(gap)).filter(F.col("dist") <= size)
        new = met.groupBy("a", "a_part", "b_part").agg(F.min(F.struct("dist", "b")).alias("m")).select("a", "a_part", "b_part", "m.b", "m.dist")
        new = cut(new)
        found = new if found is None else found.unionByName(new)
    return found


def reciprocal_pairs(points: DataFrame, reach: float) -> DataFrame:
    """Cross-frame nearest neighbours that are each other's nearest, within ``reach``.

    Of points of one part at one place only the lowest is named back, so the others take no part.
    """
    placed = points.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz") + " AND part IS NOT NULL")
    folded = cut(placed.groupBy("x", "y", "z", "part").agg(F.min("node").alias("node")))
    nearest = cut(_nearest_by_part(folded, reach))
    mirrored = nearest.select(F.col("b").alias("a"), F.col("b_part").alias("a_part"), F.col("a").alias("b"), F.col("a_part").alias("b_part"))
    pairs = nearest.join(rounds.sorted_side(mirrored), ["a", "a_part", "b", "b_part"], "left_semi").filter("a < b")
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "dist")


def complete_link(points: DataFrame, reach: float, gate) -> DataFrame:
    """Clusters of cross-frame points in which every pair passes the gate."""
    pairs = reciprocal_pairs(points, reach)
    edges = pairs.select(
        F.struct("dist", "x", "y").alias("p"), F.col("x").alias("a"), F.col("y").alias("b")
    )
    return rounds.constrained_clusters(points, edges, gate)
