"""Operators over 3-D points, camera grids and planar shapes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyview.functions import boxes as B
from polyview.functions import geometry as G
from polyview.operators.ordered import merge_intervals
from polyview.plans.scan import along, group_fits, leading
from polyview.plans.spatial import PAIR_LIMIT, overlapping
from polyview.plans.stats import quantiles, with_aggregates
from polyview.session import cut as written

XYZ = ("x", "y", "z")
AREA_LIMIT = 256  # boxes of a key that ``union_area`` sweeps in one row


def xyz(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in XYZ]


def valid_point(least_conf: float | None = None) -> Column:
    """Finite, not the origin, finite confidence, and confident enough."""
    x, y, z = xyz()
    ok = G.finite(x, y, z, F.col("conf")) & ~((x == 0) & (y == 0) & (z == 0))
    return ok if least_conf is None else ok & (F.col("conf") >= least_conf)


def with_voxels(points: DataFrame, size: float, axes: Sequence[str] = XYZ) -> DataFrame:
    return points.withColumns({f"v{a}": F.floor(F.col(a) / size) for a in axes})


def thin(points: DataFrame, keys: Sequence[str], best: Column, ident: str) -> DataFrame:
    """One row per key: the largest ``best``, the lowest id on ties, with the member count."""
    row = F.struct(*[c for c in points.columns if c not in keys])
    out = points.groupBy(*keys).agg(
        F.max_by(row, F.struct(best, -F.col(ident))).alias("r"), F.count(F.lit(1)).alias("members")
    )
    return out.select(*keys, "r.*", "members")


def voxel_sources(points: DataFrame, voxel: Sequence[str], frame: str) -> DataFrame:
    """Share of occupied voxels that at least two frames saw."""
    per = points.groupBy(*voxel).agg(F.countDistinct(frame).alias("frames"))
    return per.agg(
        F.count(F.lit(1)).alias("voxels"), F.count_if(F.col("frames") >= 2).alias("shared"),
        F.coalesce(F.avg((F.col("frames") >= 2).cast("double")), F.lit(0.0)).alias("share"),
    )


def moments(points: DataFrame, keys: Sequence[str], origin: Sequence[float] | None = None) -> DataFrame:
    """Count, centroid and covariance per group from one pass of plain sums.

    Coordinates are taken relative to a shared origin (by default the overall mean)
    first, so that sums of squares keep their digits for far-away clouds.
    """
    if origin is None:
        shifted = with_aggregates(points, [], **{f"__o{a}": F.avg(a) for a in XYZ})
    else:
        shifted = points.withColumns({f"__o{a}": F.lit(float(o)) for a, o in zip(XYZ, origin)})
    d = {a: F.col(a) - F.col(f"__o{a}") for a in XYZ}
    pairs = ["xx", "yy", "zz", "xy", "xz", "yz"]
    sums = [F.count(F.lit(1)).alias("n"), *[F.first(f"__o{a}").alias(f"o{a}") for a in XYZ]]
    sums += [F.sum(d[a]).alias(f"s{a}") for a in XYZ]
    sums += [F.sum(d[p[0]] * d[p[1]]).alias(f"s{p}") for p in pairs]
    agg = shifted.groupBy(*keys).agg(*sums) if keys else shifted.agg(*sums)
    n = F.col("n")
    cov = [F.try_divide(f"s{p}", n) - F.try_divide(F.col(f"s{p[0]}") * F.col(f"s{p[1]}"), n * n) for p in pairs]
    return agg.select(
        *keys, "n", *[(F.col(f"o{a}") + F.try_divide(f"s{a}", n)).alias(f"c{a}") for a in XYZ],
        *[c.alias(p) for c, p in zip(cov, pairs)],
    )


def plane_fit(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best plane per group: centroid, unit normal, RMS residual; under 3 points invalid.

    The 3 x 3 eigenproblem is solved in closed form, in stages, so that generated code
    stays small.
    """
    m = moments(points, keys)
    cov = {p: F.col(p) for p in ("xx", "yy", "zz", "xy", "xz", "yz")}
    valued = m.withColumn("__value", G.smallest_eigenvalue(cov))
    picked = valued.withColumn("__v", G.eigenvector_candidates(F.col("__value"), cov))
    normal = G.unit_positive([F.col(f"__v.{a}") for a in XYZ])
    ok = F.col("n") >= 3
    return picked.select(
        *keys, "n", "cx", "cy", "cz", *[F.when(ok, c).alias(f"n{a}") for a, c in zip(XYZ, normal)],
        F.when(ok, F.sqrt(F.greatest(F.lit(0.0), F.col("__value")))).alias("rms"), ok.alias("fitted"),
    )


def _solve(m) -> dict[str, float]:
    """Plane of one row of moments: a 3 x 3 eigenproblem on nine numbers."""
    cov = np.array([[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]])
    values, vectors = np.linalg.eigh(cov)
    normal = vectors[:, 0] * np.sign(vectors[np.argmax(np.abs(vectors[:, 0])), 0])
    return {**{f"n{a}": float(c) for a, c in zip(XYZ, normal)}, **{f"c{a}": float(m[f"c{a}"]) for a in XYZ},
            "rms": float(max(values[0], 0.0) ** 0.5)}


def _distance(plane: dict[str, float]) -> Column:
    x, y, z = xyz()
    a, b, c = (float(plane[f"n{k}"]) for k in XYZ)
    off = sum(float(plane[f"n{k}"]) * float(plane[f"c{k}"]) for k in XYZ)
    return F.abs(x * a + y * b + z * c - off)


def _planes(rows: list) -> list[dict]:
    """Planes through consecutive triplets of rows; collinear ones are left out."""
    planes = []
    for i in range(0, len(rows) - 2, 3):
        a, b, c = ([float(r[k]) for k in XYZ] for r in rows[i : i + 3])
        u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        size = sum(t * t for t in n) ** 0.5
        if size > 0:
            planes.append({**{f"n{k}": t / size for k, t in zip(XYZ, n)}, **{f"c{k}": t for k, t in zip(XYZ, a)}})
    return planes


def trials_needed(share: float, least: int, most: int, sure: float = 0.999) -> int:
    """Triplets after which one lies wholly in a plane of this share of the rows, with probability ``sure``."""
    share = min(max(share, 1e-9), 1 - 1e-12)
    return min(most, max(least, math.ceil(math.log(1 - sure) / math.log(1 - share**3))))


def _near_counts(points: DataFrame, planes: list[dict], reach: float) -> dict[int, int]:
    """Rows within ``reach`` of each plane, counted by tasks and added up."""
    normals = np.array([[p[f"n{k}"] for k in XYZ] for p in planes])
    offsets = (normals * np.array([[p[f"c{k}"] for k in XYZ] for p in planes])).sum(axis=1)

    def run(batches):
        counts = np.zeros(len(normals), np.int64)
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k), np.float64) for k in range(3)], axis=1)
            for at in range(0, len(rows), 1000):
                counts += (np.abs(rows[at : at + 1000] @ normals.T - offsets) <= reach).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["plane", "n"])

    numbers = points.select(*[F.col(c).cast("double") for c in XYZ]).mapInArrow(run, "plane long, n long")
    return {r["plane"]: r["n"] for r in numbers.groupBy("plane").agg(F.sum("n").alias("n")).collect()}


def plane_search(
    points: DataFrame, ident: str, reach: float = 0.012, trim: float = 0.010, rounds: int = 10,
    least: int = 10_000, least_share: float = 0.10, seed: int = 42, trials: tuple[int, int] = (128, 10_000), batch: int = 2048,
) -> dict | None:
    """Dominant plane by random triplets in hash order; None when a gate fails.

    Triplets are counted in batches, one pass over the points each: first the least number of trials, then what the
    best share so far still asks for.  Refinement fits the rows within ``reach``, then only drops rows farther than ``trim`` from the
    latest fit, at most ``rounds`` times (``converged`` tells whether it stood still); ``least`` and
    ``least_share`` must hold before and after each step, and the 95th percentile of the distances within ``trim``.
    The driver sees three rows per triplet of a batch and a few sums.
    """
    points = written(points.select(ident, *XYZ))
    total = points.count()
    if total < 3:
        return None
    best, plane, tried, target = 0, None, 0, trials[1]
    while tried < target:
        # a batch's triplets are the lowest rows of a hash of its own
        rank = F.xxhash64(F.lit(seed), F.lit(tried), F.col(ident))
        size = trials[0] if tried == 0 else min(batch, target - tried)
        rows = points.orderBy(rank, ident).limit(3 * size).collect()
        planes = _planes(rows)
        tried += max(1, len(rows) // 3)
        if not planes:
            continue
        counts = _near_counts(points, planes, reach)
        for i, candidate in enumerate(planes):
            if counts.get(i, 0) > best:
                best, plane = counts[i], candidate
        target = trials_needed(best / total, *trials)
        if best == total:
            break
    if plane is None:
        return None
    enough = lambda n: n >= least and n / total >= least_share
    left = points.filter(_distance(plane) <= reach)
    count, converged = best, False
    for _ in range(rounds):
        if not enough(count) or count < 3:
            return None
        plane = _solve(moments(left, [], [plane[f"c{a}"] for a in XYZ]).first())
        kept = left.filter(_distance(plane) <= trim)
        seen = kept.count()
        converged = seen == count
        left, count = kept, seen
        if converged:
            break
        left = written(left)
    if not enough(count):
        return None
    p95 = quantiles(left.withColumn("__d", _distance(plane)), [], F.col("__d"), {"p": 0.95}).first()["p"]
    if p95 is None or p95 > trim:
        return None
    return {**plane, "inliers": count, "share": count / total, "trials": tried, "p95": float(p95), "converged": converged}


def densest_bands(
    rows: DataFrame, height: str, frame: str, width: float = 0.024, candidates: int = 8,
    trim: float = 0.010, rounds: int = 10,
) -> list[dict]:
    """Height bands by density, each re-centred on the median of per-frame medians.

    A found band removes its surroundings from the search.  Only a handful of numbers
    per candidate reach the driver.
    """
    from polyview.operators.ordered import densest_window
    from polyview.plans.stats import medians

    rows = written(rows.select(height, frame))
    fits = group_fits(rows, [])
    found, left = [], rows
    for index in range(candidates):
        start = densest_window(left, height, width).first()
        if start is None or start["start"] is None:
            break
        lo = start["start"]
        raw = quantiles(left.filter(F.col(height).between(lo, lo + width)), [], F.col(height), {"m": 0.5}, fits).first()["m"]
        offset = raw
        for _ in range(rounds):
            near = rows.filter(F.abs(F.col(height) - offset) <= width / 2)
            per = medians(near, [frame], {"m": F.col(height)}, fits)
            middle = quantiles(per, [], F.col("m"), {"mm": 0.5}, fits).first()
            if middle is None or middle["mm"] is None:
                break
            change, offset = abs(middle["mm"] - offset), middle["mm"]
            if change <= 1e-9:
                break
        gap = F.abs(F.col(height) - offset)
        stats = rows.agg(
            F.count_if(gap <= trim).alias("inliers"), F.count(F.lit(1)).alias("n"),
            F.countDistinct(F.when(gap <= trim, F.col(frame))).alias("frames"),
        ).first()
        found.append({"index": index, "raw": float(raw), "offset": float(offset), "inliers": stats["inliers"],
                      "share": stats["inliers"] / stats["n"], "frames": stats["frames"]})
        left = left.filter((F.abs(F.col(height) - raw) > width) & (F.abs(F.col(height) - offset) > width))
    return found


def lowest_band(found: list[dict], least: int, least_frames: int) -> dict | None:
    """The lowest band that passes its gates."""
    good = [b for b in found if b["inliers"] >= least and b["frames"] >= least_frames]
    return min(good, key=lambda b: b["offset"]) if good else None


def hit_counts(points: DataFrame, boxes: DataFrame, frame: str, fits: bool | None = None) -> DataFrame:
    """Inclusive hits of each reference object's points in each box of the frame.

    ``points(frame, ref_id, x, y)``; equal points of an object are folded into one row
    with a count.  Pairs without a hit are not listed: see ``with_zero_boxes``.
    """
    folded = points.groupBy(frame, "ref_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    totals = folded.groupBy(frame, "ref_id").agg(F.sum("n").alias("total"))
    flat = folded.select(
        frame, "ref_id", "n", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    pairs = overlapping(flat, boxes.select(frame, "box_id", *B.SIDES), [frame], fits)
    hits = pairs.groupBy(frame, F.col("a.ref_id").alias("ref_id"), F.col("b.box_id").alias("box_id")).agg(
        F.sum("a.n").alias("hits")
    )
    return hits.join(totals, [frame, "ref_id"]).withColumn("ratio", F.col("hits") / F.col("total"))


def sampled_hits(
    refs: DataFrame, boxes: DataFrame, frame: str, samples: Sequence[tuple[Column, Column]], fits: bool | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``hit_counts`` of references that have the same few points each.

    ``refs(frame, ref_id, …)`` has one row per reference and ``samples`` are the x and y of its points over that row.
    While frames are small, a reference meets each box of its frame once and its points are counted there: neither
    points nor single hits are shuffled.  Columns ``carry`` of both sides come along in structs ``r`` and ``t``.
    """
    packed = lambda df, key, name: df.select(frame, key, F.struct(*carry).alias(name))
    if fits is None:
        fits = group_fits(refs, [frame], PAIR_LIMIT) and group_fits(boxes, [frame], PAIR_LIMIT)
    if not fits:
        spots = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in samples]))
        points = refs.select(frame, "ref_id", spots.alias("p")).select(frame, "ref_id", "p.x", "p.y")
        hits = hit_counts(points, boxes, frame, False)
        return hits.join(packed(refs, "ref_id", "r"), [frame, "ref_id"]).join(packed(boxes, "box_id", "t"), [frame, "box_id"]) if carry else hits
    pairs = refs.join(boxes.select(frame, F.struct("box_id", *dict.fromkeys([*B.SIDES, *carry])).alias("b")), frame)
    inside = [x.between(F.col("b.x1"), F.col("b.x2")) & y.between(F.col("b.y1"), F.col("b.y2")) for x, y in samples]
    hits = sum((F.when(i, 1).otherwise(0) for i in inside[1:]), F.when(inside[0], 1).otherwise(0))
    total = F.lit(len(samples)).cast("long")
    carried = [F.struct(*carry).alias("r"), F.struct(*[f"b.{c}" for c in carry]).alias("t")] if carry else []
    return pairs.select(
        frame, "ref_id", F.col("b.box_id").alias("box_id"), hits.cast("long").alias("hits"), total.alias("total"), *carried
    ).filter("hits > 0").withColumn("ratio", F.col("hits") / F.col("total"))


def with_zero_boxes(hits: DataFrame, boxes: DataFrame, frame: str) -> DataFrame:
    """Every box with its hit total and best ratio; boxes nobody hit have zeros."""
    per = hits.groupBy(frame, "box_id").agg(F.sum("hits").alias("hits"), F.max("ratio").alias("best_ratio"))
    return boxes.select(frame, "box_id").join(per, [frame, "box_id"], "left").fillna(0, ["hits"]).fillna(0.0, ["best_ratio"])


def candidates_over_limit(hits: DataFrame, frame: str, top: int) -> DataFrame:
    """How many boxes each reference hit, and how many of them the limit of ``candidate_scores`` leaves unscored."""
    return hits.groupBy(frame, "ref_id").agg(F.count(F.lit(1)).alias("boxes")).withColumn("unscored", F.greatest(F.col("boxes") - top, F.lit(0).cast("long")))


def candidate_scores(
    hits: DataFrame, refs: DataFrame | None, targets: DataFrame | None, frame: str, least_ratio: float, reach: float,
    normals: bool = False, top: int | None = None,
) -> DataFrame:
    """Score the boxes that each reference hits by ratio, distance and coplanarity.

    All of them are scored, unless the caller wants only the ``top`` most-hit ones (see ``candidates_over_limit``).  Without ``refs`` and ``targets`` the hits carry their geometry in structs ``r`` and ``t`` (see ``sampled_hits``).
    """
    short = hits
    if top is not None:
        rank = F.row_number().over(Window.partitionBy(frame, "ref_id").orderBy(F.col("hits").desc(), "box_id"))
        short = hits.withColumn("__r", rank).filter(F.col("__r") <= top).drop("__r")
    short = short.filter(F.col("ratio") >= least_ratio)
    packed = lambda df, key, name: df.select(frame, key, F.struct(*[c for c in df.columns if c not in (frame, key)]).alias(name))
    both = short if refs is None else short.join(packed(refs, "ref_id", "r"), [frame, "ref_id"])
    both = both if targets is None else both.join(packed(targets, "box_id", "t"), [frame, "box_id"])
    gap = [F.col(f"r.c{a}") - F.col(f"t.c{a}") for a in XYZ]
    distance = G.norm(gap)
    geometry = F.greatest(F.lit(0.0), 1 - distance / reach)
    if normals:
        facing = F.abs(G.dot([F.col(f"r.n{a}") for a in XYZ], [F.col(f"t.n{a}") for a in XYZ]))
        coplanar = F.coalesce(facing * F.greatest(F.lit(0.0), 1 - F.col("t.rms") / reach), F.lit(0.0))
        score = F.col("ratio") * 0.5 + geometry * 0.2 + coplanar * 0.3
    else:
        score = F.col("ratio") * 0.6 + geometry * 0.4
    scored = both.withColumns({"distance": distance, "score": score}).filter(F.col("distance") <= reach)
    place = F.row_number().over(Window.partitionBy(frame, "ref_id").orderBy(F.col("score").desc(), "box_id"))
    return scored.withColumn("place", place).select(
        frame, "ref_id", "box_id", "hits", "total", "ratio", "distance", "score", "place"
    )


def region_labels(points: DataFrame, regions: DataFrame, frame: str, fits: bool | None = None) -> DataFrame:
    """The lowest region number that covers each point, else -1."""
    flat = points.select(
        frame, "point_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    covered = overlapping(flat, regions.select(frame, "label", *B.SIDES), [frame], fits)
    first = covered.groupBy(frame, F.col("a.point_id").alias("point_id")).agg(F.min("b.label").alias("label"))
    return points.join(first, [frame, "point_id"], "left").fillna(-1, ["label"])


def reproject(
    source: DataFrame, pairs: DataFrame, target: DataFrame, camera: dict[str, float], height: int, width: int,
    tolerance: float = 0.020,
) -> DataFrame:
    """Class of each source point in each planned target frame.

    ``source(frame, point_id, x, y, z)`` in world space, ``pairs(frame, target, r…, t…)``
    with the target's pose, ``target(target, row, col, depth, valid)``.
    """
    placed = source.join(pairs, "frame")
    rotation = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    cam = G.transform(rotation, [F.col(f"t{i}") for i in range(3)], xyz())
    at = placed.withColumns({"cam_x": cam[0], "cam_y": cam[1], "cam_z": cam[2]})
    u, v = G.pixel(xyz("cam_"), F.lit(camera["fx"]), F.lit(camera["fy"]), F.lit(camera["cx"]), F.lit(camera["cy"]))
    front = F.col("cam_z") > 0
    seen = at.withColumns({"col": F.when(front, F.rint(u)).cast("int"), "row": F.when(front, F.rint(v)).cast("int")})
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    looked = seen.join(target, ["target", "row", "col"], "left")
    residual = F.col("cam_z") - F.col("depth")
    kind = (
        F.when(~front, "behind").when(~F.coalesce(inside, F.lit(False)), "outside")
        .when(~F.coalesce("valid", F.lit(False)), "invalid")
        .when(F.abs(residual) <= tolerance, "within").when(residual < 0, "nearer").otherwise("farther")
    )
    return looked.select("frame", "target", "point_id", kind.alias("kind"), F.when(F.col("valid"), residual).alias("residual"))


def patches(grid: DataFrame) -> DataFrame:
    """Depth range and mean of the 2 x 2 patch whose top-left pixel is (row, col).

    The patch counts only with four valid depths that spread at most 3 %.
    """
    shifts = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)]))
    moved = grid.withColumn("s", shifts).select(
        "frame", (F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"),
        F.when(F.col("valid"), F.col("depth")).alias("depth"),
    )
    per = moved.groupBy("frame", "row", "col").agg(
        F.count("depth").alias("n"), F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.avg("depth").alias("mean")
    )
    return per.filter((F.col("n") == 4) & (F.col("lo") > 0) & (F.col("hi") - F.col("lo") <= 0.03 * F.col("lo"))).select(
        "frame", "row", "col", "mean"
    )


def view_votes(
    source: DataFrame, pairs: DataFrame, grid: DataFrame, camera: dict[str, float], height: int, width: int
) -> DataFrame:
    """Support, occlusion and conflict votes of planned other frames, and the hidden flag."""
    placed = source.join(pairs, "frame")
    rotation = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    cam = G.transform(rotation, [F.col(f"t{i}") for i in range(3)], xyz())
    at = placed.withColumns({"cam_x": cam[0], "cam_y": cam[1], "cam_z": cam[2]}).filter("cam_z > 0")
    u, v = G.pixel(xyz("cam_"), F.lit(camera["fx"]), F.lit(camera["fy"]), F.lit(camera["cx"]), F.lit(camera["cy"]))
    seen = at.withColumns({"u": u, "v": v}).filter(
        (F.col("u") >= 0) & (F.col("u") < width - 1) & (F.col("v") >= 0) & (F.col("v") < height - 1)
    )
    keyed = seen.select(
        "point_id", F.col("target").alias("frame"), F.floor("v").cast("int").alias("row"), F.floor("u").cast("int").alias("col"), "cam_z"
    )
    voted = keyed.join(patches(grid), ["frame", "row", "col"])
    delta, tol = F.col("cam_z") - F.col("mean"), 0.015 * F.col("mean")
    per = voted.groupBy("point_id").agg(
        F.count_if(F.abs(delta) <= tol).alias("support"), F.count_if(delta > tol).alias("occlusion"),
        F.count_if(delta < -tol).alias("conflict"),
    )
    out = source.select("point_id").join(per, "point_id", "left").fillna(0)
    hidden = (F.col("conflict") >= 3) & (F.col("conflict") * 4 >= (F.col("support") + F.col("conflict")) * 3)
    return out.withColumn("hidden", hidden)


def vote_histogram(votes: DataFrame) -> DataFrame:
    """``(kind, votes, points)``: how many points have each number of votes of each kind; one map-side combined count for all kinds."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("votes")) for k in ("support", "occlusion", "conflict")])
    return votes.select(F.explode(kinds).alias("v")).groupBy("v.kind", "v.votes").agg(F.count(F.lit(1)).alias("points"))


def vote_retention(votes: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """Per object of ``owners(point_id, owner)``: points before and after hiding, and the fraction that stays; unvoted points stay."""
    joined = owners.join(votes.select("point_id", "hidden"), "point_id", "left")
    hidden = F.count_if(F.coalesce("hidden", F.lit(False)))
    before = F.count(F.lit(1))
    return joined.groupBy(owner).agg(before.alias("before"), (before - hidden).alias("after"), hidden.alias("hidden"), ((before - hidden) / before).alias("retained"))


def best_owner(points: DataFrame, patch: Sequence[str], fine: Sequence[str], frame: str, score: str) -> DataFrame:
    """Rows of each patch's best frame; fine voxels left empty are decided on their own."""

    def owners(rows, keys):
        totals = rows.groupBy(*keys, frame).agg(F.round(F.sum(score), 9).alias("__s"))
        return totals.groupBy(*keys).agg(F.max_by(frame, F.struct("__s", -F.col(frame))).alias("__owner"))

    marked = points.join(owners(points, list(patch)), list(patch)).withColumn("__keep", F.col(frame) == F.col("__owner")).drop("__owner")
    covered = marked.groupBy(*fine).agg(F.max("__keep").alias("__has"))
    split = marked.join(covered, list(fine))
    kept = split.filter("__has AND __keep")
    holes = split.filter("NOT __has")
    refilled = holes.join(owners(holes, list(fine)), list(fine)).filter(F.col(frame) == F.col("__owner"))
    return kept.select(*points.columns).union(refilled.select(*points.columns))


def oriented_extent(flat: DataFrame, keys: Sequence[str], steps: int = 180, least: float = 0.05) -> DataFrame:
    """Smallest rectangle over evenly spaced angles per group of 2-D points ``(u, v)``.

    The spans per angle combine map-side.  With steps of 180/steps degrees a side is at
    most ``diagonal * sin(step / 2)`` longer than at the best angle.
    """
    angle = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("angle")
    rad = F.radians(F.col("angle") * (180.0 / steps) / 2)
    a = F.col("u") * F.cos(rad) + F.col("v") * F.sin(rad)
    b = -F.col("u") * F.sin(rad) + F.col("v") * F.cos(rad)
    spans = flat.select(*keys, "u", "v", angle).groupBy(*keys, "angle").agg(
        (F.max(a) - F.min(a)).alias("w"), (F.max(b) - F.min(b)).alias("h")
    )
    area = F.round(F.col("w") * F.col("h"), 9)
    best = spans.groupBy(*keys).agg(F.min_by(F.struct("w", "h", "angle"), F.struct(area, F.col("angle"))).alias("r"))
    side = lambda f: F.greatest(F.lit(least), f("r.w", "r.h"))
    return best.select(
        *keys, side(F.greatest).alias("long_side"), side(F.least).alias("short_side"), F.col("r.angle").alias("angle")
    ).withColumn("area", F.col("long_side") * F.col("short_side"))


def footprint_points(points: DataFrame, label: str, ident: str, voxel: float, least_height: float) -> DataFrame:
    """Elevated points, first per 2-D voxel of their label, trimmed to 1-99 % per axis."""
    high = points.filter(F.col("height") >= least_height)
    celled = high.withColumns({"__cu": F.floor(F.col("u") / voxel), "__cv": F.floor(F.col("v") / voxel)})
    row = F.struct("u", "v")
    first = celled.groupBy(label, "__cu", "__cv").agg(F.min_by(row, ident).alias("r")).select(label, "r.*")
    cut_u = quantiles(first, [label], F.col("u"), {"u1": 0.01, "u2": 0.99})
    cut_v = quantiles(first, [label], F.col("v"), {"v1": 0.01, "v2": 0.99})
    return first.join(cut_u, label).join(cut_v, label).filter(
        F.col("u").between(F.col("u1"), F.col("u2")) & F.col("v").between(F.col("v1"), F.col("v2"))
    ).select(label, "u", "v")


def _swept_area(boxes: DataFrame, key: str) -> DataFrame:
    """``union_area`` of small groups: in each slab between two x edges, boxes add the y range above what lower ones reached."""
    rows = boxes.filter("x2 > x1 AND y2 > y1").groupBy(key).agg(F.sort_array(F.collect_set(F.struct("y1", "y2", "x1", "x2"))).alias("__b"))
    ends = lambda side: F.transform("__b", lambda b: b[side])
    rows = rows.withColumn("__x", F.sort_array(F.array_distinct(F.concat(ends("x1"), ends("x2")))))
    start = F.struct(F.lit(0.0).alias("height"), F.lit(float("-inf")).alias("reach"))

    def raised(seen: Column, b: Column) -> Column:
        height = seen["height"] + F.greatest(F.lit(0.0), b["y2"] - F.greatest(b["y1"], seen["reach"]))
        return F.struct(height.alias("height"), F.greatest(seen["reach"], b["y2"]).alias("reach"))

    def slab(left: Column, right: Column) -> Column:
        return (right - left) * F.aggregate(F.filter("__b", lambda b: (b["x1"] <= left) & (b["x2"] >= right)), start, raised, lambda s: s["height"])

    last = F.size("__x") - 1
    slabs = F.zip_with(F.slice("__x", F.lit(1), last), F.slice("__x", F.lit(2), last), slab)
    return rows.select(key, F.aggregate(slabs, F.lit(0.0), lambda a, b: a + b).alias("area"))


def union_area(boxes: DataFrame, key: str, tile: float = 256.0, fits: bool | None = None) -> DataFrame:
    """Exact area of the union of axis-aligned boxes per key.

    Keys of at most ``AREA_LIMIT`` boxes (measured) sweep their own row of boxes, see ``_swept_area``; rows are grouped once and
    no slab is shuffled.  Otherwise boxes are cut at tile borders, so areas add up over tiles and a crowded key is
    spread.  Inside a tile the distinct x edges form slabs; the y intervals of the
    boxes that span a slab are merged.
    """
    if group_fits(boxes, [key], AREA_LIMIT) if fits is None else fits:
        return _swept_area(boxes, key)
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.ceil(F.col(hi) / tile) - 1))
    pieces = (
        boxes.filter("x2 > x1 AND y2 > y1").select(key, *B.SIDES)
        .withColumn("tx", span("x1", "x2")).withColumn("ty", span("y1", "y2"))
        .select(
            key, "tx", "ty",
            F.greatest("x1", F.col("tx") * tile).alias("x1"), F.greatest("y1", F.col("ty") * tile).alias("y1"),
            F.least("x2", (F.col("tx") + 1) * tile).alias("x2"), F.least("y2", (F.col("ty") + 1) * tile).alias("y2"),
        ).distinct()
    )
    pieces = written(pieces)
    keys = [key, "tx", "ty"]
    edges = pieces.select(*keys, F.explode(F.array("x1", "x2")).alias("sx")).distinct()
    slabs = along(edges, keys, [F.col("sx")], {"ex": leading(F.col("sx"))}).filter("ex IS NOT NULL")
    strips = written(slabs.join(pieces, keys).filter("x1 <= sx AND x2 >= ex").select(*keys, "sx", "ex", "y1", "y2"))
    merged = merge_intervals(strips, [*keys, "sx", "ex"], "y1", "y2")
    return merged.groupBy(key).agg(F.sum((F.col("ex") - F.col("sx")) * (F.col("y2") - F.col("y1"))).alias("area"))


def polygon_edges(vertices: DataFrame, poly: str, seq: str) -> DataFrame:
    """Edges of each polygon; the last vertex links back to the first."""
    first = vertices.groupBy(poly).agg(
        F.min_by(F.struct("x", "y"), seq).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    step = along(vertices, [poly], [F.col(seq)], {"__next": leading(F.struct("x", "y"))})
    nxt = F.coalesce("__next", "__first")
    return step.join(first, poly).select(
        poly, F.col(seq).alias("edge"), F.col("__n").alias("n"),
        F.col("x").alias("ax"), F.col("y").alias("ay"), nxt["x"].alias("bx"), nxt["y"].alias("by"),
        F.col("__first.x").alias("ox"), F.col("__first.y").alias("oy"),
    )


def polygon_area(vertices: DataFrame, poly: str, seq: str, fits: bool | None = None) -> DataFrame:
    """Shoelace area per polygon and whether it is simple: no repeats, no crossings, not thin."""
    edges = polygon_edges(vertices, poly, seq)
    ax, ay = F.col("ax") - F.col("ox"), F.col("ay") - F.col("oy")
    bx, by = F.col("bx") - F.col("ox"), F.col("by") - F.col("oy")
    areas = edges.groupBy(poly).agg(
        F.max("n").alias("vertices"), (F.abs(F.sum(ax * by - bx * ay)) / 2).alias("area"),
    )
    copies = vertices.groupBy(poly, "x", "y").count().groupBy(poly).agg((F.max("count") > 1).alias("repeats"))
    boxed = edges.select(
        poly, "edge", "ax", "ay", "bx", "by",
        F.least("ax", "bx").alias("x1"), F.least("ay", "by").alias("y1"),
        F.greatest("ax", "bx").alias("x2"), F.greatest("ay", "by").alias("y2"),
    )
    turn = lambda p, q, r: (F.col(q + "x") - F.col(p + "x")) * (F.col(r + "y") - F.col(p + "y")) - (
        F.col(q + "y") - F.col(p + "y")
    ) * (F.col(r + "x") - F.col(p + "x"))
    crosses = (turn("a.a", "a.b", "b.a") * turn("a.a", "a.b", "b.b") < 0) & (
        turn("b.a", "b.b", "a.a") * turn("b.a", "b.b", "a.b") < 0
    )
    crossed = overlapping(boxed, boxed, [poly], fits).filter((F.col("a.edge") < F.col("b.edge")) & crosses).select(poly).distinct()
    joined = areas.join(copies, poly).join(crossed.withColumn("crossing", F.lit(True)), poly, "left").fillna({"crossing": False})
    return joined.withColumn(
        "simple", (F.col("vertices") >= 3) & ~F.col("repeats") & ~F.col("crossing") & (F.col("area") > 1e-9)
    ).select(poly, "vertices", "area", "repeats", "crossing", "simple")


def block_thinning(pixels: DataFrame, obj: str, gate: Column, spread: float) -> DataFrame:
    """Keep only the top-left row of complete, coherent 2 x 2 pixel blocks of one object."""
    keys = [obj, "frame", "__br", "__bc"]
    placed = pixels.withColumns({
        "__br": F.floor(F.col("row") / 2), "__bc": F.floor(F.col("col") / 2), "__gate": F.coalesce(gate, F.lit(False)),
    })
    blocks = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row", "col").alias("cells"), F.bool_and("__gate").alias("ok"),
        (F.max("depth") - F.min("depth")).alias("range"), F.min("depth").alias("near"),
    )
    thin_ = (F.col("n") == 4) & (F.col("cells") == 4) & F.col("ok") & (F.col("range") <= spread * F.col("near"))
    marked = placed.join(blocks.select(*keys, thin_.alias("__thin")), keys)
    corner = (F.col("row") % 2 == 0) & (F.col("col") % 2 == 0)
    return marked.filter(~F.col("__thin") | corner).select(*pixels.columns, F.col("__thin").alias("thinned"))
