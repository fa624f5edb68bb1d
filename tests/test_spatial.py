"""Grid joins, neighbour searches and shapes against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyview.operators import detections as D
from polyview.operators import linking as L
from polyview.operators import points as P
from polyview.operators import vectors as V
from polyview.plans import knn


def boxes(spark, seed=1, n=120):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        image = 0 if i % 3 == 0 else rnd.randrange(1, 6)
        x, y = rnd.randrange(0, 300, 10), rnd.randrange(0, 200, 10)
        rows.append((image, i, float(x), float(y), float(x + rnd.randrange(10, 120, 10)), float(y + rnd.randrange(10, 120, 10)), rnd.randrange(10) / 10))
    rows += [(0, 1000 + i, 5.0, 5.0, 55.0, 45.0, 0.5) for i in range(30)]
    return spark.createDataFrame(rows, "image_id int, object_id int, x1 double, y1 double, x2 double, y2 double, score double").cache()


def same(a, b):
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())
    assert key(a) == key(b)


def test_grid_equals_direct(spark):
    det = boxes(spark)
    same(D.iou_pairs(det, 0.1, fits=True), D.iou_pairs(det, 0.1, fits=False))
    same(D.overlap_stats(det, 0.1, fits=True), D.overlap_stats(det, 0.1, fits=False))
    same(D.prune_containers(det, fits=True), D.prune_containers(det, fits=False))
    flat = lambda df: df.select("image_id", "object_id", F.to_json("regions").alias("r"))
    same(flat(D.free_regions(det, 0.1, fits=True)), flat(D.free_regions(det, 0.1, fits=False)))


def test_overlap_stats_count_copies(spark):
    det = boxes(spark)
    stats = {r["image_id"]: r for r in D.overlap_stats(det, 0.1).collect()}
    pairs = {r["image_id"]: r["n"] for r in D.iou_pairs(det, 0.1).groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {i: r["pairs"] for i, r in stats.items() if r["pairs"]} == pairs


def test_nms_with_copies(spark):
    det = boxes(spark)
    rows = sorted(det.collect(), key=lambda r: (-r["score"], r["object_id"]))
    kept = []

    def iou(a, b):
        w = max(0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]))
        h = max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
        area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
        return w * h / (area(a) + area(b) - w * h)

    for r in rows:
        if not any(k["image_id"] == r["image_id"] and iou(k, r) >= 0.3 for k in kept):
            kept.append(r)
    want = {(r["image_id"], r["object_id"]) for r in kept}
    for fits in (True, False):
        out = L.box_nms(det, ["image_id"], "object_id", "score", 0.3, fits=fits)
        assert {(r["image_id"], r["object_id"]) for r in out.collect()} == want


def test_union_area_on_a_raster(spark):
    det = boxes(spark)
    got = {r["image_id"]: r["area"] for r in P.union_area(det, "image_id", tile=70.0).collect()}
    for image in got:
        mask = np.zeros((500, 500), dtype=bool)
        for r in det.filter(F.col("image_id") == image).collect():
            mask[int(r["x1"]) : int(r["x2"]), int(r["y1"]) : int(r["y2"])] = True
        assert got[image] == mask.sum()


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_nearest_in_small_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(knn, "PIVOT_ROWS", 20)
    rng = np.random.default_rng(2)
    vecs = np.concatenate([rng.normal(c, 0.3, (40, 5)) for c in (0, 4)] + [np.repeat(rng.normal(0, 1, (1, 5)), 40, axis=0)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = {}
    for r in knn.nearest(df, df, 3, metric, exclude_self=True).collect():
        got.setdefault(r["target"], []).append((r["rank"], r["source"]))
    for i, v in enumerate(vecs):
        cost = np.sqrt(((vecs - v) ** 2).sum(axis=1)) if metric == "l2" else -(vecs @ v)
        order = sorted((round(float(c), 9), j) for j, c in enumerate(cost) if j != i)[:3]
        assert [s for _, s in sorted(got[i])] == [j for _, j in order]


def test_knn_without_sources(spark):
    some = spark.createDataFrame([(1, [0.0, 1.0])], "id long, vec array<double>")
    row = V.knn(some, some.limit(0), 2).first()
    assert (row["source"], row["distance"]) == (-1, 0.0)


def test_mean_neighbour_distance_with_copies_and_outliers(spark):
    rng = np.random.default_rng(3)
    cloud = np.concatenate([rng.normal(0, 0.1, (60, 3)), np.repeat([[0.5, 0.5, 0.5]], 30, axis=0), [[9.0, 9.0, 9.0]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "point_id long, x double, y double, z double")
    got = {r["point_id"]: r["mean_distance"] for r in V.mean_neighbour_distance(df, "point_id", 20).collect()}
    for i, p in enumerate(cloud):
        want = np.sort(np.sqrt(((cloud - p) ** 2).sum(axis=1)))[:20].mean()
        assert got[i] == pytest.approx(want, abs=1e-9)
    kept = {r["point_id"] for r in V.outlier_removal(df, "point_id").collect()}
    assert 90 not in kept and not kept & set(range(60, 90))


def test_plane_search_and_fit(spark):
    rng = np.random.default_rng(4)
    flat = np.column_stack([rng.uniform(-1, 1, (300, 2)), rng.normal(0, 0.002, 300)])
    cloud = np.concatenate([flat, rng.uniform(-1, 1, (80, 3))]) + [100.0, 50.0, 7.0]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "point_id long, x double, y double, z double")
    plane = P.plane_search(df, "point_id", least=100)
    assert abs(plane["nz"]) > 0.999 and plane["inliers"] >= 300
    assert plane["cz"] == pytest.approx(7.0, abs=0.01)
    fit = P.plane_fit(df.filter("point_id < 300"), []).first()
    centred = cloud[:300] - cloud[:300].mean(axis=0)
    normal = np.linalg.svd(centred)[2][2]
    assert abs(normal @ np.array([fit["nx"], fit["ny"], fit["nz"]])) > 0.9999
    assert not P.plane_fit(df.filter("point_id < 2"), []).first()["fitted"]
    assert P.plane_search(df, "point_id", least=100_000) is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plane_of_a_small_share_is_found_on_every_seed(spark, seed):
    """A plane with 12 % of the rows needs thousands of triplets."""
    rng = np.random.default_rng(9)
    flat = np.column_stack([rng.uniform(-1, 1, (1200, 2)), np.full(1200, 0.2)])
    cloud = np.concatenate([flat, rng.uniform(-1, 1, (8800, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "point_id long, x double, y double, z double")
    plane = P.plane_search(df, "point_id", least=1000, seed=seed)
    assert abs(plane["nz"]) > 0.999 and plane["inliers"] >= 1200 and plane["trials"] > 128 and plane["p95"] <= 0.01


def test_trials_follow_the_share():
    assert P.trials_needed(0.9, 128, 10_000) == 128 and P.trials_needed(0.01, 128, 10_000) == 10_000
    assert P.trials_needed(0.12, 128, 10_000) == int(np.ceil(np.log(0.001) / np.log(1 - 0.12**3)))


def test_densest_bands(spark):
    rng = np.random.default_rng(5)
    heights = np.concatenate([rng.normal(0.5, 0.003, 200), rng.normal(0.1, 0.003, 120), rng.uniform(0, 1, 60)])
    df = spark.createDataFrame([(float(h), i % 4) for i, h in enumerate(heights)], "h double, frame int")
    found = P.densest_bands(df, "h", "frame", candidates=2)
    assert [round(b["offset"], 2) for b in found] == [0.5, 0.1]
    assert round(P.lowest_band(found, 100, 3)["offset"], 2) == 0.1


def test_hit_counts_on_edges(spark):
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 1, 10.0, 10.0), (0, 1, 10.5, 3.0), (0, 1, 10.0, 10.0)], "frame int, ref_id int, x double, y double")
    box = spark.createDataFrame([(0, 7, 0.0, 0.0, 10.0, 10.0), (0, 8, 50.0, 50.0, 60.0, 60.0)], "frame int, box_id int, x1 double, y1 double, x2 double, y2 double")
    for fits in (True, False):
        hits = P.hit_counts(pts, box, "frame", fits=fits)
        assert [(r["box_id"], r["hits"], r["total"]) for r in hits.collect()] == [(7, 3, 4)]
        all_ = {r["box_id"]: r["hits"] for r in P.with_zero_boxes(hits, box, "frame").collect()}
        assert all_ == {7: 3, 8: 0}


def test_union_area_sweeps_small_groups_without_slabs(spark):
    det = boxes(spark, seed=4)
    area = lambda fits: {r["image_id"]: r["area"] for r in P.union_area(det, "image_id", tile=70.0, fits=fits).collect()}
    assert area(True) == pytest.approx(area(False)) and area(None) == area(True)
    flat = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 5.0), (1, 0.0, -9.0, 4.0, -5.0), (1, 2.0, -7.0, 6.0, -3.0)], "image_id int, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in P.union_area(flat, "image_id").collect()] == [(1, 28.0)]
    plan = P.union_area(flat, "image_id", fits=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Aggregate") == 1


def test_sampled_hits_count_as_hit_counts_do_without_shuffling_points(spark):
    rng = np.random.default_rng(3)
    sides = lambda n: [(int(f), i, float(x), float(y), float(x + w), float(y + h)) for i, (f, x, y, w, h) in enumerate(rng.integers(0, 8, (n, 5)))]
    refs = spark.createDataFrame(sides(40) + [(0, 99, None, 1.0, 2.0, 2.0)], "frame int, ref_id int, x1 double, y1 double, x2 double, y2 double")
    box = spark.createDataFrame(sides(40), "frame int, box_id int, x1 double, y1 double, x2 double, y2 double")
    samples = [(F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), (F.col("x2"), F.col("y2"))]
    pts = refs.select("frame", "ref_id", F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in samples])).alias("p")).select("frame", "ref_id", "p.*")
    rows = lambda df: sorted(tuple(r) for r in df.select("frame", "ref_id", "box_id", "hits", "total", "ratio").collect())
    want = rows(P.hit_counts(pts, box, "frame", True))
    assert len(want) > 40
    for fits in (None, True, False):
        assert rows(P.sampled_hits(refs, box, "frame", samples, fits)) == want
    geometry = {"cx": F.col("x1"), "cy": F.col("y1"), "cz": F.col("x2")}
    refs, box = refs.withColumns(geometry), box.withColumns(geometry)
    score = lambda hits, r, t: sorted(tuple(x) for x in P.candidate_scores(hits, r, t, "frame", 0.3, 4.0, top=2).collect())
    places = score(P.hit_counts(pts, box, "frame", True), refs, box)
    assert len(places) > 10
    for fits in (True, False):
        assert score(P.sampled_hits(refs, box, "frame", samples, fits, ("cx", "cy", "cz")), None, None) == places
    plan = P.sampled_hits(refs, box, "frame", samples, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Join") == 1


def test_coplanar_score(spark):
    hits = spark.createDataFrame([(0, 1, 7, 4, 4, 1.0), (0, 1, 8, 2, 4, 0.5)], "frame int, ref_id int, box_id int, hits long, total long, ratio double")
    geo = lambda key, rows: spark.createDataFrame(rows, f"frame int, {key} int, cx double, cy double, cz double, nx double, ny double, nz double, rms double")
    refs = geo("ref_id", [(0, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    tgts = geo("box_id", [(0, 7, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0, 0.5), (0, 8, 9.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    out = P.candidate_scores(hits, refs, tgts, "frame", 0.3, 2.0, normals=True).collect()
    assert len(out) == 1 and out[0]["box_id"] == 7
    assert out[0]["score"] == pytest.approx(0.5 + 0.2 * 0.5 + 0.3 * 0.75)


def test_candidate_scores_score_every_box(spark):
    geo = "struct<cx:double,cy:double,cz:double>"
    rows = [(0, 1, b, 9 - b % 2, 9, 1.0 - b % 2 / 9, (0.0, 0.0, 0.0), (0.0, 0.0, b / 10)) for b in range(9)]
    hits = spark.createDataFrame(rows, f"frame int, ref_id int, box_id int, hits long, total long, ratio double, r {geo}, t {geo}")
    places = lambda **more: {r["box_id"]: r["place"] for r in P.candidate_scores(hits, None, None, "frame", 0.3, 2.0, **more).collect()}
    assert sorted(places()) == list(range(9)) and sorted(places().values()) == list(range(1, 10))
    assert sorted(places(top=2)) == [0, 2]


def test_guarded_filter(spark):
    from polyview.operators.cleaning import FilterOptions, guarded_filter

    rng = np.random.default_rng(6)
    block = rng.uniform(0, 0.3, (400, 3)) + [0, 0, 0.2]
    ground = np.column_stack([rng.uniform(-0.2, 0.5, (900, 2)), rng.normal(0, 0.001, 900)])
    cloud = np.concatenate([block, ground, [[40.0, 0, 0], [0, 50.0, 0], [9.0, 9.0, 9.0]]])
    rows = [(i, *map(float, p), i == len(cloud) - 1) for i, p in enumerate(cloud)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, protected boolean")
    options = FilterOptions(eps=0.15, plane_least=500, plane_reach=0.01, least_rows=100)
    kept, report = guarded_filter(df, options)
    ids = {r["point_id"] for r in kept.select("point_id").collect()}
    assert [r["status"] for r in report] == ["applied"] * 3
    assert len(ids & set(range(400))) > 360 and not ids & {1300, 1301} and 1302 in ids and len(ids & set(range(400, 1300))) < 20
    same, report = guarded_filter(df, FilterOptions(least_rows=5000))
    assert same.count() == len(cloud) and report[0]["status"] == "too_few"


def test_guarded_filter_meets_no_points_of_full_cells(spark, monkeypatch):
    from polyview.operators import linking
    from polyview.operators.cleaning import FilterOptions, guarded_filter

    seen = []
    real = linking._meeting
    monkeypatch.setattr(linking, "_meeting", lambda *given: seen.append(1) or real(*given))
    cloud = np.random.default_rng(3).uniform(0, 0.3, (4000, 3))
    rows = [(i, *map(float, p), False) for i, p in enumerate(cloud)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, protected boolean")
    kept, report = guarded_filter(df, FilterOptions(eps=0.1, plane_least=4000, least_rows=100))
    assert report[1] == {"stage": "clusters", "status": "applied", "rows": report[0]["rows"]} and kept.count() == report[0]["rows"] and not seen


@pytest.mark.parametrize("bad", [{"neighbours": 0}, {"sigmas": float("nan")}, {"eps": -1.0}, {"least_core": 0}, {"cluster_share": 2.0}, {"plane_reach": 0.0},
                                 {"plane_least": 0}, {"plane_share": -0.1}, {"plane_side": 0.6}, {"keep_share": 0.0}, {"least_rows": 0}])
def test_filter_options_are_checked(bad):
    from polyview.operators.cleaning import FilterOptions

    with pytest.raises(ValueError):
        FilterOptions(**bad)


def clustered_vectors(spark, count, spots, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(spots, 8)) * 20
    vecs = centres[np.arange(count) % spots] + rng.normal(size=(count, 8)) * 0.3
    return vecs, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")


@pytest.mark.parametrize("metric,self_", [("l2", True), ("dot", False)])
def test_pivot_tree_equals_brute_force(spark, monkeypatch, metric, self_):
    from polyview.plans import knn

    monkeypatch.setattr(knn, "PIVOT_ROWS", 8)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 12)
    vecs, df = clustered_vectors(spark, 240, 9)
    vecs[200:230] = vecs[200]  # copies share a place and split into blocks
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    cost = np.sqrt(((vecs[:, None] - vecs[None]) ** 2).sum(axis=2)) if metric == "l2" else -(vecs @ vecs.T)
    if self_:
        np.fill_diagonal(cost, np.inf)
    want = {(i, r + 1): j for i in range(240) for r, j in enumerate(np.lexsort((np.arange(240), np.round(cost[i], 9)))[:4])}
    got = {(r["target"], r["rank"]): r["source"] for r in knn.nearest(df, df, 4, metric, self_).collect()}
    same = {(i, r): round(float(cost[i, j]), 6) for (i, r), j in got.items()}
    assert same == {(i, r): round(float(cost[i, j]), 6) for (i, r), j in want.items()}
    assert knn.nearest(df, df.limit(0), 4, metric).count() == 0 and knn.nearest(df.limit(0), df, 4, metric).count() == 0


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_block_pairs_grow_slower_than_their_square(spark, monkeypatch, metric):
    from polyview.plans import knn

    monkeypatch.setattr(knn, "PIVOT_ROWS", 16)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 64)
    real, met = knn._met, []
    monkeypatch.setattr(knn, "_met", lambda t, s, pairs, *more: met.append(pairs.selectExpr("coalesce(sum(tb * sb), 0)").first()[0]) or real(t, s, pairs, *more))
    counts = []
    for count in (500, 2000):
        met.clear()
        _, df = clustered_vectors(spark, count, count // 50)
        queries = df.filter("id % 10 = 0") if metric == "dot" else df
        assert knn.nearest(queries, df, 3, metric).count() == 3 * queries.count()
        counts.append(sum(met))
    assert counts[1] < 8 * counts[0], counts


@pytest.mark.parametrize("tile", [25, 8192])
def test_nearest_rows_of_octree_tiles(spark, monkeypatch, tile):
    from polyview.plans import octree

    monkeypatch.setattr(octree, "TILE", tile)
    monkeypatch.setattr(octree, "LEAF", 4)
    rng = np.random.default_rng(8)
    cloud = np.concatenate([rng.normal(0, 0.1, (120, 3)), rng.normal(3, 1.0, (60, 3)), [[40.0, 0.0, 0.0]]])
    counts = rng.integers(1, 4, len(cloud))
    df = spark.createDataFrame([(i, *map(float, p), int(n)) for i, (p, n) in enumerate(zip(cloud, counts))], "loc long, x double, y double, z double, n long")
    got = {r["loc"]: r["mean_distance"] for r in octree.nearest_rows(df, 9).collect()}
    assert len(got) == len(cloud)
    for i, p in enumerate(cloud):
        gaps = np.repeat(np.sqrt(((cloud - p) ** 2).sum(axis=1)), counts)
        assert got[i] == pytest.approx(np.sort(gaps)[:9].mean(), abs=1e-9)


def test_occupied_pairs_are_all_near_cells(spark):
    from polyview.plans import octree

    rng = random.Random(4)
    cells = sorted({(rng.randint(-6, 6), rng.randint(-6, 6), rng.randint(-2, 2)) for _ in range(150)})
    df = spark.createDataFrame(cells, "cx long, cy long, cz long")
    for reach in (1, 2):
        got = [(tuple(r["a"]), tuple(r["b"])) for r in octree.occupied_pairs(df, reach).collect()]
        want = {(a, b) for a in cells for b in cells if max(abs(x - y) for x, y in zip(a, b)) <= reach}
        assert len(got) == len(want) and set(got) == want


def test_boxes_of_mixed_size_meet_on_levels(spark):
    """One box as wide as the table, crowds of small ones, points and touching edges, with null and empty groups."""
    from polyview.plans import spatial

    rng = random.Random(6)
    rows = [(0, 0.0, 0.0, 100_000.0, 100_000.0)]
    rows += [(i, x := rng.uniform(0, 1e5), y := rng.uniform(0, 1e5), x + rng.uniform(0, 400), y + rng.uniform(0, 30)) for i in range(1, 150)]
    rows += [(i, 10.0, 10.0, 10.0 + i % 3, 10.0) for i in range(200, 230)] + [(300, -5.0, -5.0, 0.0, 0.0), (301, 1e5, 1e5, 1e5, 1e5), (302, -4.0, 3.0, -1.0, 4.0)]
    df = spark.createDataFrame([("v", *r) for r in rows], "k string, id int, x1 double, y1 double, x2 double, y2 double")
    got = [(r["a"]["id"], r["b"]["id"]) for r in spatial.overlapping(df, df, ["k"], fits=False).collect()]
    touch = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    want = {(p[0], q[0]) for p in rows for q in rows if touch(p, q)}
    assert len(got) == len(want) and set(got) == want
    cells = spatial._in_cells(df.withColumn("__level", spatial._level(df)), "__level")
    assert cells.groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    assert spatial.overlapping(df.limit(0), df, ["k"], fits=False).count() == 0


def test_box_points_are_the_lowest_draws_of_each_box(spark):
    from hashlib import md5

    from polyview.operators import sampling

    sides = [(0.0, 0.0, 8.0, 4.0), (1.0, 2.0, 3.0, float("nan")), (None, 0.0, 1.0, 1.0)]
    rows = [(i, *sides[i % 3], n) for i, n in enumerate([1, 2, 5, 8, 8, 7, 0, None, 30])]
    df = spark.createDataFrame(rows, "i int, x1 double, y1 double, x2 double, y2 double, n int")
    want = []
    for i, x1, y1, x2, y2, n in rows:
        e = max(1, int(((n or 0) * 4) ** 0.5))
        cells = [(k, (k % e) / (e - 1) if e > 1 else 0.0, (k // e) / (e - 1) if e > 1 else 0.0) for k in range(e * e)]
        square = [(2 * u - 1) ** 2 + (2 * v - 1) ** 2 for _, u, v in cells]
        weight = [np.exp(-s / 0.32) if np.sqrt(s) <= 1.0 else 0.0 for s in square]
        if sum(w > 0 for w in weight) < (n or 0):
            weight = [1.0] * len(cells)
        chance = lambda k: (int(md5(f"{i}:{k}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12  # noqa: B023, E731
        drawn = sorted((-np.log(chance(c[0])) / w, *c) for c, w in zip(cells, weight, strict=True) if w > 0)[: n or 0]
        want += [(i, p + 1, None if x1 is None else x1 + (x2 - x1) * u, y1 + (y2 - y1) * v) for p, (_, _, u, v) in enumerate(drawn)]
    out = sampling.box_points(df, ["i"], ["x1", "y1", "x2", "y2"], "n", 0.4, 2.5)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert str(sorted(tuple(r) for r in out.collect())) == str(sorted((i, p, None if x is None else float(x), float(y)) for i, p, x, y in want))


def test_a_sampler_beyond_its_quota_fails(spark):
    from polyview.operators import sampling

    rows = spark.createDataFrame([(i, "a" if i else "b") for i in range(40)], "id long, k string")
    assert sampling.shared_sample(rows, "k", "id", 11).groupBy("k").count().orderBy("k").collect() == [("a", 10), ("b", 1)]
    with pytest.raises(Exception, match="more rows than its quota"):
        sampling.shared_sample(rows, "k", "id", 11, lambda r, key, ident: r).collect()


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_blocks_evaluate_few_pairs_exactly(metric):
    from polyview.plans import knn

    draw = np.random.default_rng(3)
    a, b = draw.normal(0, 1, (200, 64)), draw.normal(0, 1, (300, 64))
    b[7], b[9], a[5] = b[3], b[3], b[3]  # copies tie
    rows, flat = knn._candidates(a, b, np.arange(200), 1000 + np.arange(300), 3, metric, False)
    assert len(rows) < 200 * 3 + 50
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)) if metric == "l2" else -(a[:, None] * b[None]).sum(axis=2)
    found = set(zip(rows.tolist(), flat.tolist(), strict=True))
    for k in range(200):
        worst = np.sort(np.round(cost[k], 12))[2]
        assert {(k, int(j)) for j in np.flatnonzero(np.round(cost[k], 12) <= worst)} <= found
    rows, flat = knn._candidates(a, a, np.arange(200), np.arange(200), 200, metric, True)
    assert len(rows) == 200 * 199 and not (rows == flat).any()


@pytest.mark.parametrize(("metric", "kind"), [("l2", "float"), ("dot", "double")])
def test_blocks_meet_without_shuffling_a_vector_for_each_pair(spark, monkeypatch, metric, kind):
    from polyview.plans import knn

    monkeypatch.setattr(knn, "PIVOT_ROWS", 20)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    monkeypatch.setattr(knn, "CHUNK", 5)
    monkeypatch.setattr(knn, "PART_BYTES", 2_000)
    real, plans = knn._met, []

    def met(*args):
        plans.append(real(*args))
        return plans[-1]

    monkeypatch.setattr(knn, "_met", met)
    rng = np.random.default_rng(11)
    vecs = rng.normal(0, 1, (180, 8)).astype("f4").astype(float)
    vecs[60:80] = vecs[3]  # copies tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], f"id long, vec array<{kind}>")
    cost = np.sqrt(((vecs[:, None] - vecs[None]) ** 2).sum(axis=2)) if metric == "l2" else -(vecs @ vecs.T)
    np.fill_diagonal(cost, np.inf)
    want = {(i, r + 1): j for i in range(180) for r, j in enumerate(np.lexsort((np.arange(180), np.round(cost[i], 9)))[:4])}
    assert {(r["target"], r["rank"]): r["source"] for r in knn.nearest(df, df, 4, metric, True).collect()} == want
    assert len(plans) == 2
    for plan in (p._jdf.queryExecution().optimizedPlan().toString() for p in plans):
        assert "CoGroup" not in plan and "Generate" not in plan and "Expand" not in plan
    assert all("CartesianProduct" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


@pytest.mark.parametrize("limit", [20_000, 25])
def test_radius_pairs_in_blocks_and_parts(spark, monkeypatch, limit):
    """Each point travels about twice, not 27 times, and a crowded block is dealt into parts."""
    from polyview.plans import spatial

    monkeypatch.setattr(spatial, "BLOCK_POINTS", limit)
    draw = random.Random(4)
    rows = [(k, *[draw.choice([0.0, 0.1, -0.1, draw.uniform(-1, 1), draw.uniform(-0.1, 0.1)]) for _ in range(3)], f"c{k}") for k in range(300)]
    rows += [(7, 0.0, 0.0, 0.0, "again"), (900, float("nan"), 0.0, 0.0, "odd"), (901, None, 0.0, 0.0, "odd"), (902, float("inf"), 0.0, 0.0, "odd")]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, tag string")
    got = sorted((r["a_id"], r["b_id"], r["a_tag"], r["b_tag"], r["dist"]) for r in spatial.within_radius(df, 0.1, "id", ["tag"]).collect())
    want = []
    for p in rows[:301]:
        for q in rows[:301]:
            dist = ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5
            if p[0] < q[0] and dist <= 0.1:
                want.append((p[0], q[0], p[4], q[4], dist))
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)] and np.allclose([g[4] for g in got], [w[4] for w in sorted(want)])
    assert spatial.within_radius(df.limit(0), 0.1, "id").count() == 0
    assert "__d" not in spatial.within_radius(df, 0.1, "id")._jdf.queryExecution().toString()


def test_radius_pairs_meet_only_once_and_round_as_spark_does(spark):
    from polyview.plans import spatial

    rng = np.random.default_rng(12)
    a = np.concatenate([rng.normal(0, 0.1, (300, 3)), rng.integers(-2, 3, (100, 3)) * 0.05, [[0.0, 0.0, 0.1], [0.0, 0.0, 0.0]]])
    gaps = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
    listed = lambda found: sorted((int(i), int(j)) for one, two, _ in found for i, j in zip(one, two, strict=True))
    want = sorted((int(i), int(j)) for i, j in np.argwhere(gaps <= 0.1) if i < j)
    assert sorted((min(p), max(p)) for p in listed(spatial._near_pairs(a, None, 0.1))) == want
    assert listed(spatial._near_pairs(a[:150], a[150:], 0.1)) == sorted((i, j - 150) for i, j in want if i < 150 <= j)
    values = [0.0, 0.0000005, 0.0000015, 0.0123455, 0.0123445, 1.0000005, 2.5, 1 / 3, 123456.7890125, 5e15, *rng.uniform(0, 0.03, 500).round(7).tolist()]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    assert [r[0] for r in frame.orderBy("id").select(F.round("v", 6)).collect()] == spatial._rounded(np.array(values), 6).tolist()
