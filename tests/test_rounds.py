"""Round operators against sequential twins on seeded random graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyview.operators import linking as L
from polyview.plans import rounds


def edges_of(seed, nodes, count, ties=6):
    rnd = random.Random(seed)
    seen = {}
    while len(seen) < count:
        a, b = rnd.randrange(nodes), rnd.randrange(nodes)
        if a != b:
            seen.setdefault((min(a, b), max(a, b)), rnd.randrange(ties))
    return [(r, i, a, b) for i, ((a, b), r) in enumerate(seen.items())]


def frame(spark, edges):
    return spark.createDataFrame(edges, "r int, i int, a long, b long").select(F.struct("r", "i").alias("p"), "a", "b")


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_match(spark, seed):
    edges = edges_of(seed, 40, 90)
    used, want = set(), set()
    for _, i, a, b in sorted(edges):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = {(r["a"], r["b"]) for r in rounds.greedy_match(frame(spark, edges)).collect()}
    assert got == want


def sequential_clusters(nodes, part, edges, gate=None):
    home = {n: {n} for n in nodes}
    for _, _, a, b in sorted(edges):
        x, y = home[a], home[b]
        if x is y or {part[n] for n in x} & {part[n] for n in y}:
            continue
        if gate and not all(gate(m, n) for m in x for n in y):
            continue
        x |= y
        for n in y:
            home[n] = x
    return {n: min(home[n]) for n in nodes}


@pytest.mark.parametrize("seed,gated", [(3, False), (4, False), (5, True)])
def test_constrained_clusters(spark, seed, gated):
    rnd = random.Random(seed)
    edges = edges_of(seed, 36, 80)
    part = {n: rnd.randrange(9) for n in range(36)}
    table = spark.createDataFrame([(n, part[n]) for n in part], "node long, part int")
    gate = (lambda pairs: F.abs(F.col("x.node") - F.col("y.node")) <= 20) if gated else None
    want = sequential_clusters(list(part), part, edges, (lambda m, n: abs(m - n) <= 20) if gated else None)
    got = {r["node"]: r["cluster"] for r in rounds.constrained_clusters(table, frame(spark, edges), gate).collect()}
    assert got == want


def test_conflicting_ring_and_no_edges(spark):
    nodes = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "node long, part int")
    ring = [(0, 0, 0, 1), (1, 1, 1, 2), (2, 2, 0, 2)]
    got = {r["node"]: r["cluster"] for r in rounds.constrained_clusters(nodes, frame(spark, ring)).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    alone = rounds.constrained_clusters(nodes, frame(spark, ring).limit(0))
    assert {r["node"]: r["cluster"] for r in alone.collect()} == {0: 0, 1: 1, 2: 2}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(40)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(100, 141), 999]], "node long")
    got = {r["node"]: r["component"] for r in rounds.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 141)}, 999: 999}


def test_suppress(spark):
    edges = [(a, b) for _, _, a, b in edges_of(6, 40, 80)]
    lost = set()
    for n in range(40):
        if n not in lost:
            lost |= {b for a, b in edges if a == n}
    df = spark.createDataFrame(edges, "better long, worse long")
    assert {r["node"] for r in rounds.suppress(df).collect()} == lost


def test_window_suppress(spark):
    rnd = random.Random(8)
    pairs = sorted({(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(70)) if a < b})
    ranked = [(rnd.randrange(5), i, j) for i, j in pairs]
    blocked, want, w = set(), set(), 4
    for _, i, j in sorted(ranked):
        if i in blocked or j in blocked:
            continue
        want.add((i, j))
        blocked |= set(range(max(0, i - w), min(i + w + 1, j))) | set(range(max(i + 1, j - w), j + w + 1))
    df = spark.createDataFrame(ranked, "r int, i long, j long").select(F.struct("r", "i", "j").alias("p"), "i", "j")
    assert {(r["i"], r["j"]) for r in rounds.window_suppress(df, w).collect()} == want


def brute_dbscan(points, eps, least):
    ids = sorted(points)
    near = {i: [j for j in ids if np.sqrt(((points[i] - points[j]) ** 2).sum()) <= eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= least}
    label, count = {}, 0
    for i in ids:
        if i not in core or i in label:
            continue
        stack = [i]
        label[i] = count
        while stack:
            for j in near[stack.pop()]:
                if j not in label:
                    label[j] = count
                    if j in core:
                        stack.append(j)
        count += 1
    return {i: label.get(i, -1) for i in ids}


def test_dbscan_with_copies(spark):
    rng = np.random.default_rng(9)
    cloud = np.concatenate([rng.normal(c, 0.05, (25, 3)) for c in (0.0, 0.3, 0.6)] + [rng.uniform(-0.5, 1, (15, 3))])
    cloud = np.concatenate([cloud, np.repeat(cloud[:1], 30, axis=0), np.repeat([[3.0, 3.0, 3.0]], 6, axis=0)])
    points = {i: p for i, p in enumerate(cloud)}
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()], "point_id long, x double, y double, z double")
    got = {r["point_id"]: r["cluster"] for r in L.dbscan(df, "point_id", 0.08, 5).collect()}
    assert got == brute_dbscan(points, 0.08, 5)
    main = L.main_cluster(L.dbscan(df, "point_id", 0.08, 5)).first()
    sizes = sorted(((list(got.values()).count(c), -c) for c in set(got.values()) - {-1}), reverse=True)
    assert (main["size"], -main["cluster"]) == sizes[0]


def test_dbscan_meets_points_only_between_components(spark, monkeypatch):
    """Full cells are joined by their boxes and outermost points; what these don't settle is still exact."""
    seen = []
    real = L._meeting
    monkeypatch.setattr(L, "_meeting", lambda pairs, core, eps: seen.append(pairs.count()) or real(pairs, core, eps))
    rng = np.random.default_rng(31)
    table = lambda cloud: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "point_id long, x double, y double, z double")
    full = L.dbscan(table(rng.uniform(0, 0.3, (6000, 3))), "point_id", 0.1, 5)
    assert [tuple(r) for r in full.groupBy("cluster").count().collect()] == [(0, 6000)] and not seen
    for seed in range(2):
        cloud = np.random.default_rng(seed).uniform(0, 1, (400, 3))
        got = {r["point_id"]: r["cluster"] for r in L.dbscan(table(cloud), "point_id", 0.12, 4).collect()}
        assert got == brute_dbscan(dict(enumerate(cloud)), 0.12, 4)
    rods = [(x, y, z) for x, s in ((0.0, 1), (0.055, -1)) for y, z in [(0.0, 0.0), (0.05, 0.01), (0.02, 0.05), (0.03, 0.03), (0.045, 0.045)] for x in (x + s * (0.001 if (y, z) == (0.03, 0.03) else 0) + s * y * z,)]
    got = {r["point_id"]: r["cluster"] for r in L.dbscan(table(np.array(rods)), "point_id", 0.054, 2).collect()}
    assert got == brute_dbscan(dict(enumerate(np.array(rods))), 0.054, 2)
    assert seen


def test_complete_link(spark):
    rng = np.random.default_rng(10)
    rows = [(i, i % 4, *map(float, rng.uniform(0, 0.3, 3))) for i in range(60)]
    at = {r[0]: np.array(r[2:]) for r in rows}
    part = {r[0]: r[1] for r in rows}
    dist = lambda m, n: float(np.sqrt(((at[m] - at[n]) ** 2).sum()))
    nearest = {}
    for i in at:
        for f in range(4):
            near = [(dist(i, j), j) for j in at if part[j] == f and f != part[i] and dist(i, j) <= 0.1]
            if near:
                nearest[i, f] = min(near)[1]
    edges = [(dist(i, j), i, i, j) for (i, f), j in nearest.items() if i < j and nearest.get((j, part[i])) == i]
    edges = [(d, (i, j), i, j) for d, i, _, j in edges]
    want = sequential_clusters(list(at), part, edges, lambda m, n: dist(m, n) <= 0.08)
    df = spark.createDataFrame(rows, "node long, part int, x double, y double, z double")

    def gate(pairs):
        return F.sqrt(sum(((F.col(f"x.{c}") - F.col(f"y.{c}")) ** 2 for c in "xyz"), F.lit(0.0))) <= 0.08

    got = {r["node"]: r["cluster"] for r in L.complete_link(df, 0.1, gate).collect()}
    assert got == want


def test_complete_link_broadcasts_no_table_of_points(spark, monkeypatch):
    """Written tables are far larger in memory; several of them broadcast at once fill the driver."""
    monkeypatch.setattr(rounds, "FEW", 0)
    plans = []

    def watched(real):
        def cut(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df)

        return cut

    for module in (rounds, L):
        for name in ("cut", "cut_counted"):
            monkeypatch.setattr(module, name, watched(getattr(module, name)))
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, *map(float, rng.uniform(0, 0.3, 3))) for i in range(90)]
    df = spark.createDataFrame(rows, "node long, part int, x double, y double, z double")
    gate = lambda pairs: F.sqrt(sum(((F.col(f"x.{c}") - F.col(f"y.{c}")) ** 2 for c in "xyz"), F.lit(0.0))) <= 0.1
    assert L.complete_link(df, 0.1, gate).count() == 90
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_unknown_endpoint_is_an_error(spark):
    nodes = spark.createDataFrame([(0, 0, 1)], "node long, part int, video int")
    edges = spark.createDataFrame([(0, 7, 0.5, 1)], "a long, b long, hit_ratio double, seq int")
    with pytest.raises(Exception, match="unknown detection"):
        L.global_ids(nodes, edges, "hit_ratio", "seq", "video").collect()


def test_global_ids(spark):
    nodes, edges, want = [], [], {}
    for video, count in ((1, 20), (2, 60)):
        rnd = random.Random(video)
        part = {100 * video + n: rnd.randrange(8) for n in range(30)}
        nodes += [(n, p, video) for n, p in part.items()]
        mine = [(r, i, 100 * video + a, 100 * video + b) for r, i, a, b in edges_of(video, 30, count)]
        edges += [(a, b, -float(r), i) for r, i, a, b in mine]
        home = sequential_clusters(list(part), part, mine)
        order = {c: k + 1 for k, c in enumerate(sorted(set(home.values())))}
        want |= {n: (order[c], n != c) for n, c in home.items()}
    table = spark.createDataFrame(nodes, "node long, part int, video int")
    links = spark.createDataFrame(edges, "a long, b long, hit_ratio double, seq int")
    got = L.global_ids(table, links, "hit_ratio", "seq", "video").collect()
    assert {r["node"]: (r["global_id"], r["removed"]) for r in got} == want


@pytest.mark.parametrize("limit", [None, 12])
def test_global_ids_scans_packs_of_sequences(spark, monkeypatch, limit):
    """Edges that carry their sequence: nodes as structs, nulls in them, alone and in several packs, as the sequential scan has it."""
    from polyview.plans import folds, scan

    monkeypatch.setattr(folds, "PACK", 40)
    nodes, edges, want = [], [], {}
    for video in [*range(6), 2**40]:
        rnd = random.Random(video)
        part = {n: rnd.randrange(5) for n in range(3 + video % 5 * 6)}
        mine = edges_of(video, len(part), min(3, video % 5 * 9))
        name = lambda n, v=video: (v, None if n == 0 else n % 4, f"é{n:03}")
        nodes += [(name(n), f"p{p}", video) for n, p in part.items()]
        edges += [(name(a), name(b), video, -float(r), i) for r, i, a, b in mine]
        sort = sorted(part, key=lambda n: (n != 0, n % 4, n))
        home = {n: sort[k] for n, k in sequential_clusters(range(len(part)), [part[n] for n in sort], sorted((r, i, sort.index(a), sort.index(b)) for r, i, a, b in mine)).items()}
        home = {sort[n]: k for n, k in home.items()}
        order = {c: k + 1 for k, c in enumerate(n for n in sort if home[n] == n)}
        want |= {name(n): (order[c], n != c) for n, c in home.items()}
    kind = "struct<v: long, k: int, t: string>"
    table = spark.createDataFrame(nodes, f"node {kind}, part string, video long")
    links = spark.createDataFrame(edges, f"a {kind}, b {kind}, video long, hit_ratio double, seq int")
    if limit:
        spark.conf.set(scan.LIMIT_SETTING, str(limit))
    try:
        got = L.global_ids(table, links, "hit_ratio", "seq", "video").collect()
    finally:
        spark.conf.unset(scan.LIMIT_SETTING)
    assert len(got) == len(want) and {tuple(r["node"]): (r["global_id"], r["removed"]) for r in got} == want
    wrong = spark.createDataFrame([(nodes[0][0], nodes[-1][0], 0, 1.0, 1)], links.schema)
    with pytest.raises(Exception, match="unknown detection"):
        L.global_ids(table, wrong, "hit_ratio", "seq", "video").collect()


def test_matches_pair_runs_of_slots(spark):
    """Lines of long frames meet in runs: every pair of slots at most one apart once, about one copy a line."""
    from polyview import fixtures

    rows = [(7, idx, 10 + idx, slot - 1, float(slot % 5), 3, slot) for idx, count in ((0, 37), (1, 29), (3, 20)) for slot in range(1, count + 1)]
    lines = spark.createDataFrame(rows, "video long, idx int, image_id long, object_id int, l_quantity double, digit long, slot long")
    found = fixtures.matches(spark, "", lines)
    got = sorted((r["ref_idx"], r["ref_id"], r["tgt_id"]) for r in found.collect())
    assert got == sorted((0, a, b) for a in range(37) for b in range(29) if abs(a - b) <= 1)


@pytest.mark.parametrize("limit", [None, 30])
def test_components_of_packs(spark, monkeypatch, limit):
    from polyview.plans import folds, scan

    monkeypatch.setattr(folds, "PACK", 50)
    nodes, edges, want = [], [], {}
    for g in range(8):
        mine = edges_of(g, 20, g * 3) + [(0, 0, 20 + k, 21 + k) for k in range(g)]
        nodes += [(100 * g + n, g) for n in range(30)]
        edges += [(100 * g + b, 100 * g + a, g) for _, _, a, b in mine]
        low = list(range(30))
        for _ in low:
            for _, _, a, b in mine:
                low[a] = low[b] = min(low[a], low[b])
        want |= {100 * g + n: 100 * g + c for n, c in enumerate(low)}
    if limit:
        spark.conf.set(scan.LIMIT_SETTING, str(limit))
    try:
        found = folds.connected(spark.createDataFrame(nodes, "node long, g int"), spark.createDataFrame(edges, "a long, b long, g int"), "g")
        assert {r["node"]: r["component"] for r in found.collect()} == want
    finally:
        spark.conf.unset(scan.LIMIT_SETTING)


def test_long_tied_paths_finish(spark):
    """2000 frames tied in input order: matching takes every other edge, clusters grow over the whole path."""
    from polyview.plans import folds

    path = [(0, k, k, k + 1) for k in range(2000)]
    edges = frame(spark, path)
    got = {(r["a"], r["b"]) for r in folds.matched(edges, [F.lit(0)]).collect()}
    assert got == {(k, k + 1) for k in range(0, 2000, 2)}
    nodes = spark.createDataFrame([(k, k, "v") for k in range(2001)], "node long, part int, video string")
    links = spark.createDataFrame([(1.0, k, k, k + 1) for k in range(2000)], "hit_ratio double, seq long, a long, b long")
    ids = L.global_ids(nodes, links, "hit_ratio", "seq", "video")
    assert ids.select("global_id").distinct().collect() == [(1,)] and ids.filter("removed").count() == 2000


@pytest.mark.parametrize("seed", [7, 8])
def test_folds_equal_rounds(spark, seed):
    from polyview.plans import folds

    edges = frame(spark, edges_of(seed, 40, 90))
    key = lambda df: sorted((r["a"], r["b"]) for r in df.collect())
    assert key(folds.matched(edges, [F.lit(0)])) == key(rounds.greedy_match(edges))
    conflicts = edges.select(F.least("a", "b").alias("better"), F.greatest("a", "b").alias("worse"))
    lost = lambda df: sorted(r["node"] for r in df.select("node").collect())
    assert lost(folds.suppressed(conflicts, [F.lit(0)], ["better"])) == lost(rounds.suppress(conflicts))
    assert key(folds.matched(edges.limit(0), [F.lit(0)])) == key(rounds.greedy_match(edges.limit(0))) == []


@pytest.mark.parametrize("limit", [0, 12])
def test_no_scan_holds_more_than_the_limit(spark, monkeypatch, limit):
    """One sequence of many small components and a large one: every scan stays within the limit, results stay sequential."""
    from polyview.plans import folds, scan

    rnd = random.Random(12)
    raw = [(r, i, a, b) for i, (r, _, a, b) in enumerate(edges_of(11, 40, 90) + [(rnd.randrange(6), 0, a + s, b + s) for s in range(100, 400, 10) for _, _, a, b in edges_of(s, 6, 7)])]
    part = {n: rnd.randrange(9) for n in {x for e in raw for x in e[2:]}}
    real, most = folds._dealt, [0]

    def spy(*given):
        out = real(*given)
        most[0] = max([most[0], *(r["count"] for r in out.groupBy("__g").count().collect())])
        return out

    monkeypatch.setattr(folds, "_dealt", spy)
    spark.conf.set(scan.LIMIT_SETTING, str(limit))
    try:
        edges = frame(spark, raw)
        used, want = set(), set()
        for _, _, a, b in sorted(raw):
            if a not in used and b not in used:
                used |= {a, b}
                want.add((a, b))
        assert {(r["a"], r["b"]) for r in folds.matched(edges, [F.lit(0)]).collect()} == want
        gone = set()
        for n in sorted(part):
            if n not in gone:
                gone |= {max(a, b) for _, _, a, b in raw if min(a, b) == n}
        conflicts = edges.select(F.least("a", "b").alias("better"), F.greatest("a", "b").alias("worse"))
        assert sorted(r["node"] for r in folds.suppressed(conflicts, [F.lit(0)], ["better"]).collect()) == sorted(gone)
        nodes = spark.createDataFrame([(n, p, "v") for n, p in part.items()], "node long, part int, video string")
        links = spark.createDataFrame([(a, b, -float(r), i) for r, i, a, b in raw], "a long, b long, hit_ratio double, seq int")
        home = sequential_clusters(list(part), part, raw)
        order = {c: k + 1 for k, c in enumerate(sorted(set(home.values())))}
        got = L.global_ids(nodes, links, "hit_ratio", "seq", "video").collect()
        assert {r["node"]: (r["global_id"], r["removed"]) for r in got} == {n: (order[c], n != c) for n, c in home.items()}
    finally:
        spark.conf.unset(scan.LIMIT_SETTING)
    assert most[0] <= limit


@pytest.mark.parametrize("sizes,ambiguous", [([100, 21], False), ([100, 25], True), ([100], False), ([300, 32], True)])
def test_main_cluster_compares_with_all_clustered_rows(spark, sizes, ambiguous):
    rows = [(c,) for c, n in enumerate(sizes) for _ in range(n)] + [(-1,)] * 50
    got = L.main_cluster(spark.createDataFrame(rows, "cluster int")).first()
    assert (got["cluster"], got["size"], got["ambiguous"]) == (0, sizes[0], ambiguous)


def chain_cases():
    """Tied and mixed paths whose parts repeat in several ways, side by side: (edges, part of each node)."""
    rnd = random.Random(21)
    n = 24
    up = [(0, k, k, k + 1) for k in range(n)]
    down = [(0, n - k, k, k + 1) for k in range(n)]
    valley = [(abs(k - 5), k, k, k + 1) for k in range(11)]
    hills = [(k % 7 if k // 7 % 2 else 7 - k % 7, k, k, k + 1) for k in range(n)]
    ring = [*up, (0, n, n, 0)]
    tree = [(0, k, k // 2, k) for k in range(1, n)]
    comb = [*up, *[(rnd.randrange(2), 200 + k, k, 1000 + k) for k in range(0, n, 3)]]
    twice = [(0, k, a, b) for k, (_, _, a, b) in enumerate([e for e in up for _ in (0, 1)])]
    edges, part = [], {}
    for case, own in enumerate([c for c in (up, down, valley, hills, ring, tree, comb, twice) for _ in range(3)]):
        base = 10_000 * case
        edges += [(r, base + i, base + a, base + b) for r, i, a, b in own]
        for x in sorted({x for e in own for x in e[2:]}):
            part[base + x] = base + (x, x % 3, rnd.randrange(12))[case % 3]
    return edges, part


def test_chains_equal_the_sequential_scan(spark, monkeypatch):
    edges, part = chain_cases()
    calls = []
    real = rounds.chains.settled
    monkeypatch.setattr(rounds.chains, "settled", lambda left: calls.append(1) or real(left))
    nodes = spark.createDataFrame(sorted(part.items()), "node long, part int")
    got = {r["node"]: r["cluster"] for r in rounds.constrained_clusters(nodes, frame(spark, edges)).collect()}
    assert got == sequential_clusters(list(part), part, edges)
    assert len(calls) <= 25


def test_chains_of_matches_and_suppressions(spark, monkeypatch):
    edges, part = chain_cases()
    calls = []
    real = rounds.chains.way_back
    monkeypatch.setattr(rounds.chains, "way_back", lambda links: calls.append(1) or real(links))
    used, want = set(), set()
    for _, _, a, b in sorted(edges):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r["a"], r["b"]) for r in rounds.greedy_match(frame(spark, edges)).collect()} == want
    gone = set()
    for n in sorted(part):
        if n not in gone:
            gone |= {max(a, b) for _, _, a, b in edges if min(a, b) == n}
    conflicts = frame(spark, edges).select(F.least("a", "b").alias("better"), F.greatest("a", "b").alias("worse"))
    assert {r["node"] for r in rounds.suppress(conflicts).collect()} == gone
    assert len(calls) <= 24


def test_long_tied_paths_take_few_rounds(spark, monkeypatch):
    """2000 edges tied in input order, no scan allowed: under 30 rounds, each of a logarithmic number of joins."""
    from polyview.plans import folds, scan

    calls = []
    for name in ("settled", "taken"):
        real = getattr(rounds.chains, name)
        monkeypatch.setattr(rounds.chains, name, lambda left, real=real: calls.append(1) or real(left))
    spark.conf.set(scan.LIMIT_SETTING, "0")
    try:
        edges = frame(spark, [(0, k, k, k + 1) for k in range(2000)])
        got = {(r["a"], r["b"]) for r in folds.matched(edges, [F.lit(0)]).collect()}
        assert got == {(k, k + 1) for k in range(0, 2000, 2)}
        nodes = spark.createDataFrame([(k, k % 50, "v") for k in range(2001)], "node long, part int, video string")
        links = spark.createDataFrame([(1.0, k, k, k + 1) for k in range(2000)], "hit_ratio double, seq long, a long, b long")
        ids = {r["node"]: r["global_id"] for r in L.global_ids(nodes, links, "hit_ratio", "seq", "video").collect()}
    finally:
        spark.conf.unset(scan.LIMIT_SETTING)
    assert ids == {k: k // 50 + 1 for k in range(2001)}
    assert len(calls) < 30


def test_reciprocal_pairs_in_crowds_equal_brute_force(spark):
    """Points on a coarse grid tie and repeat; a few lie far out; two crowds of copies, which never meet one by one."""
    rng = np.random.default_rng(3)
    spots = [*rng.integers(0, 6, (150, 3)) / 50, *rng.uniform(0, 1, (60, 3)), *np.repeat([[0.01, 0.01, 0.01]], 30, axis=0)]
    rows = [(i, i % 4, *map(float, s)) for i, s in enumerate(spots)]
    best = {}
    for i, p, *u in rows:
        for j, q, *v in rows:
            a, b, c = ((x - y) * (x - y) for x, y in zip(u, v))
            d = float(np.sqrt(a + b + c))
            if p != q and d <= 0.1:
                best[i, q] = min(best.get((i, q), (9.0, -1)), (d, j))
    want = {(i, j, d) for (i, q), (d, j) in best.items() if i < j and best[j, rows[i][1]][1] == i}
    crowd = [(10000 + k, k % 2, 5.0 + k % 2 / 50, 5.0, 5.0) for k in range(60000)]
    odd = [(9000, 0, None, 0.0, 0.0), (9001, None, 0.0, 0.0, 0.0), (9002, 1, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd + crowd, "node long, part int, x double, y double, z double")
    got = {(r["x"], r["y"], r["dist"]) for r in L.reciprocal_pairs(df, 0.1).collect()}
    assert got == want | {(10000, 10001, abs(5.0 - 5.02))}
    assert L.reciprocal_pairs(df.limit(0), 0.1).collect() == []
