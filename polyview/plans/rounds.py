"""Round-based graph operators: each round is a few joins and aggregations.

State is cut after every round (see ``session.cut``), which also reports how many
rows are left, so a loop costs no extra action.  All choices follow a total priority,
so the outcome equals the sequential scan in priority order.  Every round settles the first open edge at
least, so loops end without a limit on rounds; and it settles whole chains of edges that wait for one another
(see ``chains``), so a path takes few rounds in whatever order its edges stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from polyview.plans import chains
from polyview.session import cut, cut_counted, fresh_folder


FEW = 50_000  # edges that may be broadcast


def sorted_side(df: DataFrame, many: bool = True) -> DataFrame:
    """``df`` as a side of a sort-merge join, where there are ``many`` rows on both sides.

    Spark takes the size of a written table for that of its rows in memory.  Tables of few, well packed columns are many times larger
    there, and a plan that broadcasts several of them at once fills the driver.
    """
    return df.hint("merge") if many else df


def _added(rows: DataFrame, folder: str) -> DataFrame:
    """Append ``rows`` to the table that collects every round's rows, and read back what was added."""
    now = cut(rows)
    now.write.mode("append").parquet(folder)
    return now


def _collected(shape: DataFrame, folder: str) -> DataFrame:
    """All rows that the rounds added; none, if there were no rounds."""
    shape.limit(0).write.mode("append").parquet(folder)
    return shape.sparkSession.read.schema(shape.schema).parquet(folder)


def _dominant(edges: DataFrame) -> DataFrame:
    """Edges ``(p, a, b, ...)`` that are the first of both their ends.

    Every end keeps only its first edge (combined map-side, whatever its degree); an
    edge that two ends keep is dominant.
    """
    row = F.struct(*edges.columns)
    firsts = edges.select(F.explode(F.array("a", "b")).alias("__end"), row.alias("r"))
    kept = firsts.groupBy("__end").agg(F.min_by("r", F.col("r.p")).alias("r"))
    both = kept.groupBy("r").agg(F.count(F.lit(1)).alias("__ends")).filter("__ends = 2")
    return both.select("r.*")


def greedy_match(edges: DataFrame) -> DataFrame:
    """One-to-one matching by priority: lowest ``p`` first, an edge needs both ends free.

    ``edges(p, a, b, ...)`` with a unique orderable ``p``; the ends' value spaces must
    not overlap.
    """
    left, count = cut_counted(edges)
    folder = fresh_folder(edges.sparkSession)
    while count:
        now = _added(left.join(chains.taken(left), "p", "left_semi").select(edges.columns), folder)
        used = now.select(F.explode(F.array("a", "b")).alias("__used"))
        free = left.join(used, F.col("a") == F.col("__used"), "left_anti")
        free = free.join(used, F.col("b") == F.col("__used"), "left_anti")
        left, count = cut_counted(free)
    return _collected(edges, folder)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components as ``(node, component)``: the component is its lowest node.

    Alternating star contractions: every node links its larger neighbours to its
    smallest one, then its smaller ones; the number of rounds grows with the logarithm
    of the component size and not with its diameter.
    """
    links = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    last = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        links = cut(
            stars.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("h"))
        )
        state = (seen.get["n"], seen.get["h"])
        if state == last or state[0] == 0:
            break
        last = state
    return nodes.join(links, F.col("node") == F.col("u"), "left").select(
        *nodes.columns, F.coalesce("v", "node").alias("component")
    )


def suppress(edges: DataFrame) -> DataFrame:
    """Nodes lost to a kept better node, from conflict edges ``(better, worse)``.

    A node without an undecided better neighbour is kept; its worse neighbours are
    lost, together with all their edges.  A node with one undecided better neighbour is lost if that is kept and
    kept if that is lost, so chains of them are settled from their ends.
    """
    left, count = cut_counted(edges.select("better", "worse").distinct())
    nodes = left.select(F.col("worse").alias("node"))
    folder = fresh_folder(edges.sparkSession)
    while count:
        worse = left.select(F.col("worse").alias("node")).distinct()
        heads = left.join(worse, F.col("better") == F.col("node"), "left_anti")
        tops = cut(heads.select(F.col("better").alias("top")).distinct())
        single = left.groupBy(F.col("worse").alias("e")).agg(F.count(F.lit(1)).alias("n"), F.min("better").alias("pred")).filter("n = 1")
        odd = chains.way_back(single.select("e", "pred")).filter("steps % 2 = 1").join(tops, F.col("root") == F.col("top"), "left_semi")
        lost = heads.select(F.col("worse").alias("node")).unionByName(odd.select(F.col("e").alias("node"))).distinct()
        now = _added(lost, folder)
        rest = left.join(now, F.col("worse") == F.col("node"), "left_anti")
        rest = rest.join(now, F.col("better") == F.col("node"), "left_anti")
        left, count = cut_counted(rest)
    return _collected(nodes, folder)


def constrained_clusters(nodes: DataFrame, edges: DataFrame, gate=None) -> DataFrame:
    """Clusters grown by edges in priority order, never with two nodes of one part.

    ``nodes(node, part, ...)``, ``edges(p, a, b)`` with unique ``p``.  Per round: edges that are first at both
    ends, with the chains behind them, merge their clusters or vanish; end points are rewritten; of edges
    between the same two clusters the first stays; edges whose clusters now share a part
    are dropped early, which is safe because clusters only grow.  ``gate(pairs)`` gets
    ``(p, x, y)`` of all node pairs across a candidate merge, as structs of ``nodes``,
    and returns the column that must hold for every pair; with a gate a round takes first edges only.
    """
    members = cut(nodes.withColumn("cluster", F.col("node")))
    row = F.struct(*nodes.columns)

    def clash(candidates: DataFrame, members: DataFrame, many: bool) -> DataFrame:
        """Candidates (p) whose two clusters hold the same part."""
        parts = members.select("cluster", "part")
        left = candidates.join(sorted_side(parts.withColumnRenamed("cluster", "a"), many), "a").select("p", "b", "part")
        right = sorted_side(parts.withColumnRenamed("cluster", "b"), many)
        return left.join(right, ["b", "part"]).select("p").distinct()

    def passed(tried: DataFrame, many: bool) -> DataFrame:
        side = lambda c, n: members.select(F.col("cluster").alias(c), row.alias(n))
        pairs = tried.join(sorted_side(side("a", "x"), many), "a").join(sorted_side(side("b", "y")), "b")
        bad = pairs.filter(~F.coalesce(gate(pairs), F.lit(False))).select("p").distinct()
        good = _without(tried, bad, many)
        return good.select(F.greatest("a", "b").alias("__old"), F.least("a", "b").alias("__new"))

    def once(edges: DataFrame) -> DataFrame:
        pairs = edges.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return pairs.agg(F.min("p").alias("p")).select("p", "a", "b")

    first = cut(once(edges.select("p", "a", "b")))
    left, count = cut_counted(_without(first, clash(first, members, True)))
    while count:
        many = count > FEW
        tried = cut(_dominant(left)) if gate is not None else chains.settled(left)
        moved = passed(tried, many) if gate is not None else chains.merged(tried, members).select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        moved = cut(moved)
        members = cut(
            members.join(sorted_side(moved, many), F.col("cluster") == F.col("__old"), "left")
            .withColumn("cluster", F.coalesce("__new", "cluster")).drop("__old", "__new")
        )
        rest = _without(left, tried.select("p"), many)
        for end in ("a", "b"):
            rest = rest.join(sorted_side(moved, many), F.col(end) == F.col("__old"), "left").withColumn(
                end, F.coalesce("__new", end)
            ).drop("__old", "__new")
        rest = cut(once(rest))
        grown = moved.select(F.col("__new").alias("__g")).distinct()
        touched = rest.join(sorted_side(grown, many), F.col("a") == F.col("__g"), "left_semi").union(
            rest.join(sorted_side(grown, many), F.col("b") == F.col("__g"), "left_semi")
        ).distinct()
        left, count = cut_counted(_without(rest, clash(touched, members, many), many))
    return members


def _without(edges: DataFrame, ids: DataFrame, many: bool = True) -> DataFrame:
    return edges.join(sorted_side(ids, many), "p", "left_anti")


def window_suppress(pairs: DataFrame, width: int) -> DataFrame:
    """Keep index pairs by priority; a kept pair blocks indices around both its ends.

    ``pairs(p, i, j)`` with i < j.  Instead of listing conflicts, every index learns the
    best undecided pair that covers it; a pair that is the best at both its own ends is
    kept.  Indices blocked by kept pairs then remove the pairs that touch them.
    """
    i, j = F.col("i"), F.col("j")
    around = F.array_union(
        F.sequence(F.greatest(F.lit(0), i - width), F.least(i + width, j - 1)),
        F.sequence(F.greatest(i + 1, j - width), j + width),
    )
    left, count = cut_counted(pairs.select("p", "i", "j"))
    folder = fresh_folder(pairs.sparkSession)
    while count:
        covered = left.select("p", F.explode(around).alias("x"))
        best = cut(covered.groupBy("x").agg(F.min("p").alias("__best")))
        at = lambda end: best.select(F.col("x").alias(end), F.col("__best").alias(f"__b{end}"))
        now = _added(
            left.join(at("i"), "i").join(at("j"), "j").filter((F.col("p") == F.col("__bi")) & (F.col("p") == F.col("__bj")))
            .select("p", "i", "j"), folder,
        )
        blocked = now.select(F.explode(around).alias("__x")).distinct()
        rest = left.join(blocked, F.col("i") == F.col("__x"), "left_anti").join(blocked, F.col("j") == F.col("__x"), "left_anti")
        left, count = cut_counted(rest)
    return _collected(pairs.select("p", "i", "j"), folder)
