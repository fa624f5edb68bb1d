"""Whole chains of dependent edges decided at once, by pointer jumping.

Where an edge waits for exactly one earlier edge, it points back to it.  Following such pointers leads to an edge that waits for
none or for several.  Doubling the pointers finds that end, and the steps to it, in as many joins as the logarithm
of the longest chain; what every edge of the chain does then follows from its place, and no round settles just one edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from polyview.plans.scan import along, last_seen, leading, running_min
from polyview.session import cut


def way_back(links: DataFrame) -> DataFrame:
    """``(e, root, steps)`` for ``links(e, pred)``, one row an ``e`` and without cycles: the first item behind ``e`` that has no link."""
    state = links.select("e", F.col("pred").alias("root"), F.lit(1).cast("long").alias("steps"))
    while True:
        ahead = state.select(F.col("e").alias("__e"), F.col("root").alias("__root"), F.col("steps").alias("__steps"))
        seen = Observation()
        jumped = state.join(ahead, F.col("root") == F.col("__e"), "left")
        jumped = jumped.observe(seen, F.count("__e").alias("moved"))
        state = cut(jumped.select("e", F.coalesce("__root", "root").alias("root"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps")))
        if not seen.get["moved"]:
            return state


def ends(edges: DataFrame, depth: int) -> DataFrame:
    """``(end, first)``: each end's ``depth`` first edges by ``p``, in order; more than that never leave a task for one end."""
    both = edges.select("p", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy("p"))
    kept = both.withColumn("__r", rank).filter(F.col("__r") <= depth)
    return kept.groupBy("end").agg(F.array_sort(F.collect_list("p")).alias("first"))


def waiting(edges: DataFrame) -> DataFrame:
    """``(p, pred)`` of edges that wait for no earlier edge at their ends (null ``pred``) or for exactly one."""
    at = ends(edges, 2).select(F.posexplode("first").alias("r", "p"), F.col("first")[0].alias("head"))
    kept = at.groupBy("p").agg(F.count(F.lit(1)).alias("n"), *[f(F.when(F.col("r") == 1, F.col("head"))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))])
    return kept.filter("n = 2 AND (low IS NULL OR low = high)").select("p", F.col("low").alias("pred"))


def taken(edges: DataFrame) -> DataFrame:
    """``(p)`` of edges that a matching takes: those that are first at both ends, and every second one along chains behind them."""
    state = cut(waiting(edges))
    heads = state.filter("pred IS NULL").select("p")
    links = state.filter("pred IS NOT NULL").select(F.col("p").alias("e"), "pred")
    back = way_back(links).filter("steps % 2 = 0").join(heads, F.col("root") == F.col("p"), "left_semi")
    return heads.unionByName(back.select(F.col("e").alias("p")))


def settled(edges: DataFrame) -> DataFrame:
    """``(p, chain, place, near, far)``: edges whose merges follow from the parts of their chain's clusters alone.

    A chain starts with an edge that is first at both ends.  The next edge is first at its far end, and second, behind the edge
    before it, at its near end.  It holds up to the first edge that is later than one leaving the clusters behind it.
    """
    firsts = cut(ends(edges, 3))
    at = firsts.select("end", F.posexplode("first").alias("r", "p"), "first")
    sides = at.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("r", "end", "first"))).alias("s")).filter("size(s) = 2")
    low, high = F.col("s")[0], F.col("s")[1]
    placed = cut(
        sides.filter((low["r"] == 0) & (high["r"] <= 1)).select(
            "p", F.when(high["r"] == 1, high["first"][0]).alias("pred"), low["end"].alias("far"), high["end"].alias("near"),
            F.get(high["first"], F.lit(2)).alias("cap"), F.get(low["first"], F.lit(1)).alias("far_next"), F.get(high["first"], F.lit(1)).alias("near_next"),
        )
    )
    links = placed.filter("pred IS NOT NULL")
    # of two chains behind one head the earlier goes on; what leaves the head's other end caps it
    child = links.groupBy(F.col("pred").alias("__p")).agg(F.min("p").alias("child"))
    heads = placed.filter("pred IS NULL").join(child, F.col("p") == F.col("__p"), "left")
    through_near = F.col("near_next").eqNullSafe(F.col("child"))
    heads = heads.select(
        "p", F.lit(None).cast(edges.schema["p"].dataType).alias("pred"), F.when(through_near, F.col("near")).otherwise(F.col("far")).alias("far"),
        F.when(through_near, F.col("far")).otherwise(F.col("near")).alias("near"), F.when(through_near, F.col("far_next")).otherwise(F.col("near_next")).alias("cap"),
    )
    heads = cut(heads)
    single = links.join(child, (F.col("pred") == F.col("__p")) & (F.col("p") == F.col("child")), "left_semi")
    back = way_back(single.select(F.col("p").alias("e"), "pred")).join(heads.select(F.col("p").alias("__h")), F.col("root") == F.col("__h"), "left_semi")
    behind = single.join(back, F.col("p") == F.col("e")).select("p", F.col("root").alias("chain"), F.col("steps").alias("place"), "near", "far", "cap")
    every = heads.select("p", F.col("p").alias("chain"), F.lit(0).cast("long").alias("place"), "near", "far", "cap").unionByName(behind)
    capped = along(every, ["chain"], [F.col("place")], {"least": running_min(F.col("cap"))}, fits=False)
    return cut(capped.filter("place = 0 OR least IS NULL OR p < least").select("p", "chain", "place", "near", "far"))


def merged(chains: DataFrame, members: DataFrame) -> DataFrame:
    """``(old, new)`` clusters after the merges along ``settled`` chains, where two clusters of one part never meet.

    ``members(cluster, part)``.  From a start the chain grows up to the first cluster that shares a part with one behind it; there the
    next stretch starts.  Where each start would end is a running minimum; which starts are real is found by doubling.
    """
    first = chains.filter("place = 0").select("chain", F.lit(0).cast("long").alias("i"), F.col("near").alias("cluster"))
    stops = cut(first.unionByName(chains.select("chain", (F.col("place") + 1).alias("i"), F.col("far").alias("cluster"))))
    parts = stops.join(members.select("cluster", "part"), "cluster").select("chain", "i", "part")
    again = along(parts, ["chain", "part"], [F.col("i")], {"again": leading(F.col("i"))}, fits=False)
    again = again.filter("again IS NOT NULL").groupBy("chain", "i").agg(F.min("again").alias("again"))
    to_end = along(stops.join(again, ["chain", "i"], "left"), ["chain"], [F.desc("i")], {"next": running_min(F.col("again"))}, fits=False)
    jump = cut(to_end.filter("next IS NOT NULL").select("chain", "i", "next"))
    real = first.select("chain", "i")
    while not jump.isEmpty():
        real = cut(real.unionByName(real.join(jump, ["chain", "i"]).select("chain", F.col("next").alias("i"))))
        ahead = jump.select("chain", F.col("i").alias("next"), F.col("next").alias("__next"))
        jump = cut(jump.join(ahead, ["chain", "next"]).select("chain", "i", F.col("__next").alias("next")))
    marked = stops.join(real.distinct().withColumn("start", F.col("i")), ["chain", "i"], "left")
    stretch = cut(along(marked, ["chain"], [F.col("i")], {"begin": last_seen(F.col("start"))}, fits=False).select("chain", "begin", "cluster"))
    names = stretch.groupBy("chain", "begin").agg(F.min("cluster").alias("new"))
    return stretch.join(names, ["chain", "begin"]).filter("cluster <> new").select(F.col("cluster").alias("old"), "new")
