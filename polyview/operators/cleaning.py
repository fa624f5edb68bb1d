"""Guarded chain of point filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.operators.linking import dbscan, scene_clusters
from polyview.operators.points import _distance, plane_search
from polyview.operators.vectors import outlier_removal
from polyview.session import cut_counted


@dataclass(frozen=True)
class FilterOptions:
    """Thresholds of the chain, checked on creation."""

    neighbours: int = 20
    sigmas: float = 2.0
    eps: float = 0.05
    least_core: int = 10
    cluster_share: float = 0.01
    plane_reach: float = 0.012
    plane_least: int = 10_000
    plane_share: float = 0.10
    plane_side: float = 0.15
    keep_share: float = 0.20
    least_rows: int = 1_000

    def __post_init__(self):
        counts = (self.neighbours, self.least_core, self.plane_least, self.least_rows)
        shares = (self.keep_share, self.cluster_share, self.plane_share)
        lengths = (self.sigmas, self.eps, self.plane_reach)
        good = all(isinstance(c, int) and c >= 1 for c in counts) and all(0 <= s <= 1 for s in shares) and self.keep_share > 0
        good &= all(math.isfinite(x) and x > 0 for x in lengths) and 0 <= self.plane_side <= 0.5
        if not good:
            raise ValueError("filter options out of range")


def guarded_filter(points: DataFrame, options: FilterOptions = FilterOptions()) -> tuple[DataFrame, list[dict]]:
    """Outliers, small clusters and a one-sided plane removed in turn, each stage guarded.

    ``points(point_id, x, y, z, protected)``.  Protected rows bypass every stage.  A stage
    that would keep less than ``keep_share`` of its rows is skipped, and below
    ``least_rows`` nothing is filtered.  Each stage ends in one cut whose row count
    decides; only counts reach the driver.
    """
    o = options
    free, before = cut_counted(points.filter(~F.col("protected")))
    held = points.filter("protected")
    report: list[dict] = []
    if before < o.least_rows:
        return points, [{"stage": "all", "status": "too_few", "rows": before}]

    def stage(name, rows, count, out):
        kept, left = cut_counted(out.select(*rows.columns))
        ok = left >= o.keep_share * count
        report.append({"stage": name, "status": "applied" if ok else "skipped", "rows": left if ok else count})
        return (kept, left) if ok else (rows, count)

    rows, count = stage("outliers", free, before, outlier_removal(free, "point_id", o.neighbours, o.sigmas))
    grouped = dbscan(rows.select("point_id", "x", "y", "z"), "point_id", o.eps, o.least_core)
    members = scene_clusters(grouped, o.cluster_share).select("point_id")
    rows, count = stage("clusters", rows, count, rows.join(members, "point_id", "left_semi"))
    plane = plane_search(
        rows, "point_id", reach=o.plane_reach, trim=o.plane_reach, least=o.plane_least, least_share=o.plane_share
    )
    if plane is None:
        report.append({"stage": "plane", "status": "none", "rows": count})
    else:
        off = sum(plane[f"n{k}"] * plane[f"c{k}"] for k in "xyz")
        signed = F.col("x") * plane["nx"] + F.col("y") * plane["ny"] + F.col("z") * plane["nz"] - F.lit(off)
        sides = rows.filter(_distance(plane) > o.plane_reach).agg(
            F.count_if(signed > 0).alias("up"), F.count(F.lit(1)).alias("rest")
        ).first()
        minor = min(sides["up"], sides["rest"] - sides["up"])
        if sides["rest"] == 0 or minor > o.plane_side * sides["rest"]:
            report.append({"stage": "plane", "status": "rejected", "rows": count})
        else:
            rows, count = stage("plane", rows, count, rows.filter(_distance(plane) > o.plane_reach))
    return rows.union(held.select(*rows.columns)), report
