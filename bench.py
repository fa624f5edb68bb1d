"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and
cores.  Each query is run once to completion into the noop sink; one warm-up query
starts the session first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from polyview import catalog  # noqa: E402
from polyview.session import build, clean  # noqa: E402

HEADLINE = [
    "dedup_sequence", "global_ids", "greedy_match", "pair_metrics", "classification_vote", "dim_facets", "global_skus_json",
    "iou_pairs", "overlap_stats", "nms_frame", "hit_counts", "candidate_scoring", "union_area", "merge_intervals",
    "interval_lookup", "label_ranges", "equal_quota", "systematic_sample", "weighted_quantile", "voxel_best", "radius_pairs",
    "dbscan", "outlier_removal", "plane_search", "knn_join", "hota", "gated_f1", "match_log_attribution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build(f"local[{cpus}]", partitions=cpus)
    catalog.QUERIES["topk_per_group"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else None,
    }))
    clean(spark)
    spark.stop()


if __name__ == "__main__":
    main()
