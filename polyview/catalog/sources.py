"""Queries over source formats, rendered from the tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.registry import query
from polyview.operators import cleaning
from polyview.operators.labels import image_documents
from polyview.sources import detections as SD
from polyview.sources import logs, tables

PART_ROWS = 4096


@query("detections_flatten", f"WITH {X.DET} SELECT image_id, object_id, x1, y1, x2, y2, score FROM det")
def detections_flatten(spark, d):
    det = X.detections(spark, d).select(
        "image_id", "object_id", F.array("x1", "y1", "x2", "y2").alias("position"), F.struct(F.col("score").alias("det")).alias("confidences")
    )
    docs = image_documents(det, "image_id", ["object_id"], PART_ROWS)
    body = F.regexp_extract("document", r'(?s)^\{"objects":(.*)\}$', 1)
    entry = F.concat(F.lit('{"classes":["box"],"objects":'), body, F.lit("}"))
    shape = F.col("image_id") % 3
    text = (
        F.when(shape == 0, F.concat(F.lit('{"skus":['), entry, F.lit(',{"classes":[],"objects":[]}]}')))
        .when(shape == 1, F.concat(F.lit("["), entry, F.lit(',{"classes":[],"objects":[{"position":[0,0,1,1]}]}]')))
        .otherwise(entry)
    )
    out = SD.flatten(docs.select("image_id", "part", text.alias("text")), first_id=F.col("part") * PART_ROWS)
    return out.select("image_id", "object_id", "x1", "y1", "x2", "y2", "score")


@query("match_log_attribution", f"WITH {X.MATCH} SELECT video, ref_idx, ref_idx+1 AS tgt_idx, ref_id, tgt_id, hit_ratio, matched, total FROM edges")
def match_log_attribution(spark, d):
    e = X.matches(spark, d).withColumn("tgt_idx", F.col("ref_idx") + 1)
    row = F.format_string("Matched ref %d → target %d (hit ratio: %.2f %d/%d)", "ref_id", "tgt_id", "hit_ratio", "matched", "total")
    file = F.concat_ws("/", "video", "ref_idx")
    seq = lambda step, *ids: F.struct(F.col("tgt_idx").alias("t"), F.lit(step).alias("s"), *[c.alias(n) for c, n in zip(ids, "ab")])
    zero = F.lit(0)
    root = F.col("video").cast("string").alias("root")
    match = e.select(root, file.alias("file"), seq(0, F.col("ref_id"), F.col("tgt_id")).alias("seq"), row.alias("text"))
    per = e.groupBy("video", "ref_idx", "tgt_idx").agg(F.count(F.lit(1)).alias("n"))
    group = per.select(
        root, file.alias("file"), seq(1, zero, zero).alias("seq"),
        F.format_string("Matching objects between reference image %d and target image %d", "ref_idx", "tgt_idx").alias("text"),
    )
    found = per.select(root, file.alias("file"), seq(2, zero, zero).alias("seq"), F.format_string("Found %d matches in image %d", "n", "tgt_idx").alias("text"))
    out = logs.attribute_matches(match.union(group).union(found))
    return out.select(F.col("root").cast("long").alias("video"), "ref_idx", "tgt_idx", "ref_id", "tgt_id", "hit_ratio", "matched", "total")


REPORT = f"""{X.MATCH}, r AS (SELECT video, ref_idx, count(*) AS a, sum(matched)%100 AS b, sum(total)%100 AS c FROM edges GROUP BY 1,2)"""


@query("report_triples", f"""WITH {REPORT} SELECT concat(video,'/',ref_idx) AS file, CAST(k AS INTEGER) AS pos, a+k+0.25::DOUBLE AS recall, b+0.5::DOUBLE AS effectiveness, c+0.0::DOUBLE AS "precision"
FROM r, (VALUES (0),(1)) v(k) WHERE ref_idx%4<>3 AND k<=ref_idx%2""")
def report_triples(spark, d):
    per = X.matches(spark, d).groupBy("video", "ref_idx").agg(
        F.count(F.lit(1)).alias("a"), (F.sum("matched") % 100).alias("b"), (F.sum("total") % 100).alias("c")
    )
    block = lambda k: F.concat(
        F.lit("Totals\n  (Recall): "), (F.col("a") + k).cast("string"), F.lit(".25% (1/2)\n  (Effectiveness): "), F.col("b").cast("string"),
        F.lit(".5% (1/2)\n  (Precision): "), F.col("c").cast("string"), F.lit("% (1/2)\n"),
    )
    text = F.when(F.col("ref_idx") % 4 == 3, F.lit("nothing measured\n")).when(F.col("ref_idx") % 2 == 1, F.concat(block(0), block(1))).otherwise(block(0))
    return logs.report_triples(per.select(F.concat_ws("/", "video", "ref_idx").alias("file"), text.alias("text")))


@query("odometry_check", """WITH r AS (SELECT CASE WHEN event_id>=50 THEN event_id+event_id//400 ELSE event_id END AS frame, epoch_us(ts)/1e6-CASE WHEN user_id%25=0 THEN 3000 ELSE 0 END AS t FROM events),
s AS (SELECT frame, t, lag(frame) OVER w AS pf, lag(t) OVER w AS pt FROM r WINDOW w AS (ORDER BY frame, t))
SELECT frame, CASE WHEN frame<>coalesce(pf+1,0) THEN 'frame' WHEN t<=pt THEN 'timestamp' END AS error FROM s WHERE frame<>coalesce(pf+1,0) OR t<=pt""")
def odometry_check(spark, d):
    i = F.col("event_id")
    rows = X.table(spark, d, "events").select(
        F.when(i >= 50, i + F.floor(i / 400)).otherwise(i).alias("frame"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.when(F.col("user_id") % 25 == 0, 3000).otherwise(0)).alias("timestamp"),
    )
    return tables.odometry_errors(rows)


@query("guarded_filter")
def guarded_filter(spark, d):
    pts = X.points(spark, d).select("point_id", "x", "y", "z", (F.col("point_id") % 50 == 0).alias("protected"))
    options = cleaning.FilterOptions(eps=0.06, least_core=4, plane_reach=0.02, plane_least=100, plane_share=0.02, plane_side=0.5)
    out, _ = cleaning.guarded_filter(pts, options)
    return out.select("point_id", "protected")
