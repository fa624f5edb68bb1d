"""Queries for matching, clustering, suppression and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.boxes import IOU
from polyview.catalog.registry import GREEDY, query
from polyview.functions import boxes as B
from polyview.operators import linking as L
from polyview.plans import folds
from polyview.session import cut


@query("greedy_match", f"""WITH {X.MATCH}, ls AS (SELECT ref_img, tgt_img, list({{'g':ref_id,'k':tgt_id,'s':hit_ratio}} ORDER BY hit_ratio DESC, ref_id, tgt_id) AS es FROM edges GROUP BY 1,2),
mt AS (SELECT ref_img, tgt_img, unnest({GREEDY}) AS m FROM ls) SELECT ref_img, tgt_img, m.g AS ref_id, m.k AS tgt_id, m.s AS hit_ratio FROM mt""")
def greedy_match(spark, d):
    e = X.matches(spark, d)
    out = L.match_one_to_one(
        e, F.struct("ref_img", "tgt_img", "ref_id"), F.struct("ref_img", "tgt_img", "tgt_id"), "hit_ratio", "edge_seq",
        ["ref_img", "tgt_img"],
    )
    return out.select("ref_img", "tgt_img", "ref_id", "tgt_id", "hit_ratio")


# The sequential scan per video: clusters are lists of nodes {i, o}; an edge merges two
# clusters unless they are one already or share an image.
CLUSTERS = """list_reduce(list_prepend(list_filter([[es[1].a]], lambda c: false), list_transform(es, lambda e: [[e.a, e.b]])), lambda acc, o:
 list_transform([{'x': list_concat(list_filter(acc, lambda c: list_contains(c, o[1][1])), [[o[1][1]]])[1], 'y': list_concat(list_filter(acc, lambda c: list_contains(c, o[1][2])), [[o[1][2]]])[1]}],
 lambda p: CASE WHEN list_has_any(list_transform(p.x, lambda n: n.i), list_transform(p.y, lambda n: n.i)) THEN acc
  ELSE list_append(list_filter(acc, lambda c: NOT list_contains(c, o[1][1]) AND NOT list_contains(c, o[1][2])), list_concat(p.x, p.y)) END)[1])"""


def _linked(least):
    return f"""{X.MATCH}, ls AS (SELECT video, list({{'a':{{'i':ref_idx,'o':ref_id}},'b':{{'i':ref_idx+1,'o':tgt_id}}}} ORDER BY hit_ratio DESC, ref_idx, ref_id, tgt_id) AS es FROM edges WHERE hit_ratio>={least} GROUP BY 1),
cl AS (SELECT video, unnest({CLUSTERS}) AS c FROM ls), nd AS (SELECT video, list_min(c) AS head, unnest(c) AS n FROM cl),
al AS (SELECT p.video, p.idx, p.image_id, p.object_id, coalesce(head,{{'i':p.idx,'o':p.object_id}}) AS head FROM placed p LEFT JOIN nd ON nd.video=p.video AND n.i=p.idx AND n.o=p.object_id),
gi AS (SELECT *, dense_rank() OVER (PARTITION BY video ORDER BY head) AS global_id, head<>{{'i':idx,'o':object_id}} AS removed FROM al)"""


def _global(spark, d, least: float = 0.0):
    lines = cut(X.placed(spark, d).drop("l_partkey"))  # nodes and both ends of the edges read it
    node = lambda i, o: F.struct("video", i.alias("idx"), F.col(o).alias("object_id"))
    nodes = lines.select(node(F.col("idx"), "object_id").alias("node"), F.col("idx").alias("part"), "video", "image_id")
    e = X.matches(spark, d, lines)
    if least > 0:
        e = e.filter(F.col("hit_ratio") >= least)
    edges = e.select(
        node(F.col("ref_idx"), "ref_id").alias("a"), node(F.col("ref_idx") + 1, "tgt_id").alias("b"), "video", "hit_ratio",
        F.struct("ref_idx", "ref_id", "tgt_id").alias("edge_seq"),
    )
    return L.global_ids(nodes, edges, "hit_ratio", "edge_seq", "video").withColumn("object_id", F.col("node.object_id"))


@query("global_ids", f"WITH {_linked(0)} SELECT video, image_id, object_id, global_id, removed FROM gi")
def global_ids(spark, d):
    return _global(spark, d).select("video", "image_id", "object_id", "global_id", "removed")


@query("dedup_sequence", f"WITH {_linked(0.4)} SELECT video, image_id, count(*) AS detections, count(*) FILTER (NOT removed) AS kept, count(DISTINCT global_id) AS ids FROM gi GROUP BY 1,2")
def dedup_sequence(spark, d):
    mapping = _global(spark, d, 0.4)
    return L.survivors(mapping, ["video", "image_id"])


@query("components", f"""WITH RECURSIVE {X.MATCH}, n AS (SELECT video, idx, object_id FROM placed), e2 AS (SELECT video, ref_idx AS i, ref_id AS o, ref_idx+1 AS i2, tgt_id AS o2 FROM edges WHERE hit_ratio>=0.8
 UNION ALL SELECT video, ref_idx+1, tgt_id, ref_idx, ref_id FROM edges WHERE hit_ratio>=0.8),
r AS (SELECT video, idx AS i, object_id AS o, idx AS ri, object_id AS ro FROM n UNION SELECT r.video, e2.i2, e2.o2, r.ri, r.ro FROM r JOIN e2 ON r.video=e2.video AND r.i=e2.i AND r.o=e2.o),
m AS (SELECT video, i, o, min((ri,ro)) AS root FROM r GROUP BY 1,2,3)
SELECT video, i AS idx, o AS object_id, root[1] AS root_idx, root[2] AS root_object FROM m""")
def components(spark, d):
    lines = cut(X.placed(spark, d).drop("l_partkey"))  # nodes and both ends of the edges read it
    node = lambda i, o: F.struct("video", i.alias("idx"), o.alias("object_id"))
    nodes = lines.select(node(F.col("idx"), F.col("object_id")).alias("node"), "video")
    e = X.matches(spark, d, lines).filter("hit_ratio >= 0.8")
    edges = e.select(node(F.col("ref_idx"), F.col("ref_id")).alias("a"), node(F.col("ref_idx") + 1, F.col("tgt_id")).alias("b"), "video")
    out = folds.connected(nodes, cut(edges), "video")
    return out.select(
        "node.video", "node.idx", "node.object_id", F.col("component.idx").alias("root_idx"), F.col("component.object_id").alias("root_object")
    )


INTER = "greatest(least(q.x2,o[1].x2)-greatest(q.x1,o[1].x1),0)*greatest(least(q.y2,o[1].y2)-greatest(q.y1,o[1].y1),0)"


@query("nms_frame", f"""WITH {X.DET}, ls AS (SELECT image_id, list({{'x1':x1,'y1':y1,'x2':x2,'y2':y2,'i':object_id,'s':score}} ORDER BY score DESC, object_id) AS es FROM det GROUP BY 1),
k AS (SELECT image_id, unnest(list_reduce(list_prepend(list_filter([es[1]], lambda q: false), list_transform(es, lambda q: [q])), lambda acc, o:
 CASE WHEN len(list_filter(acc, lambda q: {INTER}/((q.x2-q.x1)*(q.y2-q.y1)+(o[1].x2-o[1].x1)*(o[1].y2-o[1].y1)-{INTER})>=0.3))>0 THEN acc ELSE list_concat(acc,o) END)) AS m FROM ls)
SELECT image_id, m.i AS object_id, m.s AS score FROM k""")
def nms_frame(spark, d):
    det = X.detections(spark, d)
    return L.box_nms(det, ["image_id"], "object_id", "score", 0.3).select("image_id", "object_id", "score")


@query("nms_track", f"""WITH {X.DET}, {X.FRAMES}, r AS (SELECT video, idx AS frame, object_id AS track, x1,y1,x2,y2, det.score FROM det JOIN frames ON det.image_id=frames.image_id),
sc AS (SELECT video, track, round(avg(score),6) AS score FROM r GROUP BY 1,2),
pr AS (SELECT a.video, a.track AS x, b.track AS y, sum(greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)) AS it,
 sum((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)) AS ar FROM r a JOIN r b ON a.video=b.video AND a.frame=b.frame AND a.track<>b.track GROUP BY 1,2,3),
cf AS (SELECT video, list({{'x':x,'y':y}}) AS cs FROM pr WHERE it>0 AND it/(ar-it)>=0.1 GROUP BY 1), ls AS (SELECT video, list({{'i':track,'s':score}} ORDER BY score DESC, track) AS es FROM sc GROUP BY 1),
k AS (SELECT ls.video, unnest(list_reduce(list_prepend(list_filter([es[1]], lambda q: false), list_transform(es, lambda q: [q])), lambda acc, o:
 CASE WHEN len(list_filter(coalesce(cs,[]), lambda c: c.x=o[1].i AND list_contains(list_transform(acc, lambda q: q.i), c.y)))>0 THEN acc ELSE list_concat(acc,o) END)) AS m FROM ls LEFT JOIN cf ON ls.video=cf.video)
SELECT video, m.i AS track, m.s AS score FROM k""")
def nms_track(spark, d):
    det = X.detections(spark, d).join(X.frames(spark, d).select("video", "idx", "image_id"), "image_id")
    rows = det.select("video", F.col("idx").alias("frame"), F.col("object_id").alias("track"), *B.SIDES, "score")
    scores = rows.groupBy("video", "track").agg(F.round(F.avg("score"), 6).alias("score"))
    return L.track_nms(rows, "video", "track", "frame", scores, 0.1)


@query("det_track_assoc", f"""WITH {X.DET}, {X.FRAMES}, r AS (SELECT video, idx, det.* FROM det JOIN frames ON det.image_id=frames.image_id),
pr AS (SELECT a.video, a.idx, a.object_id AS gg, b.object_id AS kk, round({IOU},9) AS iou FROM r a JOIN r b ON a.video=b.video AND a.idx=b.idx+1),
ls AS (SELECT video, idx, list({{'g':gg,'k':kk,'s':iou}} ORDER BY iou DESC, gg, kk) AS es FROM pr WHERE iou>0 GROUP BY 1,2), mt AS (SELECT video, idx, unnest({GREEDY}) AS m FROM ls)
SELECT 'matched' AS kind, video, idx, m.g AS det_id, m.k AS trk_id FROM mt
UNION ALL SELECT 'lost', video, CAST(idx+1 AS INTEGER), NULL, object_id FROM r WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.video=r.video AND mt.idx=r.idx+1 AND m.k=r.object_id AND m.s>=0.2)
UNION ALL SELECT 'new', video, idx, object_id, NULL FROM r WHERE score>=0.5 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.video=r.video AND pr.idx=r.idx AND pr.gg=r.object_id AND iou>=0.1)""")
def det_track_assoc(spark, d):
    det = X.detections(spark, d).join(X.frames(spark, d).select("video", "idx", "image_id"), "image_id")
    det = cut(det.select("video", "idx", "object_id", "score", *B.SIDES))  # pairs, lone tracks and new detections read it, twice and once each
    now = det.select("video", "idx", F.col("object_id").alias("det_id"), "score", *B.SIDES)
    trk = det.select("video", (F.col("idx") + 1).alias("idx"), F.col("object_id").alias("trk_id"), *B.SIDES)
    matched, lone, fresh, _ = L.associate(now, trk, ["video", "idx"], 0.1, 0.2, 0.5, X.images_pair(spark, d))
    keys = ["video", "idx"]
    null = F.lit(None).cast("int")
    return (
        matched.select(F.lit("matched").alias("kind"), *keys, "det_id", "trk_id")
        .union(lone.select(F.lit("lost").alias("kind"), *keys, null.alias("det_id"), "trk_id"))
        .union(fresh.select(F.lit("new").alias("kind"), *keys, "det_id", null.alias("trk_id")))
    )


@query("dbscan")
def dbscan(spark, d):
    pts = X.points(spark, d).select("point_id", "x", "y", "z")
    return L.dbscan(pts, "point_id", 0.045, 5).select("point_id", "cluster")


@query("complete_link")
def complete_link(spark, d):
    pts = X.points(spark, d).select(F.col("point_id").alias("node"), F.col("frame").alias("part"), "x", "y", "z")

    def gate(pairs):
        gap = sum(((F.col(f"x.{c}") - F.col(f"y.{c}")) * (F.col(f"x.{c}") - F.col(f"y.{c}")) for c in "xyz"), F.lit(0.0))
        return F.sqrt(gap) <= 0.06

    out = L.complete_link(pts, 0.06, gate)
    return out.select(F.col("node").alias("point_id"), F.col("part").alias("frame"), "cluster")


LABELLED = "l AS (SELECT event_id, CASE WHEN user_id%11=0 THEN -1 WHEN user_id%101=7 THEN 9 ELSE user_id%3 END AS cluster FROM events)"


def _labelled(spark, d):
    user = F.col("user_id")
    cluster = F.when(user % 11 == 0, -1).when(user % 101 == 7, 9).otherwise(user % 3)
    return X.table(spark, d, "events").select("event_id", cluster.alias("cluster"))


@query("main_cluster", f"""WITH {LABELLED}, s AS (SELECT cluster, count(*) AS n FROM l WHERE cluster>=0 GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS r, sum(n) OVER () AS t FROM s)
SELECT max(cluster) FILTER (r=1) AS cluster, max(n) FILTER (r=1) AS size, coalesce(max(n) FILTER (r=2),0) AS second,
 coalesce(max(n) FILTER (r=2),0)>0 AND coalesce(max(n) FILTER (r=2),0)>=least(32, ceil(max(t)*0.2)) AS ambiguous FROM r""")
def main_cluster(spark, d):
    return L.main_cluster(_labelled(spark, d))


@query("scene_clusters", f"""WITH {LABELLED}, s AS (SELECT cluster, count(*) AS n, sum(count(*)) OVER () AS t FROM l GROUP BY 1)
SELECT event_id, l.cluster FROM l JOIN s ON l.cluster=s.cluster WHERE l.cluster>=0 AND n>=0.01*t""")
def scene_clusters(spark, d):
    return L.scene_clusters(_labelled(spark, d), 0.01).select("event_id", "cluster")


@query("small_component_share", """WITH s AS (SELECT cluster, count(*) AS n FROM (SELECT user_id AS cluster FROM events) GROUP BY 1)
SELECT count(*) AS components, max(n) AS largest, round(coalesce(sum(n) FILTER (n<100),0)/sum(n),9) AS small_share FROM s""")
def small_component_share(spark, d):
    parts = X.table(spark, d, "events").select(F.col("user_id").alias("component"))
    return L.small_component_share(parts, 100).withColumn("small_share", F.round("small_share", 9))
