"""Queries over detection boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.registry import query, r6
from polyview.functions import boxes as B
from polyview.functions import sizes as S
from polyview.operators import detections as D
from polyview.operators import sampling as A

IOU = """CASE WHEN (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)
 - greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) <= 0 THEN 0
 ELSE greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)
 / ((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)
 - greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)) END"""

PAIRS = f"""pairs AS (SELECT a.image_id, a.object_id AS a_id, b.object_id AS b_id, {IOU} AS iou
 FROM det a JOIN det b ON a.image_id=b.image_id AND a.object_id<b.object_id)"""


@query("box_features", f"""WITH {X.DET}, f AS (SELECT image_id, object_id, score,
 greatest(0,(x2-x1)*(y2-y1)) AS area, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM det)
SELECT image_id, object_id, score, area, cx, cy, area_rank FROM (SELECT *,
 CAST(row_number() OVER (PARTITION BY image_id ORDER BY area DESC, object_id) AS INTEGER) AS area_rank
 FROM f WHERE score>=0.2 AND area>=3000) WHERE area_rank<=500""")
def box_features(spark, d):
    out = D.box_features(X.detections(spark, d), 0.2, 3000.0, 500)
    return out.select("image_id", "object_id", "score", "area", "cx", "cy", "area_rank")


@query("box_limit", f"""WITH {X.DET}, f AS (SELECT image_id, count(*) AS n FROM det WHERE score>=0.2 AND greatest(0,(x2-x1)*(y2-y1))>=3000 GROUP BY 1)
SELECT image_id, least(n,2) AS kept, greatest(n-2,0) AS dropped FROM f""")
def box_limit(spark, d):
    return D.boxes_over_limit(X.detections(spark, d), 0.2, 3000.0, 2)


@query("box_valid", f"""WITH {X.DET}, b AS (SELECT image_id, object_id,
 x1, y1, CASE WHEN object_id%3=0 THEN x1 WHEN object_id%5=1 THEN 'nan'::DOUBLE ELSE x2 END AS x2,
 CASE WHEN object_id%7=2 THEN NULL ELSE y2 END AS y2 FROM det)
SELECT image_id, object_id, coalesce(NOT isnan(x2) AND x2>x1 AND y2>y1, false) AS valid FROM b""")
def box_valid(spark, d):
    i = F.col("object_id")
    x2 = F.when(i % 3 == 0, F.col("x1")).when(i % 5 == 1, F.lit(float("nan"))).otherwise(F.col("x2"))
    box = F.array("x1", "y1", x2, F.when(i % 7 != 2, F.col("y2")))
    return X.detections(spark, d).select("image_id", "object_id", B.valid(box).alias("valid"))


MATRIX = ((0.5, 0.1, -12.0), (-0.05, 0.75, 4.0))


@query("box_affine", f"""WITH {X.DET}, m AS (SELECT image_id, object_id,
 [0.5*x1+0.1*y1-12, 0.5*x2+0.1*y1-12, 0.5*x1+0.1*y2-12, 0.5*x2+0.1*y2-12] AS xs,
 [-0.05*x1+0.75*y1+4, -0.05*x2+0.75*y1+4, -0.05*x1+0.75*y2+4, -0.05*x2+0.75*y2+4] AS ys FROM det),
c AS (SELECT image_id, object_id,
 least(greatest(list_min(xs),0),200) AS l, least(greatest(list_max(xs),0),200) AS r,
 least(greatest(list_min(ys),0),150) AS t, least(greatest(list_max(ys),0),150) AS b FROM m)
SELECT image_id, object_id,
 round(CASE WHEN r<=l AND l>=200 THEN 199 ELSE l END,6)+0.0 AS x1,
 round(CASE WHEN b<=t AND t>=150 THEN 149 ELSE t END,6)+0.0 AS y1,
 round(CASE WHEN r<=l THEN CASE WHEN l>=200 THEN 200 ELSE least(200,l+1) END ELSE r END,6)+0.0 AS x2,
 round(CASE WHEN b<=t THEN CASE WHEN t>=150 THEN 150 ELSE least(150,t+1) END ELSE b END,6)+0.0 AS y2
FROM c""")
def box_affine(spark, d):
    out = B.affine_clipped(B.sides(), MATRIX, 200, 150)
    return X.detections(spark, d).select(
        "image_id", "object_id", *[r6(c, n) for c, n in zip(out, B.SIDES)]
    )


@query("box_formats", f"""WITH {X.DET} SELECT image_id, object_id, x2-x1 AS w, y2-y1 AS h,
 (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, round((x1+x2)/2-(x2-x1)/2,6) AS bx1, round((y1+y2)/2+(y2-y1)/2,6) AS by2,
 round(x1+(x2-x1),6) AS wx2 FROM det""")
def box_formats(spark, d):
    wh = B.to_xywh(B.sides())
    cc = B.to_cxcywh(B.sides())
    back, again = B.from_cxcywh(cc), B.from_xywh(wh)
    return X.detections(spark, d).select(
        "image_id", "object_id", wh[2].alias("w"), wh[3].alias("h"), cc[0].alias("cx"),
        cc[1].alias("cy"), r6(back[0], "bx1"), r6(back[3], "by2"), r6(again[2], "wx2"),
    )


@query("iou_pairs", f"""WITH {X.DET}, {PAIRS}
SELECT image_id, a_id, b_id, round(iou,6) AS iou FROM pairs WHERE iou>0.1""")
def iou_pairs(spark, d):
    return D.iou_pairs(X.detections(spark, d), 0.1).withColumn("iou", F.round("iou", 6))


@query("overlap_stats", f"""WITH {X.DET}, {PAIRS}, hit AS (SELECT * FROM pairs WHERE iou>0.1),
t AS (SELECT image_id, count(DISTINCT o) AS in_overlap FROM
 (SELECT image_id, a_id AS o FROM hit UNION ALL SELECT image_id, b_id FROM hit) GROUP BY 1),
p AS (SELECT image_id, count(*) AS pairs, max(iou) AS mx, avg(iou) AS mn FROM hit GROUP BY 1),
n AS (SELECT image_id, count(*) AS boxes FROM det GROUP BY 1)
SELECT n.image_id, boxes, coalesce(in_overlap,0) AS in_overlap, coalesce(pairs,0) AS pairs,
 round(coalesce(mx,0),6) AS max_iou, round(coalesce(mn,0),6) AS mean_iou
FROM n LEFT JOIN t ON n.image_id=t.image_id LEFT JOIN p ON n.image_id=p.image_id""")
def overlap_stats(spark, d):
    out = D.overlap_stats(X.detections(spark, d), 0.1)
    return out.withColumns({c: F.round(c, 6) for c in ("max_iou", "mean_iou")})


@query("containment_prune", f"""WITH {X.DET} SELECT image_id, object_id FROM det a WHERE NOT EXISTS (
 SELECT 1 FROM det b WHERE b.image_id=a.image_id AND a.x1<=b.x1 AND a.y1<=b.y1 AND a.x2>=b.x2 AND a.y2>=b.y2
 AND NOT (a.x1=b.x1 AND a.y1=b.y1 AND a.x2=b.x2 AND a.y2=b.y2))""")
def containment_prune(spark, d):
    return D.prune_containers(X.detections(spark, d)).select("image_id", "object_id")


def mapping(spark, d):
    """A mapping with one global id per (video, part) and some rows left out."""
    det = X.detections(spark, d, "l_partkey", "l_suppkey", "l_returnflag")
    return det.filter(F.col("l_suppkey") % 11 != 3).select(
        "image_id", "object_id", *B.SIDES,
        (F.col("l_partkey") % 997).alias("global_id"),
        (F.col("l_returnflag") == "R").alias("removed"),
    )


MAPPING = f"""{X.DET}, mapping AS (SELECT image_id, object_id, x1, y1, x2, y2, l_partkey%997 AS global_id,
 l_returnflag='R' AS removed FROM det WHERE l_suppkey%11<>3)"""


@query("gid_enrich", f"""WITH {MAPPING} SELECT d.image_id, d.object_id, d.score, m.global_id,
 coalesce(m.removed,false) AS is_deduplicated
FROM det d LEFT JOIN mapping m ON d.image_id=m.image_id AND d.object_id=m.object_id""")
def gid_enrich(spark, d):
    out = D.enrich_ids(X.detections(spark, d), mapping(spark, d))
    return out.select("image_id", "object_id", "score", "global_id", "is_deduplicated")


@query("coverage_contract", f"""WITH {MAPPING}, bad AS (
 SELECT image_id, object_id, x1, y1, x2 + CASE WHEN global_id%50=1 THEN 1 ELSE 0 END AS x2, y2 FROM mapping
 UNION ALL SELECT image_id, object_id, x1, y1, x2, y2 FROM mapping WHERE global_id%40=2
 UNION ALL SELECT image_id, object_id+100000, x1, y1, x2, y2 FROM mapping WHERE global_id%30=3),
g AS (SELECT image_id, object_id, count(*) AS n, min((x1,y1,x2,y2)) AS lo, max((x1,y1,x2,y2)) AS hi
 FROM bad GROUP BY 1,2)
SELECT coalesce(d.image_id,g.image_id) AS image_id, coalesce(d.object_id,g.object_id) AS object_id,
 CASE WHEN g.n IS NULL THEN 'missing' WHEN d.image_id IS NULL THEN 'extra' WHEN n>1 THEN 'duplicate'
  ELSE 'mismatched' END AS reason
FROM det d FULL JOIN g ON d.image_id=g.image_id AND d.object_id=g.object_id
WHERE g.n IS NULL OR d.image_id IS NULL OR n>1 OR lo<>(d.x1,d.y1,d.x2,d.y2) OR hi<>(d.x1,d.y1,d.x2,d.y2)""")
def coverage_contract(spark, d):
    good = mapping(spark, d)
    g = F.col("global_id")
    moved = good.withColumn("x2", F.col("x2") + F.when(g % 50 == 1, 1).otherwise(0))
    cols = ["image_id", "object_id", *B.SIDES]
    bad = (
        moved.select(*cols)
        .union(good.filter(g % 40 == 2).select(*cols))
        .union(good.filter(g % 30 == 3).withColumn("object_id", F.col("object_id") + 100000).select(*cols))
    )
    return D.coverage_report(X.detections(spark, d), bad)


@query("rect_subtract", f"""WITH {X.DET}, r AS (SELECT a.image_id, a.object_id,
 {{'x1':a.x1,'y1':a.y1,'x2':a.x2,'y2':a.y2}} AS box, count(b.object_id) OVER w AS others,
 (SELECT 1) AS one FROM det a LEFT JOIN det b ON false WINDOW w AS (PARTITION BY a.image_id)),
n AS (SELECT image_id, count(*) AS boxes FROM det GROUP BY 1),
h AS (SELECT a.image_id, a.object_id, list([{{'x1':b.x1,'y1':b.y1,'x2':b.x2,'y2':b.y2}}] ORDER BY b.object_id) AS hits
 FROM det a JOIN det b ON a.image_id=b.image_id AND a.object_id<>b.object_id AND ({IOU})>0.1 GROUP BY 1,2),
c AS (SELECT a.image_id, a.object_id, a.x1, a.y1, a.x2, a.y2, boxes,
 CASE WHEN hits IS NULL THEN [{{'x1':a.x1,'y1':a.y1,'x2':a.x2,'y2':a.y2}}] ELSE
 list_reduce(list_prepend([{{'x1':a.x1,'y1':a.y1,'x2':a.x2,'y2':a.y2}}], hits), lambda acc, o: flatten(list_transform(acc, lambda t:
  CASE WHEN greatest(t.x1,o[1].x1)>=least(t.x2,o[1].x2) OR greatest(t.y1,o[1].y1)>=least(t.y2,o[1].y2) THEN [t]
  ELSE list_filter([
   {{'x1':t.x1,'y1':t.y1,'x2':t.x2,'y2':greatest(t.y1,o[1].y1)}},
   {{'x1':t.x1,'y1':least(t.y2,o[1].y2),'x2':t.x2,'y2':t.y2}},
   {{'x1':t.x1,'y1':greatest(t.y1,o[1].y1),'x2':greatest(t.x1,o[1].x1),'y2':least(t.y2,o[1].y2)}},
   {{'x1':least(t.x2,o[1].x2),'y1':greatest(t.y1,o[1].y1),'x2':t.x2,'y2':least(t.y2,o[1].y2)}}],
   lambda q: q.x2>q.x1 AND q.y2>q.y1) END))) END AS cutted
 FROM det a JOIN n ON a.image_id=n.image_id LEFT JOIN h ON a.image_id=h.image_id AND a.object_id=h.object_id),
k AS (SELECT *, CASE WHEN boxes=1 THEN cutted ELSE
 list_filter(cutted, lambda q: (q.x2-q.x1)*(q.y2-q.y1)>=100) END AS kept FROM c)
SELECT image_id, object_id, CASE WHEN len(kept)=0 THEN 1 ELSE CAST(len(kept) AS INTEGER) END AS regions,
 round(CASE WHEN len(kept)=0 THEN pow(least((x2-x1)*0.3,(y2-y1)*0.3,50),2)
 ELSE list_sum(list_transform(kept, lambda q: (q.x2-q.x1)*(q.y2-q.y1))) END,4) AS free_area FROM k""")
def rect_subtract(spark, d):
    out = D.free_regions(X.detections(spark, d), 0.1)
    total = F.aggregate(
        "regions", F.lit(0.0), lambda s, r: s + (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    )
    return out.select(
        "image_id", "object_id", F.size("regions").alias("regions"), r6(total, "free_area", 4)
    )


# Pairs of consecutive detections of an image: enough to exercise pair functions on every row.
NEXT = f"""{X.DET}, nxt AS (SELECT a.image_id, a.object_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2,
 b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
 FROM det a JOIN det b ON a.image_id=b.image_id AND a.object_id+1=b.object_id),
i AS (SELECT *, greatest(least(ax2,bx2)-greatest(ax1,bx1),0)*greatest(least(ay2,by2)-greatest(ay1,by1),0) AS inter,
 (ax2-ax1)*(ay2-ay1) AS aa, (bx2-bx1)*(by2-by1) AS ba,
 (greatest(ax2,bx2)-least(ax1,bx1))*(greatest(ay2,by2)-least(ay1,by1)) AS hull FROM nxt)"""


def _next_pairs(spark, d):
    det = X.detections(spark, d)
    a = det.select("image_id", "object_id", *[F.col(c).alias("a" + c) for c in B.SIDES])
    b = det.select(
        "image_id", (F.col("object_id") - 1).alias("object_id"), *[F.col(c).alias("b" + c) for c in B.SIDES]
    )
    return a.join(b, ["image_id", "object_id"])


@query("box_scalars", f"""WITH {NEXT} SELECT image_id, object_id, aa AS area, inter, aa+ba-inter AS uni,
 round(inter/(aa+ba-inter),6) AS iou, round(inter/(aa+ba-inter)-(hull-(aa+ba-inter))/hull,6) AS giou,
 ax1<=bx1 AND ay1<=by1 AND ax2>=bx2 AND ay2>=by2 AS covers FROM i""")
def box_scalars(spark, d):
    a, b = B.sides("a"), B.sides("b")
    return _next_pairs(spark, d).select(
        "image_id", "object_id", B.area(a).alias("area"), B.intersection(a, b).alias("inter"),
        B.union_area(a, b).alias("uni"), r6(B.iou(a, b), "iou"), r6(B.giou(a, b), "giou"),
        B.contains(a, b).alias("covers"),
    )


@query("sim_variants", f"""WITH {NEXT} SELECT image_id, object_id, round(inter/aa,6) AS ioa,
 round(greatest(0,1-sqrt(pow((ax1+ax2)/2-(bx1+bx2)/2,2)+pow((ay1+ay2)/2-(by1+by2)/2,2))/100/2),6)+0.0 AS near FROM i""")
def sim_variants(spark, d):
    a, b = B.sides("a"), B.sides("b")
    (ax, ay), (bx, by) = B.center(a), B.center(b)
    dist = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / 100
    return _next_pairs(spark, d).select(
        "image_id", "object_id", r6(B.overlap_of_own(a, b), "ioa"),
        r6(F.greatest(F.lit(0.0), 1 - dist / 2), "near"),
    )


@query("tracklet_iou", f"""WITH {X.DET}, {X.FRAMES}, r AS (SELECT f.video, f.idx//2 AS frame,
 f.idx%2 AS half, d.object_id, x1, y1, x2, y2 FROM det d JOIN frames f ON d.image_id=f.image_id),
p AS (SELECT video, frame, object_id AS track, x1,y1,x2,y2 FROM r WHERE half=0),
g AS (SELECT video, frame, object_id AS track, x1,y1,x2,y2 FROM r WHERE half=1),
s AS (SELECT a.video, a.track AS pred, b.track AS truth,
 sum(greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)) AS inter
 FROM p a JOIN g b ON a.video=b.video AND a.frame=b.frame GROUP BY ALL),
ap AS (SELECT video, track, sum((x2-x1)*(y2-y1)) AS ar FROM p GROUP BY ALL),
ag AS (SELECT video, track, sum((x2-x1)*(y2-y1)) AS ar FROM g GROUP BY ALL)
SELECT s.video, pred, truth, inter, round(inter/(ap.ar+ag.ar-inter),6) AS iou FROM s
JOIN ap ON s.video=ap.video AND s.pred=ap.track JOIN ag ON s.video=ag.video AND s.truth=ag.track WHERE inter>0""")
def tracklet_iou(spark, d):
    rows = X.detections(spark, d).join(X.frames(spark, d), "image_id").select(
        "video", F.floor(F.col("idx") / 2).alias("frame"), (F.col("idx") % 2).alias("half"),
        F.col("object_id").alias("track"), *B.SIDES,
    )
    out = D.tracklet_iou(rows.filter("half = 0"), rows.filter("half = 1"))
    return out.withColumn("iou", F.round("iou", 6))


@query("gaussian_weights", f"""WITH {X.DET}, u AS (SELECT *, (l_partkey%21-10)/10.0 AS dx, (l_suppkey%21-10)/10.0 AS dy FROM det)
SELECT image_id, object_id, round(CASE WHEN sqrt(dx*dx+dy*dy)<=0.4*2.5 THEN exp(-(dx*dx+dy*dy)/(2*0.4*0.4)) ELSE 0 END,6) AS weight,
 CAST(greatest(5,least(floor(sqrt((x2-x1)*(y2-y1))*2),300)) AS BIGINT) AS budget FROM u""")
def gaussian_weights(spark, d):
    det = X.detections(spark, d, "l_partkey", "l_suppkey")
    dx, dy = [(F.col(c) % 21 - 10) / F.lit(10.0) for c in ("l_partkey", "l_suppkey")]
    return det.select(
        "image_id", "object_id", r6(S.centre_weight(dx, dy, 0.4, 2.5), "weight"),
        S.point_budget(B.area(B.sides()), 300).alias("budget"),
    )


@query("resize_rules", """WITH s AS (SELECT p_partkey, CAST(p_size*37 AS BIGINT) AS w, CAST(p_size*23+5 AS BIGINT) AS h FROM part),
t AS (SELECT *, greatest(w,h) AS m FROM s)
SELECT p_partkey, CASE WHEN m<=504 THEN w ELSE CAST(floor(w*(504.0::DOUBLE/m)/14)*14 AS BIGINT) END AS fit_w,
 CASE WHEN m<=504 THEN h ELSE CAST(floor(h*(504.0::DOUBLE/m)/14)*14 AS BIGINT) END AS fit_h,
 CAST(greatest(1,CASE WHEN (w//14+1)*14-w<=w-w//14*14 THEN (w//14+1)*14 ELSE w//14*14 END) AS BIGINT) AS patch_w,
 round(504.0::DOUBLE/w,6) AS scale, round((504.0::DOUBLE/w-1)/2,6)+0.0 AS shift FROM t""")
def resize_rules(spark, d):
    w, h = (F.col("p_size") * 37).cast("long"), (F.col("p_size") * 23 + 5).cast("long")
    fw, fh = S.floored_size(w, h)
    scale, shift = S.pixel_centre_affine(w, F.lit(504.0))
    return X.table(spark, d, "part").select(
        "p_partkey", fw.alias("fit_w"), fh.alias("fit_h"), S.nearest_patch(w).alias("patch_w"),
        r6(scale, "scale"), r6(shift, "shift"),
    )


_UNIFORM = "(('0x' || substr(md5({0}), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@query("weighted_points", f"""WITH {X.DET}, b AS (SELECT *, CAST(greatest(5,least(floor(sqrt((x2-x1)*(y2-y1))*2),8)) AS BIGINT) AS budget FROM det),
e AS (SELECT *, CAST(floor(sqrt(budget*4)) AS BIGINT) AS edge FROM b),
g AS (SELECT e.*, j*edge+i AS k, i::DOUBLE/(edge-1) AS u, j::DOUBLE/(edge-1) AS v FROM e, unnest(range(edge)) AS t(i), unnest(range(edge)) AS r(j)),
w AS (SELECT *, CASE WHEN sqrt((2*u-1)*(2*u-1)+(2*v-1)*(2*v-1))<=0.4*2.5 THEN exp(-((2*u-1)*(2*u-1)+(2*v-1)*(2*v-1))/(2*0.4*0.4)) ELSE 0 END AS weight FROM g),
d AS (SELECT *, CASE WHEN count(*) FILTER (weight>0) OVER (PARTITION BY image_id,object_id) < budget THEN 1 ELSE weight END AS even FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id,object_id ORDER BY -ln({_UNIFORM.format("image_id || ':' || object_id || ':' || k")})/even, k) AS pos FROM d WHERE even>0)
SELECT image_id, object_id, CAST(pos AS INTEGER) AS pos, round(x1+(x2-x1)*u,6)+0.0 AS x, round(y1+(y2-y1)*v,6)+0.0 AS y FROM o WHERE pos<=budget""")
def weighted_points(spark, d):
    det = X.detections(spark, d).withColumn("budget", S.point_budget(B.area(B.sides()), 8))
    out = A.box_points(det, ["image_id", "object_id"], ["x1", "y1", "x2", "y2"], "budget", 0.4, 2.5)
    return out.select("image_id", "object_id", "pos", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query("weighted_draw", f"""WITH {X.DET}, w AS (SELECT *, round((x2-x1)*(y2-y1),2)*(CASE WHEN l_returnflag='R' THEN 0 ELSE 1 END) AS weight FROM det),
d AS (SELECT *, CASE WHEN count(*) FILTER (weight>0) OVER (PARTITION BY image_id) < 3 THEN 1 ELSE weight END AS even FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY -ln({_UNIFORM.format("image_id || ':' || object_id")})/even, object_id) AS pos FROM d WHERE even>0)
SELECT image_id, object_id, CAST(pos AS INTEGER) AS pos, weight FROM o WHERE pos<=3""")
def weighted_draw(spark, d):
    det = X.detections(spark, d, "l_returnflag")
    weight = F.round(B.area(B.sides()), 2) * F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    rows = det.select("image_id", "object_id", weight.alias("weight"), F.lit(3).alias("n"))
    return A.weighted_draw(rows, ["image_id"], "weight", "object_id", "n", 3).select("image_id", "object_id", "pos", "weight")


@query("area_shares", f"""WITH {X.DET}, s AS (SELECT image_id, object_id, (x2-x1)*(y2-y1) AS area, sum((x2-x1)*(y2-y1)) OVER (PARTITION BY image_id) AS total FROM det),
e AS (SELECT *, area*100/total AS exact FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(exact-floor(exact),9) DESC, object_id) AS turn, 100-sum(floor(exact)) OVER (PARTITION BY image_id) AS over FROM e)
SELECT image_id, object_id, area, CAST(floor(exact)+(CASE WHEN turn<=over THEN 1 ELSE 0 END) AS BIGINT) AS share FROM r""")
def area_shares(spark, d):
    det = X.detections(spark, d).select("image_id", "object_id", B.area(B.sides()).alias("area"))
    return A.area_shares(det, ["image_id"], "object_id", "area", 100)
