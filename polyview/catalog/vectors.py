"""Queries over vectors and neighbour searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.registry import query, r6
from polyview.operators import vectors as V

VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda q: q::DOUBLE) AS e, label FROM embeddings)"
NN = f"""{VEC}, d AS (SELECT a.id AS target, b.id AS source, round(list_distance(a.e,b.e),12) AS dist FROM v a JOIN v b ON CONDITION),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY dist, source) AS INTEGER) AS rank FROM d)"""


def _vectors(spark, d):
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _halves(spark, d):
    v = _vectors(spark, d)
    return v.filter("id % 2 = 0"), v.filter("id % 2 = 1")


@query("knn_join", "WITH " + NN.replace("CONDITION", "a.id<>b.id") + " SELECT target, source, rank, round(dist,6) AS distance FROM r WHERE rank<=5")
def knn_join(spark, d):
    v = _vectors(spark, d)
    return V.knn(v, v, 5, exclude_self=True).withColumn("distance", F.round("distance", 6))


TWO = ", ".join(
    f"""{n} AS (SELECT a.id AS t, arg_min(b.id,(round(list_distance(a.e,b.e),12),b.id)) AS s, min(round(list_distance(a.e,b.e),12)) AS d1,
 list_sort(list(round(list_distance(a.e,b.e),12)))[2] AS d2 FROM v a JOIN v b ON a.id%2={p} AND b.id%2={q} GROUP BY 1)"""
    for n, p, q in (("ab", 0, 1), ("ba", 1, 0))
)


@query("mutual_ratio_matches", f"WITH {VEC}, {TWO} SELECT ab.t AS a_id, ab.s AS b_id, round(ab.d1,6) AS distance FROM ab JOIN ba ON ab.s=ba.t AND ba.s=ab.t WHERE ab.d1<0.95::DOUBLE*ab.d2 AND ba.d1<0.95::DOUBLE*ba.d2")
def mutual_ratio_matches(spark, d):
    a, b = _halves(spark, d)
    return V.mutual_matches(a, b, 0.95).withColumn("distance", F.round("distance", 6))


SIM = f"""{VEC}, d AS (SELECT a.id AS t, b.id AS s, round(list_inner_product(a.e,b.e),12) AS sim FROM v a, v b), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY sim DESC, s) AS rk FROM d),
p AS (SELECT least(t,s) AS i, greatest(t,s) AS j, max(sim) AS sim FROM r WHERE rk>1 AND rk<=6 AND sim>0.3 AND abs(t-s)>10 GROUP BY 1,2)"""


@query("similar_frames", f"WITH {SIM} SELECT i, j, round(sim,6) AS sim FROM p")
def similar_frames(spark, d):
    return V.similar_frames(_vectors(spark, d), 5, 0.3).withColumn("sim", F.round("sim", 6))


@query("window_nms", f"""WITH {SIM}, ls AS (SELECT list({{'i':i,'j':j,'s':sim}} ORDER BY sim DESC, i, j) AS es FROM p),
k AS (SELECT unnest(list_reduce(list_prepend(list_filter([es[1]], lambda q: false), list_transform(es, lambda q: [q])), lambda acc, o:
 CASE WHEN len(list_filter(acc, lambda q: (o[1].i>=q.i-10 AND o[1].i<least(q.i+11,q.j)) OR (o[1].i>=greatest(q.i+1,q.j-10) AND o[1].i<=q.j+10)
  OR (o[1].j>=q.i-10 AND o[1].j<least(q.i+11,q.j)) OR (o[1].j>=greatest(q.i+1,q.j-10) AND o[1].j<=q.j+10)))>0 THEN acc ELSE list_concat(acc,o) END)) AS m FROM ls)
SELECT m.i AS i, m.j AS j, round(m.s,6) AS sim FROM k""")
def window_nms(spark, d):
    from polyview.operators.linking import window_nms as thin

    return thin(V.similar_frames(_vectors(spark, d), 5, 0.3), 10).withColumn("sim", F.round("sim", 6))


@query("cloud_fscore", f"""WITH {VEC}, p AS (SELECT a.id, min(round(list_distance(a.e,b.e),12)) AS m FROM v a JOIN v b ON a.id%2=0 AND b.id%2=1 GROUP BY 1),
t AS (SELECT a.id, min(round(list_distance(a.e,b.e),12)) AS m FROM v a JOIN v b ON a.id%2=1 AND b.id%2=0 GROUP BY 1),
s AS (SELECT (SELECT avg(m) FROM p) AS accuracy, (SELECT avg(m) FROM t) AS completeness, (SELECT avg(CASE WHEN m<1.1 THEN 1.0::DOUBLE ELSE 0 END) FROM p) AS pr, (SELECT avg(CASE WHEN m<1.1 THEN 1.0::DOUBLE ELSE 0 END) FROM t) AS rc)
SELECT round(accuracy,6) AS accuracy, round(completeness,6) AS completeness, round(pr,6) AS "precision", round(rc,6) AS recall, round(CASE WHEN pr+rc>0 THEN 2*pr*rc/(pr+rc) ELSE 0 END,6) AS fscore FROM s""")
def cloud_fscore(spark, d):
    a, b = _halves(spark, d)
    out = V.cloud_scores(a, b, 1.1)
    return out.select(*[r6(F.col(c), c) for c in out.columns])


FAR = f"""{VEC}, f AS (SELECT 0 AS step, id, e, 0.0::DOUBLE AS gap, [id] AS seen FROM v WHERE id=0
 UNION ALL SELECT step+1, n.id, n.e, n.gap, list_append(f.seen, n.id) FROM f, LATERAL (SELECT v.id, v.e, round(list_distance(v.e,f.e),9) AS gap FROM v WHERE NOT list_contains(f.seen, v.id) ORDER BY gap DESC, v.id LIMIT 1) n WHERE step<7)"""


@query("farthest_first", f"WITH RECURSIVE {FAR} SELECT CAST(step AS INTEGER) AS step, id, round(gap,6) AS gap FROM f")
def farthest_first(spark, d):
    return V.farthest_first(_vectors(spark, d), 8, 0).withColumn("gap", F.round("gap", 6))


@query("balanced_representative", f"""WITH {VEC}, u AS (SELECT id, label, sqrt(list_inner_product(e,e)) AS norm, list_transform(e, lambda q: q/sqrt(list_inner_product(e,e))) AS un FROM v),
s AS (SELECT a.label, a.id, a.norm, list_var_samp(a.un) AS vr, sum(CASE WHEN a.id<>b.id THEN list_inner_product(a.un,b.un) ELSE 0 END)/(count(*)-1) AS sim FROM u a JOIN u b ON a.label=b.label GROUP BY 1,2,3,4),
n AS (SELECT *, min(sim) OVER w AS s0, max(sim) OVER w AS s1, min(norm) OVER w AS n0, max(norm) OVER w AS n1, min(vr) OVER w AS v0, max(vr) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY label)),
b AS (SELECT label, id, round(abs((sim-s0)/(s1-s0+1e-8)-0.5)+abs((norm-n0)/(n1-n0+1e-8)-0.5)+abs((vr-v0)/(v1-v0+1e-8)-0.5),4) AS balance FROM n)
SELECT label, arg_min(id,(balance,id)) AS id FROM b GROUP BY 1""")
def balanced_representative(spark, d):
    return V.balanced_representative(_vectors(spark, d), "label").select("label", "id")


@query("outlier_removal", f"""WITH {X.PTS}, m AS (SELECT a.point_id, list_sum(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 20))/20 AS md FROM pts a, pts b GROUP BY 1),
s AS (SELECT avg(md) AS mu, stddev_samp(md) AS sd FROM m) SELECT point_id, round(md,6) AS mean_distance FROM m, s WHERE md>0 AND md<mu+2*sd""")
def outlier_removal(spark, d):
    pts = X.points(spark, d).select("point_id", "x", "y", "z")
    return V.outlier_removal(pts, "point_id").select("point_id", r6(F.col("mean_distance"), "mean_distance"))
