"""Queries for match accuracy, roll-ups and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.registry import query, r6
from polyview.operators import accuracy as A

# Ground truth and predictions cut from the match edges, with overlap and disagreement.
SIDES = f"""{X.MATCH}, gt AS (SELECT ref_img, tgt_img, ref_id, tgt_id FROM edges WHERE (matched+ref_id+tgt_id)%4<>0),
pr AS (SELECT ref_img, tgt_img, ref_id, tgt_id FROM edges WHERE hit_ratio>=0.5)"""


def _sides(spark, d):
    e = X.matches(spark, d)
    cols = ["ref_img", "tgt_img", "ref_id", "tgt_id", F.struct("ref_id", "tgt_id").alias("seq")]
    gt = e.filter((F.col("matched") + F.col("ref_id") + F.col("tgt_id")) % 4 != 0).select(*cols)
    return e, gt, e.filter("hit_ratio >= 0.5").select(*cols)


PAIR = f"""{SIDES}, c AS (SELECT ref_img, tgt_img, ref_id, tgt_id, max(g) AS g, max(p) AS p FROM (
 SELECT *, 1 AS g, 0 AS p FROM gt UNION ALL SELECT *, 0, 1 FROM pr) GROUP BY ALL),
l AS (SELECT *, max(CASE WHEN g=1 THEN tgt_id END) OVER w AS gl, max(CASE WHEN p=1 THEN tgt_id END) OVER w AS pl FROM c
 WINDOW w AS (PARTITION BY ref_img, tgt_img, ref_id)),
r AS (SELECT ref_img, tgt_img, ref_id, sum(g) AS gs, sum(p) AS ps, sum(g*p) AS tp,
 count(*) FILTER (g=1 AND p=0 AND NOT coalesce(pl<>tgt_id,false)) AS missed,
 count(*) FILTER (p=1 AND g=0 AND NOT coalesce(gl<>tgt_id,false)) AS extra, any_value(gl) AS gl, any_value(pl) AS pl FROM l GROUP BY ALL),
m AS (SELECT ref_img, tgt_img, CAST(sum(gs) AS BIGINT) AS gt_rows, CAST(sum(ps) AS BIGINT) AS pred_rows, CAST(sum(tp) AS BIGINT) AS tp,
 CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extra) AS BIGINT) AS extra,
 count(*) FILTER (gl IS NOT NULL AND pl IS NOT NULL) AS map_total, count(*) FILTER (gl=pl) AS map_correct FROM r GROUP BY ALL)"""


@query("pair_metrics", f"""WITH {PAIR} SELECT *, map_total-map_correct AS wrong,
 round(tp/gt_rows,6) AS recall, CASE WHEN pred_rows=0 THEN 0 ELSE round(tp/pred_rows,6) END AS effectiveness,
 CASE WHEN map_total=0 THEN 0 ELSE round(map_correct/map_total,6) END AS "precision" FROM m WHERE gt_rows>0""")
def pair_metrics(spark, d):
    e, gt, pr = _sides(spark, d)
    out = A.pair_metrics(gt, pr, e, ["ref_img", "tgt_img"]).drop("gt_set", "pred_set")
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "effectiveness", "precision")})


@query("pair_metrics_overall", f"""WITH {PAIR}, k AS (SELECT * FROM m WHERE gt_rows>0)
SELECT count(*) AS pairs, CAST(sum(gt_rows) AS BIGINT) AS gt_rows, CAST(sum(pred_rows) AS BIGINT) AS pred_rows,
 CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extra) AS BIGINT) AS extra,
 CAST(sum(map_total-map_correct) AS BIGINT) AS wrong, CAST(sum(map_total) AS BIGINT) AS map_total, CAST(sum(map_correct) AS BIGINT) AS map_correct,
 round(sum(tp)/sum(gt_rows),6) AS recall, round(sum(tp)/sum(pred_rows),6) AS effectiveness,
 round(sum(map_correct)/sum(map_total),6) AS "precision" FROM k""")
def pair_metrics_overall(spark, d):
    e, gt, pr = _sides(spark, d)
    out = A.overall_metrics(A.pair_metrics(gt, pr, e, ["ref_img", "tgt_img"]))
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "effectiveness", "precision")})


@query("match_outcomes", f"""WITH {PAIR} SELECT ref_img, tgt_img, ref_id, tgt_id, CASE WHEN g=1 AND p=1 THEN 'correct'
 WHEN g=1 AND pl<>tgt_id THEN 'wrong' WHEN g=1 THEN 'missed' WHEN gl<>tgt_id THEN 'wrong' ELSE 'extra' END AS outcome FROM l""")
def match_outcomes(spark, d):
    _, gt, pr = _sides(spark, d)
    return A.match_outcomes(gt, pr, ["ref_img", "tgt_img"])


@query("pair_sets", f"""WITH {SIDES}, u AS (SELECT 'both' AS side, * FROM (SELECT * FROM gt INTERSECT SELECT * FROM pr)
 UNION ALL SELECT 'missed', * FROM (SELECT * FROM gt EXCEPT SELECT * FROM pr)
 UNION ALL SELECT 'extra', * FROM (SELECT * FROM pr EXCEPT SELECT * FROM gt)) SELECT * FROM u""")
def pair_sets(spark, d):
    _, gt, pr = _sides(spark, d)
    gt, pr = gt.drop("seq"), pr.drop("seq")
    named = lambda df, n: df.select(F.lit(n).alias("side"), "*")
    return named(gt.intersect(pr), "both").union(named(gt.subtract(pr), "missed")).union(
        named(pr.subtract(gt), "extra")
    )


@query("match_summary", f"""WITH {X.MATCH} SELECT tgt_img, count(*) AS match_count, round(avg(hit_ratio),6) AS avg_ratio,
 round(avg(matched/greatest(1,total)),6) AS avg_share FROM edges GROUP BY 1""")
def match_summary(spark, d):
    out = A.match_summary(X.matches(spark, d), ["tgt_img"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_ratio", "avg_share")})


@query("pair_filter", f"""WITH {X.MATCH}, b AS (SELECT video, ref_idx, ref_idx+1 AS tgt_idx, ref_id, tgt_id, hit_ratio FROM edges
 UNION ALL SELECT video, ref_idx+1, ref_idx, tgt_id, ref_id, hit_ratio FROM edges),
v AS (SELECT video, max(greatest(ref_idx,tgt_idx)) AS hi, min(least(ref_idx,tgt_idx)) AS lo FROM b GROUP BY 1)
SELECT b.* FROM b JOIN v ON b.video=v.video WHERE (ref_idx<tgt_idx OR (ref_idx=hi AND tgt_idx=lo)) AND hit_ratio>=0.4""")
def pair_filter(spark, d):
    from polyview.operators.linking import allowed_pairs

    e = X.matches(spark, d)
    back = F.col("ref_idx") + 1
    both = e.select("video", "ref_idx", back.alias("tgt_idx"), "ref_id", "tgt_id", "hit_ratio").union(
        e.select("video", back.alias("ref_idx"), F.col("ref_idx").alias("tgt_idx"),
                 F.col("tgt_id").alias("ref_id"), F.col("ref_id").alias("tgt_id"), "hit_ratio")
    )
    return allowed_pairs(both, ["video"], 0.4)


@query("weighted_rollup", """WITH s AS (SELECT l_returnflag AS run, concat(l_linestatus,'-',CAST(year(l_shipdate) AS VARCHAR)) AS dataset,
 count(*) AS n, avg(l_discount) AS recall, avg(l_tax) AS effectiveness, avg(l_quantity) AS "precision" FROM lineitem GROUP BY ALL),
w AS (SELECT run, count(*) AS datasets, CAST(sum(n) AS BIGINT) AS total, sum(recall*n)/sum(n) AS w_recall,
 sum(effectiveness*n)/sum(n) AS w_effectiveness, sum("precision"*n)/sum(n) AS w_precision,
 avg(recall) AS s_recall, avg(effectiveness) AS s_effectiveness, avg("precision") AS s_precision FROM s GROUP BY 1)
SELECT run, datasets, total, round(w_recall,6) AS w_recall, round(w_effectiveness,6) AS w_effectiveness, round(w_precision,6) AS w_precision,
 round(s_recall,6) AS s_recall, round(s_effectiveness,6) AS s_effectiveness, round(s_precision,6) AS s_precision,
 row_number() OVER (ORDER BY w_recall DESC, run) AS rank_recall, row_number() OVER (ORDER BY w_effectiveness DESC, run) AS rank_effectiveness,
 row_number() OVER (ORDER BY w_precision DESC, run) AS rank_precision FROM w""")
def weighted_rollup(spark, d):
    rows = X.table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("run"),
        F.concat_ws("-", "l_linestatus", F.year("l_shipdate").cast("string")).alias("dataset"),
    ).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("recall"),
          F.avg("l_tax").alias("effectiveness"), F.avg("l_quantity").alias("precision"))
    names = ["recall", "effectiveness", "precision"]
    out = A.weighted_rollup(rows, "run", "n", names)
    return out.withColumns({f"{k}_{m}": F.round(f"{k}_{m}", 6) for k in "ws" for m in names})


@query("scene_mean", f"""WITH {X.MATCH}, s AS (SELECT video, avg(hit_ratio) AS ratio, avg(matched) AS matched FROM edges GROUP BY 1)
SELECT CAST(video AS VARCHAR) AS video, round(ratio,6) AS ratio, round(matched,6) AS matched FROM s
UNION ALL SELECT 'mean', round(avg(ratio),6), round(avg(matched),6) FROM s""")
def scene_mean(spark, d):
    rows = X.matches(spark, d).groupBy("video").agg(F.avg("hit_ratio").alias("ratio"), F.avg("matched").alias("matched"))
    out = A.mean_rows(rows, "video", ["ratio", "matched"])
    return out.withColumns({c: F.round(c, 6) for c in ("ratio", "matched")})


@query("psnr_pooled", """WITH q AS (SELECT l_suppkey AS view, pow(l_quantity-l_linenumber*7,2) AS sq FROM lineitem WHERE l_returnflag<>'R'),
v AS (SELECT view, sum(sq) AS sq, count(*) AS n FROM q GROUP BY 1), u AS (SELECT * FROM v UNION ALL SELECT NULL, sum(sq), sum(n) FROM v)
SELECT view, CAST(n AS BIGINT) AS pixels, round(sq/n,6) AS mse, CASE WHEN sq/n>0 THEN round(10*log10(255.0*255.0/(sq/n)),6) END AS psnr FROM u""")
def psnr_pooled(spark, d):
    out = A.psnr(
        X.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "view"), "view",
        F.col("l_quantity"), F.col("l_linenumber") * 7, F.col("l_returnflag") != "R",
    )
    return out.withColumns({c: F.round(c, 6) for c in ("mse", "psnr")})


@query("agreement_rates", """WITH r AS (SELECT doc_id, quality AS t, CASE WHEN doc_id%3<>0 THEN toxic END AS a, CASE WHEN doc_id%5<>0 THEN toxic END AS b FROM labels)
SELECT count(*) AS samples, count(a) AS assigned, count(*) FILTER (a=t) AS matched, count(*) FILTER (b IS NOT NULL AND a IS NULL) AS lost,
 round(count(a)/count(*),6) AS coverage, round(count(*) FILTER (a=t)/count(*),6) AS match_all,
 round(count(*) FILTER (a=t)/count(a),6) AS match_assigned FROM r""")
def agreement_rates(spark, d):
    rows = X.table(spark, d, "labels").select(
        F.col("quality").alias("t"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic")).alias("a"),
        F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("b"),
    )
    out = A.agreement(rows, "t", "a", "b")
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "match_all", "match_assigned")})


@query("transition_matrix", """WITH r AS (SELECT CASE WHEN doc_id%4<>0 THEN quality END AS b, CASE WHEN doc_id%6<>0 THEN toxic END AS a, 1+doc_id%3 AS w FROM labels),
c AS (SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'lost' WHEN a=b THEN 'same' ELSE 'changed' END AS change, w FROM r)
SELECT change, count(*) AS n, round(sum(w)/(SELECT sum(w) FROM c),6) AS share FROM c GROUP BY 1""")
def transition_matrix(spark, d):
    rows = X.table(spark, d, "labels").select(
        F.when(F.col("doc_id") % 4 != 0, F.col("quality")).alias("b"),
        F.when(F.col("doc_id") % 6 != 0, F.col("toxic")).alias("a"), (1 + F.col("doc_id") % 3).alias("w"),
    )
    return A.transitions(rows, "b", "a", F.col("w")).withColumn("share", F.round("share", 6))


@query("run_comparison", f"""WITH {X.MATCH}, y AS (SELECT year(o_orderdate) AS run, avg(hit_ratio) AS ratio, avg(matched/greatest(1,total)) AS share
 FROM edges JOIN frames ON ref_img=image_id GROUP BY 1),
u AS (SELECT CAST(run AS INTEGER) AS run, 'ratio' AS metric, ratio AS value FROM y UNION ALL SELECT CAST(run AS INTEGER), 'share', share FROM y)
SELECT a.run, a.metric, round(a.value,6) AS value, round(b.value,6) AS reference_value, round((a.value-b.value)*100,4)+0.0 AS delta
FROM u a LEFT JOIN u b ON b.run=a.run-1 AND a.metric=b.metric""")
def run_comparison(spark, d):
    fr = X.frames(spark, d).select(F.col("image_id").alias("ref_img"), F.year("o_orderdate").alias("run"))
    rows = X.matches(spark, d).join(fr, "ref_img").groupBy("run").agg(
        F.avg("hit_ratio").alias("ratio"), F.avg(F.col("matched") / F.greatest(F.lit(1), F.col("total"))).alias("share")
    )
    long = rows.unpivot(["run"], ["ratio", "share"], "metric", "value").withColumn("ref", F.col("run") - 1)
    out = A.compare_runs(long, "run", "ref", "metric", "value")
    return out.select("run", "metric", r6(F.col("value"), "value"), r6(F.col("reference_value"), "reference_value"), r6(F.col("delta"), "delta", 4))


@query("macro_micro", """WITH j AS (SELECT r_name AS g, c_acctbal AS v FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
p AS (SELECT g, avg(v) AS m FROM j GROUP BY 1)
SELECT g AS name, round(m,6) AS mean FROM p UNION ALL SELECT 'macro', round(avg(m),6) FROM p UNION ALL SELECT 'micro', round(avg(v),6) FROM j""")
def macro_micro(spark, d):
    nation, region = X.table(spark, d, "nation"), X.table(spark, d, "region")
    rows = (
        X.table(spark, d, "customer")
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
    )
    return A.macro_micro(rows, "r_name", "c_acctbal").withColumn("mean", F.round("mean", 6))


STAGES = ["click", "view", "purchase"]


@query("complete_case_summary", """WITH l AS (SELECT user_id, event_type, arg_max(value<400,event_id) AS ok, arg_max(value,event_id) AS wall,
 count(*) AS calls, sum(value) AS total FROM events GROUP BY 1,2),
d AS (SELECT user_id FROM l GROUP BY 1 HAVING count(*) FILTER (ok AND event_type IN ('click','view','purchase'))=3)
SELECT event_type AS stage, count(*) AS cases, round(avg(wall),6) AS mean_wall, max(wall) AS peak_wall, CAST(sum(calls) AS BIGINT) AS calls,
 round(sum(total),4) AS total_wall FROM l JOIN d ON l.user_id=d.user_id WHERE event_type IN ('click','view','purchase') GROUP BY 1""")
def complete_case_summary(spark, d):
    rows = X.table(spark, d, "events").select(
        F.col("user_id").alias("case"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"),
        (F.col("value") < 400).alias("ok"), F.col("value").alias("wall"),
    )
    means, _ = A.complete_cases(rows, STAGES)
    return means.withColumns({"mean_wall": F.round("mean_wall", 6), "total_wall": F.round("total_wall", 4)})


@query("error_auc", """WITH b AS (SELECT count(*) AS n, list(value) AS vs FROM events),
g AS (SELECT range AS k FROM range(30)),
h AS (SELECT k, count(*) FILTER (v>=k AND (v<k+1 OR (k=29 AND v=30))) AS c FROM g, (SELECT value/10 AS v FROM events) GROUP BY 1),
s AS (SELECT k, sum(c) OVER (ORDER BY k)/(SELECT n FROM b) AS share FROM h)
SELECT (SELECT n FROM b) AS n, round(avg(share),6) AS auc FROM s""")
def error_auc(spark, d):
    out = A.error_auc(X.table(spark, d, "events"), F.col("value") / 10, 30)
    return out.withColumn("auc", F.round("auc", 6))


@query("average_precision", """WITH s AS (SELECT quality AS klass, doc_id AS id, (doc_id*7919%1000)/1000.0::DOUBLE AS score, toxic=1 OR doc_id%3=0 AS hit FROM labels),
n AS (SELECT klass, count(*) FILTER (hit)+2 AS npos FROM s GROUP BY 1),
c AS (SELECT s.klass, npos, hit, row_number() OVER w AS seen, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS tp
 FROM s JOIN n ON s.klass=n.klass WINDOW w AS (PARTITION BY s.klass ORDER BY score DESC, id)),
e AS (SELECT klass, tp/npos AS recall, tp*100 AS t100, npos, max(tp/seen) OVER (PARTITION BY klass ORDER BY seen DESC) AS env FROM c),
g AS (SELECT klass, range AS r, (SELECT coalesce(max(env),0) FROM e WHERE e.klass=n.klass AND e.t100>=range*e.npos) AS p FROM n, range(101))
SELECT g.klass, round(avg(p),6) AS ap, (SELECT count(*) FROM s WHERE hit AND s.klass=g.klass) AS hits FROM g GROUP BY 1""")
def average_precision(spark, d):
    rows = X.table(spark, d, "labels").select(
        F.col("quality").alias("klass"), F.col("doc_id").alias("id"),
        (F.col("doc_id") * 7919 % 1000 / 1000).alias("score"),
        ((F.col("toxic") == 1) | (F.col("doc_id") % 3 == 0)).alias("hit"),
    )
    totals = rows.groupBy("klass").agg((F.count_if("hit") + 2).alias("npos"))
    return A.average_precision(rows.join(totals, "klass")).withColumn("ap", F.round("ap", 6))
