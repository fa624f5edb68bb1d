"""Queries for detection and tracking evaluation, filters and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.boxes import IOU
from polyview.catalog.registry import GREEDY, query, r6
from polyview.operators import evaluation as E
from polyview.streaming.hooks import score_batches

ALIGN = f"""{X.TRACK}, sg AS (SELECT *, sum(sim) OVER (PARTITION BY seq,t,gt_id)+sum(sim) OVER (PARTITION BY seq,t,trk_id)-sim AS rest FROM trk),
pt AS (SELECT seq, gt_id, trk_id, sum(CASE WHEN rest>2.2e-16 THEN sim/rest ELSE 0 END) AS p FROM sg GROUP BY 1,2,3),
gts AS (SELECT DISTINCT seq, t, gt_id FROM trk), tks AS (SELECT DISTINCT seq, t, trk_id FROM trk),
gc AS (SELECT seq, gt_id, count(*) AS gc FROM gts GROUP BY 1,2), kc AS (SELECT seq, trk_id, count(*) AS kc FROM tks GROUP BY 1,2),
al AS (SELECT trk.*, gc, kc, round(p/(gc+kc-p)*sim,9) AS score FROM trk JOIN pt USING (seq,gt_id,trk_id) JOIN gc USING (seq,gt_id) JOIN kc USING (seq,trk_id)),
ls AS (SELECT seq, t, list({{'g':gt_id,'k':trk_id,'s':sim}} ORDER BY score DESC, gt_id, trk_id) AS es FROM al WHERE score>0 GROUP BY 1,2),
mt AS (SELECT seq, t, unnest({GREEDY}) AS m FROM ls),
ma AS (SELECT mt.seq, mt.t, m.g AS gt_id, m.k AS trk_id, m.s AS sim, gc, kc FROM mt JOIN gc ON mt.seq=gc.seq AND m.g=gc.gt_id JOIN kc ON mt.seq=kc.seq AND m.k=kc.trk_id),
av AS (SELECT round(0.05*(range+1),2)::DOUBLE AS alpha FROM range(19)),
ht AS (SELECT ma.*, alpha FROM ma JOIN av ON sim>=alpha-2.2e-16),
ac AS (SELECT seq, alpha, gt_id, trk_id, gc, kc, count(*) AS m FROM ht GROUP BY ALL)"""


def _tracks(spark, d):
    sim = X.tracks(spark, d)
    return sim, sim.select("seq", "t", "gt_id").distinct(), sim.select("seq", "t", "trk_id").distinct()


HFIN = """tp, fn, fp, round(greatest(1e-10,loc)/greatest(1e-10,tp),12) AS loc_a, round(ass/greatest(1,tp),12) AS ass_a, round(re/greatest(1,tp),12) AS ass_re, round(pr/greatest(1,tp),12) AS ass_pr,
 round(tp/greatest(1,tp+fn+fp),12) AS det_a, round(sqrt(tp/greatest(1,tp+fn+fp)*ass/greatest(1,tp)),12) AS hota, round(sqrt(tp/greatest(1,tp+fn)*ass/greatest(1,tp)),12) AS owta"""
HOTA = f"""{ALIGN}, aa AS (SELECT seq, alpha, sum(m*m/greatest(1,gc+kc-m)) AS ass, sum(m*m/greatest(1,gc)) AS re, sum(m*m/greatest(1,kc)) AS pr FROM ac GROUP BY 1,2),
tt AS (SELECT seq, alpha, count(*) AS tp, sum(sim) AS loc FROM ht GROUP BY 1,2), ng AS (SELECT seq, count(*) AS g FROM gts GROUP BY 1), nk AS (SELECT seq, count(*) AS k FROM tks GROUP BY 1),
ss AS (SELECT ng.seq, av.alpha, coalesce(tp,0) AS tp, g-coalesce(tp,0) AS fn, k-coalesce(tp,0) AS fp, coalesce(loc,0) AS loc, coalesce(ass,0) AS ass, coalesce(re,0) AS re, coalesce(pr,0) AS pr
 FROM ng JOIN nk ON ng.seq=nk.seq CROSS JOIN av LEFT JOIN tt ON tt.seq=ng.seq AND tt.alpha=av.alpha LEFT JOIN aa ON aa.seq=ng.seq AND aa.alpha=av.alpha)"""
HCOLS = ["loc_a", "ass_a", "ass_re", "ass_pr", "det_a", "hota", "owta"]


@query("hota", f"""WITH {HOTA}, cb AS (SELECT alpha, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, sum(loc) AS loc, sum(ass) AS ass, sum(re) AS re, sum(pr) AS pr FROM ss GROUP BY 1)
SELECT alpha, {HFIN} FROM cb""")
def hota(spark, d):
    _, combined = E.hota(*_tracks(spark, d))
    return combined.withColumns({c: F.round(c, 12) for c in HCOLS})


@query("hota_per_sequence", f"WITH {HOTA} SELECT seq, alpha, {HFIN} FROM ss")
def hota_per_sequence(spark, d):
    per, _ = E.hota(*_tracks(spark, d))
    return per.withColumns({c: F.round(c, 12) for c in HCOLS})


@query("teta", f"""WITH {ALIGN}, hc AS (SELECT *, length(gt_id)%3=trk_id%3 AS same FROM ht), tt AS (SELECT alpha, count(*) AS tp, count(*) FILTER (same) AS cls_tp FROM hc GROUP BY 1),
nr AS (SELECT DISTINCT seq, t, trk_id FROM trk WHERE sim>=0.5), cl AS (SELECT alpha, count(*) AS claimed FROM ht SEMI JOIN nr ON ht.seq=nr.seq AND ht.t=nr.t AND ht.trk_id=nr.trk_id GROUP BY 1),
aa AS (SELECT alpha, sum(m*m/greatest(1,gc+kc-m)) AS ass FROM ac GROUP BY 1),
ss AS (SELECT av.alpha, coalesce(tp,0) AS tp, (SELECT count(*) FROM gts)-coalesce(tp,0) AS fn, (SELECT count(*) FROM nr)-coalesce(claimed,0) AS fp, coalesce(cls_tp,0) AS cls_tp, coalesce(ass,0) AS ass
 FROM av LEFT JOIN tt ON tt.alpha=av.alpha LEFT JOIN cl ON cl.alpha=av.alpha LEFT JOIN aa ON aa.alpha=av.alpha),
ff AS (SELECT *, tp/greatest(1,tp+fn+fp) AS loc, ass/greatest(1,tp) AS asc_, CASE WHEN alpha>=0.5 THEN cls_tp/greatest(1,tp) END AS cls FROM ss)
SELECT alpha, tp, fn, fp, cls_tp, round(loc,6) AS loc_a, round(asc_,6) AS assoc_a, round(cls,6) AS cls_a, round((loc+asc_+coalesce(cls,0))/3,6) AS teta FROM ff""")
def teta(spark, d):
    sim, gt, trk = _tracks(spark, d)
    classed = sim.withColumns({"gt_class": F.length("gt_id") % 3, "trk_class": F.col("trk_id") % 3})
    out = E.teta(classed, gt, trk)
    return out.withColumns({c: F.round(c, 6) for c in ("loc_a", "assoc_a", "cls_a", "teta")})


@query("eval_prefilter", f"""WITH {X.TRACK}, k AS (SELECT seq, t, gt_id, trk_id, sim, CAST(trk_id%2 AS INTEGER) AS klass FROM trk), st AS (SELECT * FROM k WHERE sim>=0.5-2.2e-16 AND length(gt_id)%2=klass),
ls AS (SELECT seq, t, list({{'g':gt_id,'k':trk_id,'s':sim}} ORDER BY round(sim,9) DESC, gt_id, trk_id) AS es FROM st GROUP BY 1,2), mt AS (SELECT seq, t, unnest({GREEDY}) AS m FROM ls),
tk AS (SELECT DISTINCT seq, t, klass, trk_id FROM k), hg AS (SELECT DISTINCT seq, t, CAST(length(gt_id)%2 AS INTEGER) AS klass FROM trk)
SELECT tk.* FROM tk LEFT JOIN mt ON mt.seq=tk.seq AND mt.t=tk.t AND m.k=tk.trk_id LEFT JOIN hg ON hg.seq=tk.seq AND hg.t=tk.t AND hg.klass=tk.klass
WHERE m IS NOT NULL OR NOT (CASE WHEN hg.seq IS NULL AND tk.seq%3<>0 THEN true ELSE tk.seq%4=1 END)""")
def eval_prefilter(spark, d):
    sim, _, _ = _tracks(spark, d)
    side = (F.length("gt_id") % 2).cast("int")
    keyed = sim.withColumn("klass", (F.col("trk_id") % 2).cast("int"))
    gt = sim.select("seq", "t", side.alias("klass"), "gt_id").distinct()
    trk = keyed.select("seq", "t", "klass", "trk_id").distinct()
    seqs = sim.select("seq").distinct().withColumn("klass", F.explode(F.array(F.lit(0), F.lit(1))))
    rules = seqs.withColumns({"negative": F.col("seq") % 3 == 0, "exhaustive": F.col("seq") % 4 != 1})
    return E.eval_prefilter(keyed.filter(side == F.col("klass")), gt, trk, rules)


GF = f"""{X.DET}, g AS (SELECT * FROM det WHERE l_returnflag='R'), p AS (SELECT * FROM det WHERE l_returnflag<>'R'),
pr AS (SELECT a.image_id, a.object_id AS gg, b.object_id AS kk, round({IOU},9) AS iou FROM g a JOIN p b ON a.image_id=b.image_id),
ls AS (SELECT image_id, list({{'g':gg,'k':kk,'s':iou}} ORDER BY iou DESC, gg, kk) AS es FROM pr WHERE iou>0 GROUP BY 1), mt AS (SELECT image_id, unnest({GREEDY}) AS m FROM ls),
th AS (SELECT unnest([0.1,0.2,0.3])::DOUBLE AS thr), sz AS (SELECT o_orderkey AS image_id, (SELECT count(*) FROM g WHERE g.image_id=o_orderkey) AS ng, (SELECT count(*) FROM p WHERE p.image_id=o_orderkey) AS nd FROM orders),
tp AS (SELECT image_id, thr, count(*) AS tp FROM mt JOIN th ON m.s>=thr GROUP BY 1,2),
pe AS (SELECT sz.image_id, th.thr, ng, nd, coalesce(tp,0) AS tp FROM sz CROSS JOIN th LEFT JOIN tp ON tp.image_id=sz.image_id AND tp.thr=th.thr),
lo AS (SELECT *, tp/(nd+1e-4) AS lp, tp/(ng+1e-4) AS lr FROM pe),
su AS (SELECT thr, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(nd-tp) AS BIGINT) AS fp, CAST(sum(ng-tp) AS BIGINT) AS fn, sum(CASE WHEN ng>0 THEN nd-tp ELSE 0 END) AS pfp,
 sum(CASE WHEN ng>0 THEN 2*lp*lr/(lp+lr+1e-4) ELSE 0 END) AS lf, count(*) FILTER (ng>0 AND nd>0) AS il_tp, count(*) FILTER (ng=0 AND nd>0) AS il_fp, count(*) FILTER (ng>0 AND nd=0) AS il_fn, count(*) FILTER (ng=0 AND nd=0) AS il_tn FROM lo GROUP BY 1),
fi AS (SELECT *, tp/(tp+fp+1e-4) AS pc, tp/(tp+fn+1e-4) AS rc, tp/(tp+pfp+1e-4) AS pp, il_tp/(il_tp+il_fn+1e-6) AS ir, il_tp/(il_tp+il_fp+1e-6) AS ip,
 (il_tp::DOUBLE*il_tn-il_fp::DOUBLE*il_fn)/(sqrt((il_tp+il_fp)::DOUBLE*(il_tp+il_fn)*(il_tn+il_fp)*(il_tn+il_fn))+1e-6) AS mcc FROM su)
SELECT thr, tp, fp, fn, il_tp, il_fp, il_fn, il_tn, round(pc,6) AS "precision", round(rc,6) AS recall, round(2*pc*rc/(pc+rc+1e-4),6) AS f1, round(2*pp*rc/(pp+rc+1e-4),6) AS positive_micro_f1,
 round(coalesce(lf/nullif(il_tp,0),0),6) AS positive_macro_f1, round(2*ip*ir/(ip+ir+1e-6),6) AS il_f1, round(il_fp/(il_fp+il_tn+1e-6),6) AS il_fpr, round(mcc,6)+0.0 AS il_mcc, round(2*pp*rc/(pp+rc+1e-4)*mcc,6)+0.0 AS cg_f1 FROM fi"""


@query("gated_f1", f"WITH {GF}")
def gated_f1(spark, d):
    det = X.detections(spark, d, "l_returnflag")
    images = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    out = E.gated_f1(images, det.filter("l_returnflag = 'R'"), det.filter("l_returnflag <> 'R'"), [0.1, 0.2, 0.3])
    counts = ("thr", "tp", "fp", "fn", "il_tp", "il_fp", "il_fn", "il_tn")
    return out.select(*counts, *[r6(F.col(c), c) for c in out.columns if c not in counts])


@query("annotation_filters", f"""WITH {X.DET}, t AS (SELECT image_id AS q, CASE WHEN l_quantity=50 THEN x1 ELSE x2 END-x1 AS w, y2-y1 AS h, l_returnflag='A' AS crowd FROM det),
o AS (SELECT q, count(*) FILTER (NOT crowd AND w*h>=1e-6) AS outputs, bool_or(w*h<=0) AS flat FROM t GROUP BY 1),
g AS (SELECT o_orderkey AS query_id, o_custkey AS image_id, coalesce(outputs,0) AS outputs FROM orders LEFT JOIN o ON q=o_orderkey
 WHERE o_orderpriority NOT IN ('1-URGENT') AND o_orderstatus<>'P' AND NOT coalesce(flat,false) AND coalesce(outputs,0)<=3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY outputs>0 DESC, sha256(concat('42:',CAST(query_id AS VARCHAR))), query_id) AS INTEGER) AS pos FROM g) WHERE pos<=2""")
def annotation_filters(spark, d):
    det = X.detections(spark, d, "l_quantity", "l_returnflag")
    targets = det.select(
        F.col("image_id").alias("query_id"), "x1", "y1", F.when(F.col("l_quantity") == 50, F.col("x1")).otherwise(F.col("x2")).alias("x2"), "y2",
        (F.col("l_returnflag") == "A").alias("crowd"),
    )
    queries = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("image_id"), F.col("o_orderpriority").alias("text"),
        (F.col("o_orderstatus") != "P").alias("exhaustive"),
    )
    return E.filter_queries(queries, targets, ["1-URGENT"], 3, 2).select("query_id", "image_id", "outputs", "pos")


@query("batch_scorer", """SELECT doc_id, CASE WHEN text IS NULL OR text='' THEN 'unavailable' WHEN length(text)>1000 THEN 'long' ELSE 'short' END AS label,
 CASE WHEN text IS NULL OR text='' THEN NULL ELSE round(least(1,length(text)/5000),6) END AS confidence FROM documents""")
def batch_scorer(spark, d):
    def predict(texts):
        return [("long" if len(t) > 1000 else "short", min(1.0, len(t) / 5000)) for t in texts]

    docs = X.table(spark, d, "documents").select("doc_id", "text")
    return score_batches(docs, "doc_id", "text", predict).withColumn("confidence", F.round("confidence", 6))


@query("duplicate_ids", "SELECT user_id, event_type FROM events GROUP BY 1,2 HAVING count(*)>1")
def duplicate_ids(spark, d):
    return E.duplicate_ids(X.table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("class_mean", f"""WITH {HOTA}, pf AS (SELECT seq, alpha, {HFIN} FROM ss) SELECT alpha, round(avg(hota),9) AS hota, round(avg(det_a),9) AS det_a, round(avg(ass_a),9) AS ass_a FROM pf GROUP BY 1""")
def class_mean(spark, d):
    per, _ = E.hota(*_tracks(spark, d))
    fields = ["hota", "det_a", "ass_a"]
    return E.class_mean(per, ["alpha"], fields).withColumns({c: F.round(c, 9) for c in fields})


@query("wrong_class_hits", f"""WITH {ALIGN} SELECT alpha, CAST(trk_id%3 AS BIGINT) AS trk_class, count(*) AS cls_fp FROM ht WHERE length(gt_id)%3<>trk_id%3 GROUP BY 1,2""")
def wrong_class_hits(spark, d):
    sim, gt, trk = _tracks(spark, d)
    aligned = E.alignment(sim, gt, trk)
    hit = E._by_alpha(E.step_matches(aligned, F.col("align") * F.col("sim")))
    classed = hit.withColumns({"gt_class": F.length("gt_id") % 3, "trk_class": (F.col("trk_id") % 3).cast("long")})
    return E.wrong_class_hits(classed)
