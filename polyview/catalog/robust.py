"""Queries for robust statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.ordered import BREAKS
from polyview.catalog.registry import query, r6
from polyview.operators import ordered as O
from polyview.operators import robust as R


@query("residual_summary", """SELECT event_type, count(*) AS n, min(value) AS low, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, max(value) AS high
FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*), min(value), round(quantile_cont(value,0.5),6), round(quantile_cont(value,0.95),6), max(value) FROM events""")
def residual_summary(spark, d):
    ev = X.table(spark, d, "events")
    cols = ["event_type", "n", "low", "p50", "p95", "high"]
    one = R.distribution(ev, ["event_type"], F.col("value")).select(*cols)
    all_ = R.distribution(ev, [], F.col("value")).withColumn("event_type", F.lit("all")).select(*cols)
    return one.union(all_).withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


GROUPS = """s AS (SELECT event_id, event_type, user_id%8 AS frame, value FROM events),
m AS (SELECT event_type, frame, quantile_cont(value,0.5) AS med FROM s GROUP BY 1,2),
f AS (SELECT s.*, value>1.1*med AS spill FROM s JOIN m ON s.event_type=m.event_type AND s.frame=m.frame)"""


def _groups(spark, d):
    return X.table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 8).alias("frame"), "value")


@query("spill_share", f"WITH {GROUPS} SELECT event_type, count(*) AS n, count(*) FILTER (spill) AS spilled, round(avg(CASE WHEN spill THEN 1.0 ELSE 0 END),6) AS share FROM f GROUP BY 1")
def spill_share(spark, d):
    out = R.spill_flags(_groups(spark, d), ["event_type", "frame"], "value")
    return out.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("spill").alias("spilled"), r6(F.avg(F.col("spill").cast("double")), "share")
    )


@query("spill_trim", f"""WITH {GROUPS}, g AS (SELECT event_type, frame, avg(CASE WHEN spill THEN 1.0 ELSE 0 END) AS sh FROM f GROUP BY 1,2)
SELECT event_id, f.event_type, f.frame, value FROM f JOIN g ON f.event_type=g.event_type AND f.frame=g.frame WHERE NOT spill OR sh>0.42""")
def spill_trim(spark, d):
    return R.spill_trim(_groups(spark, d), ["event_type", "frame"], "value", most=0.42)


@query("adaptive_threshold", """WITH t AS (SELECT least(greatest(1.05::DOUBLE,quantile_cont(value,0.4)),quantile_cont(value,0.9)) AS threshold FROM events)
SELECT event_id, value, round(threshold,6) AS threshold FROM events, t WHERE value>=threshold""")
def adaptive_threshold(spark, d):
    rows = X.table(spark, d, "events").select("event_id", "value")
    return R.adaptive_threshold(rows, "value").withColumn("threshold", F.round("threshold", 6))


@query("clipped_weight", """WITH m AS (SELECT quantile_cont(o_totalprice,0.5) AS med FROM orders)
SELECT o_orderkey, round(CASE WHEN med<=0 THEN CASE WHEN o_totalprice>0 THEN 1 ELSE 0.25 END ELSE least(1,greatest(0.25,o_totalprice/med)) END,6) AS weight FROM orders, m""")
def clipped_weight(spark, d):
    rows = X.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.clipped_weight(rows, "o_totalprice").select("o_orderkey", r6(F.col("weight"), "weight"))


Q3 = ", ".join(f"round(quantile_cont({a},{q}),6)+0.0 AS {a}_{n}" for a in "xyz" for q, n in ((0.01, "low"), (0.5, "mid"), (0.99, "high")))


@query("robust_bounds", f"WITH {X.PTS} SELECT {Q3} FROM pts")
def robust_bounds(spark, d):
    out = R.robust_bounds(X.points(spark, d), ["x", "y", "z"])
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query("weighted_quantile", """WITH r AS (SELECT l_suppkey AS pair, l_orderkey, l_linenumber, l_partkey, l_quantity AS d1, l_linenumber*6.5::DOUBLE AS d2, l_tax*10+0.1 AS c1, l_discount*10+0.05 AS c2 FROM lineitem),
m AS (SELECT pair, greatest(quantile_cont(c1,0.5)*0.1,quantile_cont(c2,0.5)*0.1,1e-6) AS lim FROM r GROUP BY 1),
g AS (SELECT r.*, pow(c1*c2,2) AS w, d1/(d2+1e-8) AS ratio FROM r JOIN m ON r.pair=m.pair WHERE c1>lim AND c2>lim AND d1>1e-3 AND d2>1e-3 AND d1<100 AND d2<100),
s AS (SELECT *, sum(w) OVER (PARTITION BY pair ORDER BY ratio,l_orderkey,l_linenumber,l_partkey,c1,c2 ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY pair)+1e-8 AS tot FROM g),
a AS (SELECT pair, count(*) AS n, min(ratio) FILTER (round(cum/tot,12)>=0.5) AS mid, min(ratio) FILTER (round(cum/tot,12)>=0.9) AS hi, -sum(w/tot*ln(w/tot+1e-8)) AS ent FROM s GROUP BY 1),
p AS (SELECT DISTINCT pair FROM r)
SELECT p.pair, coalesce(n,0) AS n, round(CASE WHEN coalesce(n,0)<100 THEN 1 WHEN coalesce(hi,mid,1)>0.1 AND coalesce(hi,mid,1)<10 THEN coalesce(hi,mid,1) ELSE 1 END,6) AS scale,
 round(CASE WHEN coalesce(n,0)<100 THEN 0 ELSE 1-ent/ln(n) END,6) AS quality FROM p LEFT JOIN a ON p.pair=a.pair""")
def weighted_quantile(spark, d):
    rows = X.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("pair"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("depth1"),
        (F.col("l_linenumber") * 6.5).alias("depth2"), (F.col("l_tax") * 10 + 0.1).alias("conf1"),
        (F.col("l_discount") * 10 + 0.05).alias("conf2"),
    )
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "conf1", "conf2")]
    return R.weighted_scale(rows, ["pair"], order).withColumns({c: F.round(c, 6) for c in ("scale", "quality")})


VOX = "CAST(floor(x/0.1) AS BIGINT) AS vx, CAST(floor(y/0.1) AS BIGINT) AS vy, CAST(floor(z/0.1) AS BIGINT) AS vz"


def voxels(df, size, names=("vx", "vy", "vz")):
    return df.withColumns({n: F.floor(F.col(c) / size) for n, c in zip(names, ("x", "y", "z"))})


@query("weighted_fusion", f"""WITH {X.PTS}, p AS (SELECT *, {VOX}, 0.01::DOUBLE+0.001::DOUBLE*frame AS sc FROM pts),
m AS (SELECT vx,vy,vz, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my, quantile_cont(z,0.5) AS mz, quantile_cont(sc,0.5) AS ms FROM p GROUP BY 1,2,3),
w AS (SELECT p.*, round(greatest(conf,1e-6)*least(1,ms/greatest(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)),1e-12)),12) AS w FROM p JOIN m ON p.vx=m.vx AND p.vy=m.vy AND p.vz=m.vz),
f AS (SELECT vx,vy,vz, count(*) AS support, sum(w*x)/sum(w) AS fx, sum(w*y)/sum(w) AS fy, sum(w*z)/sum(w) AS fz, sum(w*conf)/sum(w) AS confidence,
 arg_max(point_id,(w,-point_id)) AS primary_id FROM w GROUP BY 1,2,3)
SELECT f.vx, f.vy, f.vz, support, round(any_value(fx),6)+0.0 AS fx, round(any_value(fy),6)+0.0 AS fy, round(any_value(fz),6)+0.0 AS fz, round(any_value(confidence),6) AS confidence, any_value(primary_id) AS primary_id,
 round(max(sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)+(z-fz)*(z-fz))),6)+0.0 AS displacement FROM f JOIN p ON p.vx=f.vx AND p.vy=f.vy AND p.vz=f.vz GROUP BY f.vx,f.vy,f.vz,support""")
def weighted_fusion(spark, d):
    pts = voxels(X.points(spark, d), 0.1).withColumn("sc", 0.01 + 0.001 * F.col("frame"))
    out = R.weighted_fusion(pts, ["vx", "vy", "vz"], "sc", "conf", "point_id")
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("fx", "fy", "fz", "confidence", "displacement")})


QUAL = f"""{BREAKS}, bc AS (SELECT frame, "row", col FROM br WHERE broken UNION SELECT frame, "row", CAST(col+1 AS INTEGER) FROM br WHERE broken),
qa AS (SELECT g.frame, g."row", g.col, valid, ((frame*400+"row"*20+col)*7919%1000)/1000.0::DOUBLE AS conf, ((frame*400+"row"*20+col)*104729%1000)/1000.0::DOUBLE AS cosine,
 (frame, "row", col) IN (SELECT (frame, "row", col) FROM bc) AS edge,
 coalesce(valid AND lag(valid) OVER w AND lead(valid) OVER w AND abs(depth-lag(depth) OVER w)>greatest(0.02,0.005*depth) AND abs(lead(depth) OVER w-depth)>greatest(0.02,0.005*depth)
  AND sign(depth-lag(depth) OVER w)=sign(lead(depth) OVER w-depth),false) AS slope FROM grid g WINDOW w AS (PARTITION BY frame,"row" ORDER BY col)),
t AS (SELECT quantile_cont(conf,0.2) AS p20, quantile_cont(conf,0.4) AS p40 FROM qa WHERE valid),
k AS (SELECT qa.*, valid AND conf<p20 AS low_confidence, valid AND edge AND conf<p40 AS edge_confidence, valid AND cosine<0.15 AS grazing, valid AND slope AS mid_slope FROM qa, t),
dr AS (SELECT *, low_confidence OR edge_confidence OR grazing OR mid_slope AS dropped FROM k)"""


def _quality(spark, d):
    from polyview.plans.scan import along, lagged, leading

    g = X.grid(spark, d)
    gaps = O.depth_breaks(g, ["frame", "row"], "col", 0.01).filter("broken")
    edges = gaps.select("frame", "row", "col").union(gaps.select("frame", "row", (F.col("col") + 1).cast("int"))).distinct()
    step = along(g, ["frame", "row"], [F.col("col")], {
        "pd": lagged(F.col("depth")), "nd": leading(F.col("depth")), "pv": lagged(F.col("valid")), "nv": leading(F.col("valid")),
    })
    tol = F.greatest(F.lit(0.02), 0.005 * F.col("depth"))
    dl, dr = F.col("depth") - F.col("pd"), F.col("nd") - F.col("depth")
    slope = F.coalesce(
        F.col("valid") & F.col("pv") & F.col("nv") & (F.abs(dl) > tol) & (F.abs(dr) > tol) & (F.signum(dl) == F.signum(dr)), F.lit(False)
    )
    i = F.col("frame").cast("long") * 400 + F.col("row") * 20 + F.col("col")
    rows = step.join(edges.withColumn("e", F.lit(True)), ["frame", "row", "col"], "left").select(
        "frame", "row", "col", "valid", (i * 7919 % 1000 / 1000).alias("conf"), (i * 104729 % 1000 / 1000).alias("cosine"),
        F.coalesce("e", F.lit(False)).alias("edge"), slope.alias("slope"),
    )
    return R.quality_rules(rows)


@query("quality_rules", f"""WITH {QUAL} SELECT count(*) FILTER (low_confidence) AS low_confidence, count(*) FILTER (edge_confidence) AS edge_confidence,
 count(*) FILTER (grazing) AS grazing, count(*) FILTER (mid_slope) AS mid_slope, count(*) FILTER (dropped) AS "drop" FROM dr""")
def quality_rules(spark, d):
    return R.rule_counts(_quality(spark, d))


@query("quality_keep", f"""WITH {QUAL}, l AS (SELECT *, "row"//3 AS label FROM dr WHERE valid), s AS (SELECT label, avg(CASE WHEN dropped THEN 0.0 ELSE 1 END) AS kept FROM l GROUP BY 1)
SELECT l.frame, l."row", l.col, CAST(l.label AS INTEGER) AS label FROM l JOIN s ON l.label=s.label WHERE NOT dropped OR kept<0.5""")
def quality_keep(spark, d):
    marked = _quality(spark, d).filter("valid").withColumn("label", F.floor(F.col("row") / 3).cast("int"))
    return R.retained(marked, "label").select("frame", "row", "col", "label")


@query("leave_one_out", """WITH p AS (SELECT l_suppkey AS g, l_linenumber AS o, count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1,2),
x AS (SELECT a.g, a.o, sum(b.n) AS rem, sum(b.s)/sum(b.n) AS mean, max(b.hi)-min(b.lo) AS ext FROM p a LEFT JOIN p b ON a.g=b.g AND a.o<>b.o GROUP BY 1,2),
f AS (SELECT g, sum(s)/sum(n) AS mean, max(hi)-min(lo) AS ext FROM p GROUP BY 1)
SELECT x.g AS l_suppkey, x.o AS l_linenumber, CAST(coalesce(rem,0) AS BIGINT) AS remaining, CASE WHEN coalesce(rem,0)<32 THEN 'insufficient' WHEN rem<64 THEN 'weak' ELSE 'available' END AS status,
 round(x.mean,6) AS mean, round(x.mean-f.mean,6)+0.0 AS mean_delta, round(x.ext-f.ext,6)+0.0 AS extent_delta FROM x JOIN f ON x.g=f.g""")
def leave_one_out(spark, d):
    out = R.leave_one_out(X.table(spark, d, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity")
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("mean", "mean_delta", "extent_delta")})


GATES = """s AS (SELECT s_suppkey, count(l_orderkey) AS n, avg(l_quantity) AS q, max(s_acctbal) AS bal FROM supplier LEFT JOIN lineitem ON l_suppkey=s_suppkey GROUP BY 1),
g AS (SELECT *, n>=600 AS a, coalesce(q>=25.4,false) AS b, bal>0 AS c FROM s),
h AS (SELECT s_suppkey, round(CAST(a AS INTEGER)+CAST(b AS INTEGER)+CAST(c AS INTEGER)+least(1,greatest(0,bal/10000))*0.01+least(1,n/1000)*0.001,9) AS score, a AND b AND c AS eligible,
 concat_ws(',', CASE WHEN NOT a THEN 'rows' END, CASE WHEN NOT b THEN 'quantity' END, CASE WHEN NOT c THEN 'balance' END) AS failed FROM g),
gt AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY score DESC, s_suppkey) END AS rank FROM h)"""


@query("gated_choice", f"""WITH {GATES}, n AS (SELECT *, CASE WHEN s_suppkey%3=0 THEN [1.0,0.0,0.0] WHEN s_suppkey%3=1 THEN [0.0,0.6,0.8] ELSE [0.0,0.8,0.6] END AS v FROM gt WHERE eligible),
b AS (SELECT * FROM n WHERE rank=1)
SELECT b.s_suppkey, coalesce(bool_or(n.s_suppkey<>b.s_suppkey AND abs(list_inner_product(n.v,b.v))<0.95 AND n.score>=0.95*b.score), false) AS ambiguous,
 count(*) FILTER (n.s_suppkey<>b.s_suppkey AND abs(list_inner_product(n.v,b.v))<0.95 AND n.score>=0.95*b.score) AS rivals FROM n, b GROUP BY 1""")
def gated_choice(spark, d):
    side = F.col("s_suppkey") % 3
    pick = lambda *v: F.when(side == 0, v[0]).when(side == 1, v[1]).otherwise(v[2])
    normals = {"nx": pick(1.0, 0.0, 0.0), "ny": pick(0.0, 0.6, 0.8), "nz": pick(0.0, 0.8, 0.6)}
    return R.gated_choice(gate_table(spark, d).withColumns(normals), "s_suppkey", list(normals))


@query("gate_table", f"WITH {GATES} SELECT * FROM gt")
def gate_table(spark, d):
    lines = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("l_orderkey").alias("n"), F.avg("l_quantity").alias("q")
    )
    rows = X.table(spark, d, "supplier").join(lines, "s_suppkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gates = {"rows": F.col("n") >= 600, "quantity": F.col("q") >= 25.4, "balance": F.col("s_acctbal") > 0}
    ties = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 10000)) * 0.01, F.least(F.lit(1.0), F.col("n") / 1000) * 0.001]
    return R.gate_table(rows, "s_suppkey", gates, ties)


@query("cell_spread", f"""WITH {X.PTS}, c AS (SELECT frame, CAST(floor(x/0.2) AS BIGINT) AS cx, CAST(floor(y/0.2) AS BIGINT) AS cy, z, conf FROM pts),
ref AS (SELECT DISTINCT cx, cy FROM c WHERE conf>1), s AS (SELECT frame, c.cx, c.cy, count(*) AS "rows", quantile_cont(z,0.9)-quantile_cont(z,0.1) AS spread
 FROM c SEMI JOIN ref ON c.cx=ref.cx AND c.cy=ref.cy GROUP BY 1,2,3 HAVING count(*)>=3), k AS (SELECT cx, cy FROM s GROUP BY 1,2 HAVING count(*)=8)
SELECT frame, s.cx, s.cy, "rows", round(spread,6) AS spread FROM s JOIN k ON s.cx=k.cx AND s.cy=k.cy""")
def cell_spread(spark, d):
    cells = X.points(spark, d).select("frame", F.floor(F.col("x") / 0.2).alias("cx"), F.floor(F.col("y") / 0.2).alias("cy"), "z", "conf")
    out = R.cell_spread(cells, "frame", ["cx", "cy"], "z", cells.filter("conf > 1"))
    return out.withColumn("spread", F.round("spread", 6))


@query("depth_agreement", f"""WITH {X.GRID}, w AS (SELECT frame, "row", col, depth+(col%5-2)*0.015 AS drawn FROM grid WHERE (frame+"row"+col)%6<>0),
j AS (SELECT g.frame, depth, valid, drawn, greatest(0.02,0.005*depth) AS tol FROM grid g LEFT JOIN w ON g.frame=w.frame AND g."row"=w."row" AND g.col=w.col),
a AS (SELECT frame, count(*) FILTER (valid) AS valid, count(*) FILTER (valid AND abs(drawn-depth)<=tol) AS matched, count(*) FILTER (valid AND drawn-depth < -tol) AS nearer,
 count(*) FILTER (valid AND drawn-depth>tol) AS farther, count(*) FILTER (valid AND drawn IS NULL) AS missing, count(*) FILTER (NOT valid AND drawn IS NOT NULL) AS outside,
 count(*) FILTER (NOT valid) AS invalid FROM j GROUP BY ROLLUP(frame))
SELECT *, round(matched/greatest(valid,1),6) AS matched_share, round(missing/greatest(valid,1),6) AS missing_share, round(outside/greatest(invalid,1),6) AS outside_share FROM a""")
def depth_agreement(spark, d):
    g = X.grid(spark, d)
    drawn = g.filter((F.col("frame") + F.col("row") + F.col("col")) % 6 != 0).select(
        "frame", "row", "col", (F.col("depth") + (F.col("col") % 5 - 2) * 0.015).alias("drawn")
    )
    out = R.depth_agreement(g, drawn, ["frame", "row", "col"], 0.01)
    return out.withColumns({c: F.round(c, 6) for c in ("matched_share", "missing_share", "outside_share")})
