"""Queries for ordered lookups, intervals, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.registry import query, r6
from polyview.operators import ordered as O
from polyview.operators import sampling as S
from polyview.plans.scan import along, number


@query("avg_rank_pct", """SELECT c_custkey, round((rank() OVER (ORDER BY b)+(count(*) OVER (PARTITION BY b)-1)/2.0::DOUBLE-1)/(count(*) OVER ()-1),6) AS rank_pct
FROM (SELECT c_custkey, floor(c_acctbal/10) AS b FROM customer)""")
def avg_rank_pct(spark, d):
    rows = X.table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 10).alias("b"))
    return O.average_rank(rows, "b").select("c_custkey", r6(F.col("rank_pct"), "rank_pct"))


BREAKS = f"""{X.GRID}, g AS (SELECT frame, "row", col, valid, depth, lead(depth) OVER w AS d2, lead(valid) OVER w AS v2 FROM grid
 WINDOW w AS (PARTITION BY frame, "row" ORDER BY col)),
p AS (SELECT *, CASE WHEN valid AND v2 THEN abs(d2-depth) END AS diff FROM g WHERE v2 IS NOT NULL),
q AS (SELECT *, lag(diff) OVER w AS pd, lead(diff) OVER w AS nd FROM p WINDOW w AS (PARTITION BY frame, "row" ORDER BY col)),
br AS (SELECT frame, "row", col, NOT (valid AND v2) OR coalesce(diff > greatest(0.02,0.005*least(depth,d2))+3*coalesce(least(pd,nd),0),false) AS broken FROM q)"""


def _breaks(spark, d):
    return O.depth_breaks(X.grid(spark, d), ["frame", "row"], "col", 0.01)


@query("depth_breaks", f"WITH {BREAKS} SELECT * FROM br")
def depth_breaks(spark, d):
    return _breaks(spark, d)


@query("break_distance", f"""WITH {BREAKS}, px AS (SELECT frame, "row", col, max(col) OVER (PARTITION BY frame, "row") AS last FROM grid),
s AS (SELECT p.frame, p."row", p.col, last, max(CASE WHEN broken AND b.col<p.col THEN b.col+0.5 END) AS l,
 min(CASE WHEN broken AND b.col>=p.col THEN b.col+0.5 END) AS r FROM px p JOIN br b ON p.frame=b.frame AND p."row"=b."row" GROUP BY ALL)
SELECT frame, "row", col, round(least(8.0::DOUBLE,greatest(0.5::DOUBLE,least(col-coalesce(l,0),coalesce(r,last)-col)*(0.95::DOUBLE/1.05::DOUBLE))),6) AS cap FROM s""")
def break_distance(spark, d):
    return O.break_distance(_breaks(spark, d), ["frame", "row"], "col").withColumn("cap", F.round("cap", 6))


@query("merge_intervals", """WITH r AS (SELECT o_orderpriority AS k, CAST(date_diff('day',DATE '1990-01-01',CAST(o_orderdate AS DATE)) AS BIGINT) AS s, o_orderkey%3 AS len, o_custkey%40 AS c FROM orders),
i AS (SELECT DISTINCT k, c, s AS "start", s+len AS "end" FROM r WHERE len>0),
m AS (SELECT *, max("end") OVER (PARTITION BY k, c ORDER BY "start","end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start">reach THEN 1 ELSE 0 END) OVER (PARTITION BY k, c ORDER BY "start","end" ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT k, c, min("start") AS "start", max("end") AS "end" FROM g GROUP BY k, c, isl""")
def merge_intervals(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = X.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 40).alias("c"), day.alias("start"),
        (day + F.col("o_orderkey") % 3).alias("end"),
    )
    return O.merge_intervals(rows, ["k", "c"], "start", "end")


@query("visibility_delta", """WITH b AS (SELECT o_orderkey FROM orders WHERE o_orderstatus<>'F'), a AS (SELECT o_orderkey FROM orders WHERE o_orderkey%3<>0),
c AS (SELECT coalesce(a.o_orderkey,b.o_orderkey) AS id, CAST(CASE WHEN a.o_orderkey IS NULL THEN 0 ELSE 1 END AS INTEGER) AS visible FROM b FULL JOIN a ON a.o_orderkey=b.o_orderkey
 WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL),
i AS (SELECT visible, id*2 AS s, id*2+1+id%2 AS e FROM c),
m AS (SELECT *, max(e) OVER (PARTITION BY visible ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s>reach THEN 1 ELSE 0 END) OVER (PARTITION BY visible ORDER BY s ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT visible, min(s) AS "start", max(e) AS "end" FROM g GROUP BY visible, isl""")
def visibility_delta(spark, d):
    o = X.table(spark, d, "orders")
    k = F.col("o_orderkey")
    ranges = o.select(k, (k * 2).alias("start"), (k * 2 + 1 + k % 2).alias("end"))
    return O.visibility_delta(o.filter("o_orderstatus <> 'F'").select(k), o.filter(k % 3 != 0).select(k), ranges, "o_orderkey")


@query("id_navigation", """SELECT o_orderkey, lag(o_orderkey) OVER w AS previous_id, lead(o_orderkey) OVER w AS next_id
FROM orders WHERE o_orderstatus='O' WINDOW w AS (ORDER BY o_orderkey)""")
def id_navigation(spark, d):
    rows = X.table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    return O.neighbours(rows, "o_orderkey")


@query("interval_lookup", """WITH iv AS (SELECT o_orderkey*3 AS s, o_orderkey*3+o_orderkey%4 AS e, o_custkey AS owner FROM orders WHERE o_orderkey%4<>0)
SELECT event_id, event_id*4+1 AS at, owner FROM events LEFT JOIN iv ON event_id*4+1>=s AND event_id*4+1<e""")
def interval_lookup(spark, d):
    k = F.col("o_orderkey")
    iv = X.table(spark, d, "orders").filter(k % 4 != 0).select(
        (k * 3).alias("start"), (k * 3 + k % 4).alias("end"), F.col("o_custkey").alias("owner")
    )
    pts = X.table(spark, d, "events").select("event_id", (F.col("event_id") * 4 + 1).alias("at"))
    return O.interval_lookup(pts, "at", iv, "owner")


@query("nearest_second", """WITH e AS (SELECT epoch_us(ts)/1e6 AS t, min(event_id) AS event_id FROM events GROUP BY 1),
b AS (SELECT min(t) AS t0, max(t) AS t1 FROM e), s AS (SELECT range AS second, t0+range*3600.0::DOUBLE AS p FROM b, range(100000) WHERE range<=floor((t1-t0)/3600)),
x AS (SELECT second, p, (SELECT max(t) FROM e WHERE t<=p) AS pt, (SELECT min(t) FROM e WHERE t>=p) AS nt FROM s),
y AS (SELECT second, CASE WHEN nt IS NULL OR p-pt<=nt-p THEN pt ELSE nt END AS t, least(p-pt,coalesce(nt-p,p-pt)) AS gap FROM x)
SELECT second, event_id, round(gap,5)+0.0 AS gap FROM y JOIN e ON y.t=e.t""")
def nearest_second(spark, d):
    rows = X.table(spark, d, "events").select(
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    )
    return O.nearest_second(rows, "t", "event_id", 3600.0).select("second", "event_id", r6(F.col("gap"), "gap", 5))


@query("frame_alignment", """WITH a AS (SELECT o_orderkey AS id, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_orderkey+5 AS id, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT a.n AS na, b.n AS nb FROM a FULL JOIN b ON a.id=b.id)
SELECT CAST(coalesce(sum(na),0) AS BIGINT) AS a_rows, CAST(coalesce(sum(nb),0) AS BIGINT) AS b_rows, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS common,
 count(*) FILTER (nb IS NULL) AS a_only, count(*) FILTER (na IS NULL) AS b_only,
 round(count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL)/greatest(count(na),count(nb)),6) AS coverage,
 count(*) FILTER (na IS NULL OR nb IS NULL)=0 AS aligned FROM j""")
def frame_alignment(spark, d):
    a = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    b = X.table(spark, d, "lineitem").select((F.col("l_orderkey") + 5).alias("id"))
    return O.frame_alignment(a, b, "id").withColumn("coverage", F.round("coverage", 6))


@query("pair_plan", f"""WITH {X.FRAMES}, n AS (SELECT *, CAST(count(*) OVER (PARTITION BY video) AS INTEGER) AS n FROM frames)
SELECT 'next' AS mode, video, idx AS i, CASE WHEN idx+1<n THEN idx+1 ELSE 0 END AS j FROM n WHERE n>1
UNION ALL SELECT 'window', a.video, a.idx, b.idx FROM n a JOIN n b ON a.video=b.video AND b.idx>a.idx AND b.idx<=a.idx+3""")
def pair_plan(spark, d):
    fr = X.frames(spark, d).select("video", "idx")
    named = lambda m, w=1: O.frame_pairs(fr, ["video"], "idx", m, w).select(F.lit(m).alias("mode"), "*")
    return named("next").union(named("window", 3))


@query("first_source_union", """WITH s AS (SELECT event_id, user_id, event_type, event_id%3 AS shard FROM events),
f AS (SELECT user_id, event_type, min(shard) AS shard FROM s GROUP BY 1,2)
SELECT s.* FROM s JOIN f ON s.user_id=f.user_id AND s.event_type=f.event_type AND s.shard=f.shard""")
def first_source_union(spark, d):
    rows = X.table(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 3).alias("shard"))
    return O.first_source_wins(rows, ["user_id", "event_type"], "shard")


@query("dense_pair_ids", """SELECT l_partkey, l_suppkey, row_number() OVER (ORDER BY l_partkey, l_suppkey) AS pair_id FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def dense_pair_ids(spark, d):
    rows = X.table(spark, d, "lineitem")
    return O.dense_pair_ids(
        [rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'")], ["l_partkey", "l_suppkey"]
    )


@query("record_overlap", """WITH a AS (SELECT DISTINCT l_partkey, l_quantity FROM lineitem WHERE l_linestatus='O'), b AS (SELECT DISTINCT l_partkey, l_quantity FROM lineitem WHERE l_linestatus='F'),
c AS (SELECT count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)), x AS (SELECT count(*) AS n FROM a), y AS (SELECT count(*) AS n FROM b)
SELECT x.n AS a_records, y.n AS b_records, c.n AS common, x.n-c.n AS a_only, y.n-c.n AS b_only, round(c.n/x.n,6) AS overlap FROM c, x, y""")
def record_overlap(spark, d):
    rows = X.table(spark, d, "lineitem")
    cut = lambda s: rows.filter(F.col("l_linestatus") == s).select("l_partkey", "l_quantity")
    return O.record_overlap(cut("O"), cut("F")).withColumn("overlap", F.round("overlap", 6))


@query("track_id_repair", f"""WITH {X.TRACK}, p AS (SELECT DISTINCT seq, trk_id FROM trk), s AS (SELECT trk_id FROM p GROUP BY 1 HAVING count(*)>1),
f AS (SELECT p.seq, p.trk_id, row_number() OVER (ORDER BY p.trk_id, p.seq) AS i FROM p JOIN s ON p.trk_id=s.trk_id)
SELECT trk.seq, t, gt_id, trk.trk_id, coalesce((SELECT max(trk_id) FROM trk)+i, trk.trk_id) AS new_track FROM trk LEFT JOIN f ON trk.seq=f.seq AND trk.trk_id=f.trk_id""")
def track_id_repair(spark, d):
    rows = X.tracks(spark, d).select("seq", "t", "gt_id", "trk_id")
    return O.repair_track_ids(rows, "seq", "trk_id")


@query("densest_window", """WITH c AS (SELECT value AS v, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT v, sum(n) OVER (ORDER BY v RANGE BETWEEN CURRENT ROW AND 2.5 FOLLOWING) AS r FROM c)
SELECT v AS "start", CAST(r AS BIGINT) AS "rows" FROM w ORDER BY r DESC, v LIMIT 1""")
def densest_window(spark, d):
    return O.densest_window(X.table(spark, d, "events"), "value", 2.5)


@query("topk_per_group", """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS pos FROM lineitem) WHERE pos<=5""")
def topk_per_group(spark, d):
    rows = X.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return S.top_k(rows, ["l_suppkey"], order, 5)


HASH = "sha256(concat('42:', CAST(event_id AS VARCHAR)))"


@query("bottom_k_sample", f"SELECT event_id, user_id FROM events ORDER BY {HASH}, event_id LIMIT 300")
def bottom_k_sample(spark, d):
    return S.bottom_k(X.table(spark, d, "events").select("event_id", "user_id"), "event_id", 300)


@query("balanced_sample", f"""WITH r AS (SELECT event_id, event_type, {HASH} AS h FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS pos FROM r)
SELECT event_id, event_type FROM k WHERE pos<=greatest(1, 500//(SELECT count(DISTINCT event_type) FROM r))""")
def balanced_sample(spark, d):
    return S.balanced_sample(X.table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 500)


@query("linspace_sample", """WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id)-1 AS i, count(*) OVER () AS n FROM events),
k AS (SELECT DISTINCT CAST(range*((SELECT count(*) FROM events)-1)//511 AS BIGINT) AS i FROM range(512))
SELECT event_id, value FROM r WHERE n<=512 OR i IN (SELECT i FROM k)""")
def linspace_sample(spark, d):
    rows = X.table(spark, d, "events").select("event_id", "value")
    return S.linspace_sample(rows, [F.col("value"), F.col("event_id")], 512)


@query("label_ranges", """WITH l AS (SELECT DISTINCT l_suppkey AS label FROM lineitem UNION SELECT p_partkey FROM part), c AS (SELECT label, count(l_suppkey) AS n FROM l LEFT JOIN lineitem ON l_suppkey=label GROUP BY 1),
s AS (SELECT label, n, CAST(sum(n) OVER (ORDER BY label) AS BIGINT) AS "end" FROM c) SELECT label, "end"-n AS "start", "end" FROM s""")
def label_ranges(spark, d):
    rows = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"))
    known = rows.union(X.table(spark, d, "part").select("p_partkey")).distinct()  # parts beyond the suppliers are empty labels
    return S.label_ranges(rows, "label", known)


@query("chunk_overlap", """WITH n AS (SELECT count(*) AS n FROM events), c AS (SELECT range AS chunk, range*70 AS s FROM range(100000), n WHERE range < CASE WHEN n<=100 THEN 1 ELSE ceil((n-30)/70) END)
SELECT event_id, chunk FROM events JOIN c ON event_id>=s AND event_id<s+100""")
def chunk_overlap(spark, d):
    ev = X.table(spark, d, "events").select("event_id")
    total = ev.agg(F.count(F.lit(1))).scalar()
    return S.overlapping_chunks(ev, "event_id", 100, 30, total)


CAPS = "caps AS (SELECT l_suppkey AS k, count(*) AS cap, sum(l_quantity) AS mass FROM lineitem GROUP BY 1)"


def _caps(spark, d):
    return X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        F.count(F.lit(1)).alias("cap"), F.sum("l_quantity").alias("mass")
    )


@query("equal_quota", f"""WITH {CAPS}, s AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap,k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS used,
 row_number() OVER (ORDER BY cap,k) AS i, count(*) OVER () AS m FROM caps),
l AS (SELECT arg_min(floor((5900-used)/(m-i+1)), i) FILTER (cap>floor((5900-used)/(m-i+1))) AS lev FROM s),
q AS (SELECT k, cap, CASE WHEN lev IS NULL THEN cap ELSE least(cap,lev) END AS base, coalesce(cap>lev,false) AS hungry FROM caps, l),
t AS (SELECT *, sum(CASE WHEN hungry THEN 1 ELSE 0 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS turn, sum(base) OVER () AS given FROM q)
SELECT k, cap, CAST(base+CASE WHEN hungry AND turn<=5900-given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM t""")
def equal_quota(spark, d):
    return S.equal_quota(_caps(spark, d), "k", "cap", 5900)


def _shared_sql(order: str) -> str:
    """Rows of each event type inside equal quotas, in the given order."""
    return f"""WITH caps AS (SELECT event_type AS k, count(*) AS cap FROM events GROUP BY 1), s AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap,k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS used,
 row_number() OVER (ORDER BY cap,k) AS i, count(*) OVER () AS m FROM caps),
l AS (SELECT arg_min(floor((1003-used)/(m-i+1)), i) FILTER (cap>floor((1003-used)/(m-i+1))) AS lev FROM s),
q AS (SELECT k, cap, CASE WHEN lev IS NULL THEN cap ELSE least(cap,lev) END AS base, coalesce(cap>lev,false) AS hungry FROM caps, l),
t AS (SELECT *, sum(CASE WHEN hungry THEN 1 ELSE 0 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS turn, sum(base) OVER () AS given FROM q),
u AS (SELECT k, base+CASE WHEN hungry AND turn<=1003-given THEN 1 ELSE 0 END AS quota FROM t)
SELECT event_id, event_type FROM events JOIN u ON event_type=k QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {order}) <= quota"""


@query("shared_sample", _shared_sql("(('0x' || substr(md5(event_id::VARCHAR), 1, 12))::BIGINT + 0.5) / 281474976710656.0, event_id"))
def shared_sample(spark, d):
    return S.shared_sample(X.table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 1003)


@query("shared_sample_latest", _shared_sql("event_id DESC"))
def shared_sample_latest(spark, d):
    """The caller's own sampler: the latest rows inside the same quotas."""
    def latest(rows, key, ident):
        placed = along(rows, [key], [F.desc(ident)], {"__place": number()})
        return placed.filter(F.col("__place") <= F.col("quota"))

    return S.shared_sample(X.table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 1003, latest)


@query("largest_remainder", f"""WITH {CAPS}, c2 AS (SELECT k, cap, mass, (SELECT count(*) FROM caps) AS n FROM caps), r AS (SELECT *, CASE WHEN 5900>=n THEN 1 ELSE 0 END AS seed, cap-CASE WHEN 5900>=n THEN 1 ELSE 0 END AS room FROM c2),
s AS (SELECT *, coalesce(sum(room) OVER w,0) AS filled, coalesce(sum(mass) OVER w,0) AS mb, sum(mass) OVER () AS m, row_number() OVER (ORDER BY room/mass,k) AS i FROM r WHERE room>0
 WINDOW w AS (ORDER BY room/mass,k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (5900-seed*n-filled)/(m-mb) AS rate FROM s), c AS (SELECT min(i) AS ci, arg_min(rate,i) AS rate FROM f WHERE rate*mass<room),
g AS (SELECT f.k, f.n, seed, ci IS NULL OR i<ci AS isfull, room, greatest(0,round(c.rate*mass,9)) AS share FROM f, c),
h AS (SELECT *, CASE WHEN isfull THEN room ELSE floor(share) END AS give, CASE WHEN isfull THEN -1 ELSE share-floor(share) END AS frac FROM g),
t AS (SELECT *, row_number() OVER (ORDER BY frac DESC, k) AS turn, sum(give) OVER () AS given FROM h)
SELECT r.k, r.cap, r.mass, CAST(r.seed+coalesce(t.give+CASE WHEN frac>=0 AND turn<=5900-t.seed*t.n-given THEN 1 ELSE 0 END,0) AS BIGINT) AS quota FROM r LEFT JOIN t ON r.k=t.k""")
def largest_remainder(spark, d):
    return S.largest_remainder(_caps(spark, d), "k", "cap", "mass", 5900)


TILES = f"""{X.GRID}, px AS (SELECT frame*400+"row"*20+col AS id, frame*4+("row"//10)*2+col//10 AS tile, depth AS w,
 {"+".join(f"(((col%10)>>{b})&1)*{4**b}+((({chr(34)}row{chr(34)}%10)>>{b})&1)*{2*4**b}" for b in range(4))} AS morton FROM grid WHERE valid)"""


@query("systematic_sample", f"""WITH {TILES}, q AS (SELECT tile, ceil(count(*)/4) AS quota FROM px GROUP BY 1),
h AS (SELECT px.*, quota, coalesce(sum(w) OVER (PARTITION BY px.tile ORDER BY w DESC, morton, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bef,
 sum(w) OVER (PARTITION BY px.tile) AS tot, row_number() OVER (PARTITION BY px.tile ORDER BY w DESC, morton, id) AS i FROM px JOIN q ON px.tile=q.tile),
r AS (SELECT tile, arg_min((quota-i+1)/(tot-bef), i) AS rate FROM h WHERE round((quota-i+1)/(tot-bef)*w,9)<1 GROUP BY 1),
p AS (SELECT h.id, h.tile, greatest(0,least(1,coalesce(rate,'inf'::DOUBLE)*w)) AS p, morton FROM h LEFT JOIN r ON h.tile=r.tile),
c AS (SELECT *, sum(p) OVER (PARTITION BY tile ORDER BY morton,id ROWS UNBOUNDED PRECEDING) AS cum FROM p)
SELECT id, tile, round(p,6) AS probability FROM c WHERE ceil(round(cum-0.5,6))>ceil(round(cum-p-0.5,6))""")
def systematic_sample(spark, d):
    g = X.grid(spark, d).filter("valid")
    px = g.select(
        (F.col("frame") * 400 + F.col("row") * 20 + F.col("col")).alias("id"),
        (F.col("frame") * 4 + F.floor(F.col("row") / 10).cast("int") * 2 + F.floor(F.col("col") / 10).cast("int")).alias("tile"),
        F.col("depth").alias("w"), S.morton(F.col("col") % 10, F.col("row") % 10, 4).alias("morton"),
    )
    quotas = px.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / 4).alias("quota"))
    out = S.systematic_sample(px, "tile", quotas, "w", [F.col("morton"), F.col("id")])
    return out.select("id", "tile", r6(F.col("probability"), "probability"))


@query("frame_repair", """SELECT o_orderkey AS id FROM orders INTERSECT SELECT l_orderkey+5 FROM lineitem""")
def frame_repair(spark, d):
    a = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return O.aligned_ids(a, X.table(spark, d, "lineitem").select((F.col("l_orderkey") + 5).alias("id")), "id")


FRAMES = "f AS (SELECT o_custkey AS video, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS i FROM orders)"


def _order_frames(spark, d):
    orders = X.table(spark, d, "orders").select(F.col("o_custkey").alias("video"), "o_orderkey")
    numbered = along(orders, ["video"], [F.col("o_orderkey")], {"r": number()})
    return numbered.select("video", (F.col("r") - 1).cast("int").alias("i"))


@query("pair_plan_all", f"""WITH {FRAMES} SELECT a.video, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j FROM f a JOIN f b ON a.video=b.video AND a.i<>b.i""")
def pair_plan_all(spark, d):
    return O.frame_pairs(_order_frames(spark, d), ["video"], "i", "all").select("video", "i", "j")


@query("pair_plan_combinations", f"""WITH {FRAMES} SELECT a.video, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j FROM f a JOIN f b ON a.video=b.video AND a.i<b.i""")
def pair_plan_combinations(spark, d):
    return O.frame_pairs(_order_frames(spark, d), ["video"], "i", "combinations").select("video", "i", "j")
