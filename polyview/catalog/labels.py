"""Queries over classification votes, object indexes, facets and master data."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyview import fixtures as X
from polyview.catalog.boxes import MAPPING, mapping
from polyview.catalog.registry import query
from polyview.operators import labels as L
from polyview.sources import logs

# Each record is broken in the way its part key selects.


@query("classification_validate", f"""WITH {X.DET} SELECT image_id, object_id, CASE (l_partkey%13)
 WHEN 2 THEN 'schema' WHEN 3 THEN 'schema_version' WHEN 4 THEN 'source' WHEN 5 THEN 'project_id'
 WHEN 6 THEN 'sku_id' WHEN 7 THEN 'sku_name' WHEN 8 THEN 'confidence' WHEN 9 THEN 'metadata'
 WHEN 10 THEN 'object' WHEN 11 THEN 'reason' ELSE 'ok' END AS outcome FROM det""")
def classification_validate(spark, d):
    det = X.detections(spark, d, "l_partkey")
    kind = F.col("l_partkey") % 13
    text = lambda bad, good, n: F.when(kind == n, F.lit(bad)).otherwise(F.lit(good))
    head = F.concat(
        F.lit('{"schema_version":"'), text("2.0.0", "1.0.0", 3),
        F.lit('","source":"'), text("other", L.RECORD_SOURCE, 4),
        F.lit('","project_id":'), text("true", "51", 5),
    )
    full = F.concat(
        head, F.lit(',"status":"resolved","sku_id":"'), text(" ", "7", 6),
        F.lit('","sku_name":"'), text("", "SKU 7", 7), F.lit('","confidence":'),
        F.when(kind == 8, F.lit("1.5")).otherwise(F.col("score").cast("string")),
        F.lit(',"metadata":{"status":"'), text("done", "master_data_pending", 9),
        F.lit('","manufacturer":null,"brand":null,"category":null,"object_kind":null}}'),
    )
    gone = F.concat(head, F.lit(',"status":"unavailable","reason":'), text('""', '"low_quality"', 11), F.lit("}"))
    record = (
        F.when(kind == 10, F.lit("[1]")).when(kind == 2, F.concat(head, F.lit(',"status":"resolved"}')))
        .when(kind.isin(1, 11), gone).otherwise(full)
    )
    rows = det.select("image_id", "object_id", record.alias("record"))
    return L.record_outcomes(rows, "record").select("image_id", "object_id", "outcome")


LABELS = """lab AS (SELECT p_partkey, CASE p_size%5 WHEN 0 THEN p_name WHEN 1 THEN concat('^', p_name)
 WHEN 2 THEN concat(CAST(p_partkey AS VARCHAR), '^ ') WHEN 3 THEN concat(' ', CAST(p_partkey AS VARCHAR), ' ^', p_name, '^x ')
 ELSE concat(CAST(p_partkey AS VARCHAR), '^', p_name) END AS label FROM part)"""


@query("label_split", f"""WITH {LABELS}, s AS (SELECT p_partkey, trim(split_part(label,'^',1)) AS a,
 trim(substr(label, strpos(label,'^')+1)) AS b, strpos(label,'^')>0 AS has FROM lab)
SELECT p_partkey, CASE WHEN has AND a<>'' AND b<>'' THEN a END AS sku_id,
 CASE WHEN has AND a<>'' AND b<>'' THEN b END AS sku_name FROM s""")
def label_split(spark, d):
    key, name, size = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size") % 5
    label = (
        F.when(size == 0, name).when(size == 1, F.concat(F.lit("^"), name))
        .when(size == 2, F.concat(key, F.lit("^ ")))
        .when(size == 3, F.concat(F.lit(" "), key, F.lit(" ^"), name, F.lit("^x ")))
        .otherwise(F.concat(key, F.lit("^"), name))
    )
    out = X.table(spark, d, "part").withColumn("s", L.split_label(label))
    return out.select("p_partkey", "s.sku_id", "s.sku_name")


CAND = """cand AS (SELECT gid, sku_id, sku_name, CAST(sum(CAST(confidence AS DECIMAL(28,18))) AS DOUBLE) AS s,
 count(*) AS c, max(confidence) AS m FROM votes WHERE sku_id IS NOT NULL GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY sku_id='0', s DESC, c DESC, m DESC, sku_id, sku_name) AS pos,
 count(*) OVER (PARTITION BY gid) AS n FROM cand),
won AS (SELECT g.gid, CASE WHEN n IS NULL THEN 'unavailable' WHEN n=1 THEN 'resolved' ELSE 'conflict' END AS status,
 coalesce(n,0) AS candidates, sku_id, sku_name, round(s,6) AS confidence_sum, c AS support_count, m AS max_confidence
 FROM (SELECT DISTINCT gid FROM votes) g LEFT JOIN (SELECT * FROM rk WHERE pos=1) r ON g.gid=r.gid)"""


def winners(spark, d):
    return L.vote(X.votes(spark, d), other_id="0")


@query("classification_vote", f"WITH {X.VOTES}, {CAND} SELECT * FROM won")
def classification_vote(spark, d):
    return winners(spark, d).withColumn("confidence_sum", F.round("confidence_sum", 6))


@query("vote_ranking", f"""WITH {X.VOTES}, {CAND} SELECT gid, sku_id, support_count, pos FROM
 (SELECT gid, sku_id, c AS support_count, pos FROM rk)""")
def vote_ranking(spark, d):
    return L.ranked_candidates(X.votes(spark, d), other_id="0").select("gid", "sku_id", "support_count", "pos")


@query("id_search", f"WITH {X.VOTES}, {CAND} SELECT gid, sku_id, status FROM won WHERE contains(CAST(gid AS VARCHAR),'42') AND sku_id='3'")
def id_search(spark, d):
    return L.search(winners(spark, d), "42", "3").select("gid", "sku_id", "status")


@query("object_index", f"""WITH {MAPPING} SELECT global_id, count(DISTINCT image_id) AS images, count(*) AS instances,
 count(*) FILTER (NOT removed) AS active, count(*) FILTER (removed) AS removed FROM mapping GROUP BY 1""")
def object_index(spark, d):
    return L.object_index(mapping(spark, d))


@query("object_members", f"""WITH {MAPPING} SELECT global_id, image_id, object_id,
 row_number() OVER (PARTITION BY global_id ORDER BY object_id, image_id) AS pos FROM mapping""")
def object_members(spark, d):
    return L.object_members(mapping(spark, d))


@query("mapping_stats", f"""WITH {MAPPING} SELECT count(DISTINCT global_id) AS global_ids, count(*) AS instances,
 count(*) FILTER (NOT removed) AS active, count(*) FILTER (removed) AS removed, count(DISTINCT image_id) AS images FROM mapping""")
def mapping_stats(spark, d):
    return L.mapping_stats(mapping(spark, d))


@query("mapping_first_box", f"""WITH {MAPPING} SELECT global_id, image_id, count(*) AS instances,
 (arg_min(x1,object_id)+arg_min(x2,object_id))/2 AS cx, (arg_min(y1,object_id)+arg_min(y2,object_id))/2 AS cy
 FROM mapping GROUP BY 1,2""")
def mapping_first_box(spark, d):
    return L.first_boxes(mapping(spark, d))


DIM = """dim AS (SELECT CAST(p_partkey%7 AS VARCHAR) AS sku_id, min(p_type) AS manufacturer,
 CASE WHEN p_partkey%7=5 THEN NULL ELSE max(p_brand) END AS brand, min(p_name) AS category FROM part GROUP BY p_partkey%7)"""


def dimension(spark, d):
    part = X.table(spark, d, "part").groupBy((F.col("p_partkey") % 7).alias("k")).agg(
        F.min("p_type").alias("manufacturer"), F.max("p_brand").alias("brand"), F.min("p_name").alias("category")
    )
    return part.select(
        F.col("k").cast("string").alias("sku_id"), "manufacturer",
        F.when(F.col("k") != 5, F.col("brand")).alias("brand"), "category",
    )


@query("sku_facets", f"""WITH {X.VOTES}, {CAND} SELECT value, objects, row_number() OVER (ORDER BY objects DESC, value) AS pos
 FROM (SELECT sku_id AS value, count(*) AS objects FROM won WHERE sku_id IS NOT NULL GROUP BY 1)""")
def sku_facets(spark, d):
    counts = L.facets(winners(spark, d), ["sku_id"])
    return L.facet_order(counts, ["facet"]).drop("facet")


@query("dim_facets", f"""WITH {X.VOTES}, {CAND}, {DIM}, j AS (SELECT won.gid, dim.* FROM won JOIN dim ON won.sku_id=dim.sku_id),
u AS (SELECT 'manufacturer' AS facet, manufacturer AS value FROM j UNION ALL SELECT 'brand', brand FROM j
 UNION ALL SELECT 'category', category FROM j),
c AS (SELECT facet, value, count(*) AS objects FROM u WHERE value IS NOT NULL GROUP BY 1,2)
SELECT *, row_number() OVER (PARTITION BY facet ORDER BY objects DESC, value) AS pos FROM c""")
def dim_facets(spark, d):
    joined = winners(spark, d).join(dimension(spark, d), "sku_id")
    return L.facet_order(L.facets(joined, ["manufacturer", "brand", "category"]), ["facet"])


@query("label_normalize", """SELECT p_partkey, CASE WHEN regexp_matches(p_brand,'^Brand#1[0-9]?$') THEN 'other' ELSE p_brand END AS brand,
 CASE WHEN p_type='ECONOMY' THEN 'other' ELSE p_type END AS manufacturer FROM part""")
def label_normalize(spark, d):
    return X.table(spark, d, "part").select(
        "p_partkey",
        L.fold_label(F.col("p_brand"), "^Brand#1[0-9]?$", "other").alias("brand"),
        L.fold_label(F.col("p_type"), "^ECONOMY$", "other").alias("manufacturer"),
    )


@query("masterdata_normalize", """WITH r AS (SELECT CASE p_size%9 WHEN 0 THEN concat('0', CAST(p_partkey AS VARCHAR)) WHEN 1 THEN 'x1'
 WHEN 2 THEN CAST(p_partkey//4 AS VARCHAR) ELSE concat(' ', CAST(p_partkey AS VARCHAR), ' ') END AS raw_id,
 CASE p_size%4 WHEN 0 THEN ' null ' WHEN 1 THEN '' ELSE concat(' ',p_type) END AS manufacturer, p_brand AS brand, p_name AS category,
 CASE p_size%6 WHEN 0 THEN '1' WHEN 5 THEN 'yes' ELSE '0' END AS posm FROM part),
c AS (SELECT raw_id, CASE WHEN regexp_full_match(trim(raw_id),'(0|[1-9][0-9]*)') THEN trim(raw_id) END AS sku_id,
 CASE WHEN trim(manufacturer)='' OR upper(trim(manufacturer))='NULL' THEN NULL ELSE trim(manufacturer) END AS manufacturer,
 brand, category, CASE posm WHEN '1' THEN true WHEN '0' THEN false END AS is_posm FROM r)
SELECT *, CASE WHEN sku_id IS NULL THEN 'id' WHEN is_posm IS NULL THEN 'is_posm'
 WHEN count(*) OVER (PARTITION BY sku_id)>1 THEN 'duplicate' END AS error FROM c""")
def masterdata_normalize(spark, d):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    raw = (
        F.when(size % 9 == 0, F.concat(F.lit("0"), key)).when(size % 9 == 1, F.lit("x1"))
        .when(size % 9 == 2, F.floor(F.col("p_partkey") / 4).cast("string"))
        .otherwise(F.concat(F.lit(" "), key, F.lit(" ")))
    )
    maker = F.when(size % 4 == 0, F.lit(" null ")).when(size % 4 == 1, F.lit("")).otherwise(
        F.concat(F.lit(" "), F.col("p_type"))
    )
    posm = F.when(size % 6 == 0, "1").when(size % 6 == 5, "yes").otherwise("0")
    rows = X.table(spark, d, "part").select(
        raw.alias("sku_id"), maker.alias("manufacturer"), F.col("p_brand").alias("brand"),
        F.col("p_name").alias("category"), posm.alias("is_posm"),
    )
    return L.normalize_master(rows)


@query("missing_ids", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size%4<>1)")
def missing_ids(spark, d):
    known = X.table(spark, d, "part").filter("p_size % 4 <> 1").select(F.col("p_partkey").alias("l_partkey"))
    return L.missing_ids(X.table(spark, d, "lineitem"), known, "l_partkey")


@query("global_skus_json", f"""WITH {MAPPING}, e AS (SELECT d.image_id, d.object_id, d.score, m.global_id,
 coalesce(m.removed,false) AS dd FROM det d LEFT JOIN mapping m ON d.image_id=m.image_id AND d.object_id=m.object_id)
SELECT image_id, 0::INTEGER AS part, CAST(count(*) AS INTEGER) AS objects,
 concat('{{"objects":[', string_agg(concat('{{"object_id":',object_id,
 CASE WHEN global_id IS NULL THEN '' ELSE concat(',"global_id":',global_id) END,
 ',"is_deduplicated":',CASE WHEN dd THEN 'true' ELSE 'false' END,'}}'), ',' ORDER BY object_id), ']}}') AS document
FROM e GROUP BY image_id""")
def global_skus_json(spark, d):
    from polyview.operators.detections import enrich_ids

    out = enrich_ids(X.detections(spark, d), mapping(spark, d))
    return L.image_documents(
        out.select("image_id", "object_id", "global_id", "is_deduplicated"), "image_id", ["object_id"]
    )


@query("annotations_by_image", """WITH n AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus) AS pos FROM lineitem)
SELECT o_orderkey AS image_id, o_orderpriority AS image_label, n.pos, n.l_partkey AS category_id, p_name AS category
FROM orders LEFT JOIN n ON o_orderkey=l_orderkey LEFT JOIN part ON l_partkey=p_partkey""")
def annotations_by_image(spark, d):
    images = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("image_label")
    )
    anns = X.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "image_id")
    names = X.table(spark, d, "part").select(F.col("p_partkey").alias("category_id"), F.col("p_name").alias("category"))
    out = L.annotation_groups(images, anns, "image_id", X.DET_ORDER)
    return (
        out.select("image_id", "image_label", "pos", F.col("l_partkey").alias("category_id"))
        .join(names, "category_id", "left")
    )


@query("last_record", """SELECT user_id, max(event_id) AS line_no, arg_max(event_type,event_id) AS event_type,
 json_extract_string(arg_max(props,event_id),'$.k') AS k FROM events GROUP BY 1""")
def last_record(spark, d):
    """The users' event lines as JSON-lines logs, one log a user."""
    ev = X.table(spark, d, "events")
    text = F.to_json(F.struct(F.col("event_id").alias("line_no"), "event_type", F.get_json_object("props", "$.k").alias("k")))
    lines = ev.select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), text.alias("text"))
    kind = ev.schema["event_id"].dataType
    out = logs.last_records(lines, ["line_no", "event_type", "k"])
    return out.select(F.col("file").alias("user_id"), F.col("line_no").cast(kind).alias("line_no"), "event_type", "k")


@query("label_errors", """WITH o AS (SELECT DISTINCT l_partkey AS sku_id FROM lineitem), m AS (SELECT DISTINCT CASE WHEN p_partkey%7=0 THEN p_partkey+1000000 ELSE p_partkey END AS sku_id FROM part)
SELECT coalesce(m.sku_id,o.sku_id) AS sku_id, CASE WHEN o.sku_id IS NULL THEN 'unknown id' ELSE 'missing id' END AS error FROM m FULL JOIN o ON m.sku_id=o.sku_id WHERE m.sku_id IS NULL OR o.sku_id IS NULL""")
def label_errors(spark, d):
    key = F.col("p_partkey")
    data = X.table(spark, d, "part").select(F.when(key % 7 == 0, key + 1000000).otherwise(key).alias("sku_id"))
    return L.label_errors(data, X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("sku_id")), "sku_id")


@query("props_json", """SELECT event_id, json_extract_string(props,'$.k') AS k, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k_num,
 array_to_string(json_keys(props),',') AS keys, regexp_extract(event_type,'^([a-z]{2})',1) AS head,
 concat('{"type":"',event_type,'","k":',json_extract_string(props,'$.k'),'}') AS again FROM events""")
def props_json(spark, d):
    k = F.get_json_object("props", "$.k")
    return X.table(spark, d, "events").select(
        "event_id", k.alias("k"), k.cast("long").alias("k_num"),
        F.concat_ws(",", F.json_object_keys("props")).alias("keys"),
        F.regexp_extract("event_type", "^([a-z]{2})", 1).alias("head"),
        F.to_json(F.struct(F.col("event_type").alias("type"), k.cast("long").alias("k"))).alias("again"),
    )
