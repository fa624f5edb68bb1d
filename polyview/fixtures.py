"""Observation-shaped views derived from the given tables.

Each view exists twice: as a DataFrame here and as a SQL common table expression
for the checks, so both sides start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.plans.scan import along, group_fits, number
from polyview.plans.spatial import PAIR_LIMIT
from polyview.session import prepare

_MEASURED: dict[tuple, bool] = {}


def fits_once(df: DataFrame, name: str, sf_dir: str, keys: list[str], limit: int | None = None) -> bool:
    """Measure a table's largest group once per session and folder."""
    key = (df.sparkSession.sparkContext.applicationId, sf_dir, name, limit, *keys)
    if key not in _MEASURED:
        _MEASURED[key] = group_fits(df, keys, limit)
    return _MEASURED[key]


def images_pair(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the boxes of every image are few enough to pair them by the image alone; counted on the bare lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    return fits_once(lines, "lineitem", sf_dir, ["image_id"], PAIR_LIMIT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


DET_ORDER = [
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus",
]


def detections(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Boxes per image: orders are images, their lines are detections."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id")
    placed = along(
        lines,
        ["image_id"],
        [F.col(c) for c in DET_ORDER],
        {"__n": number()},
        fits=fits_once(lines, "lineitem", sf_dir, ["image_id"]),
    )
    x1 = (F.col("l_partkey") % 40) * F.lit(10.0)
    y1 = (F.col("l_suppkey") % 20) * F.lit(10.0)
    return placed.select(
        "image_id",
        (F.col("__n") - 1).cast("int").alias("object_id"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 20 + F.col("l_quantity") * 4).alias("x2"),
        (y1 + 20 + F.col("l_linenumber") * 15).alias("y2"),
        F.round(F.col("l_discount") * 10, 2).alias("score"),
        *extra,
    )


DET = """det AS (
 SELECT *, x1+20+l_quantity*4 AS x2, y1+20+l_linenumber*15 AS y2 FROM (
  SELECT l_orderkey AS image_id,
   CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey,l_suppkey,l_linenumber,
    l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus)-1 AS INTEGER) AS object_id,
   (l_partkey%40)*10.0::DOUBLE AS x1, (l_suppkey%20)*10.0::DOUBLE AS y1,
   round(l_discount*10,2) AS score, l_partkey, l_suppkey, l_quantity, l_linenumber, l_returnflag,
   l_extendedprice, l_shipdate
  FROM lineitem))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a video: a customer's orders in date order, numbered from 0."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("video"), "o_orderdate", F.col("o_orderkey").alias("image_id")
    )
    out = along(
        orders,
        ["video"],
        [F.col("o_orderdate"), F.col("image_id")],
        {"idx": number()},
        fits=fits_once(orders, "orders", sf_dir, ["video"]),
    )
    return out.withColumn("idx", (F.col("idx") - 1).cast("int"))


FRAMES = """frames AS (
 SELECT o_custkey AS video, o_orderdate, o_orderkey AS image_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey)-1 AS INTEGER) AS idx
 FROM orders)"""


SLOTS = 8  # slots that share a key when matches are paired


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside the frames of their video; those of a frame with the same last part digit are numbered as ``slot``."""
    det = detections(spark, sf_dir, "l_partkey", "l_quantity").select(
        "image_id", "object_id", "l_quantity", (F.col("l_partkey") % 10).alias("digit")
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    slotted = along(
        det,
        ["image_id", "digit"],
        [F.col("object_id")],
        {"slot": number()},
        fits=fits_once(lines, "lineitem", sf_dir, ["image_id"]),
    )
    return slotted.join(frames(spark, sf_dir).select("video", "idx", "image_id"), "image_id")


def matches(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Match edges between consecutive frames of a video; ``lines`` are those of ``placed``, where the caller holds them.

    Lines with the same last part digit are numbered inside their frame; a line
    matches the next frame's lines of that digit whose number differs by at most
    one.  Each line thus has at most three edges, whatever the frame's size.
    Runs of ``SLOTS`` numbers are paired; only lines next to another run look into two of them.
    """
    lines = placed(spark, sf_dir) if lines is None else lines
    run = lambda d: F.floor((F.col("slot") + d) / SLOTS)
    ref = lines.select(
        "video", "digit", F.col("idx").alias("ref_idx"), F.col("image_id").alias("ref_img"),
        F.col("object_id").alias("ref_id"), F.col("l_quantity").alias("q1"), F.col("slot").alias("ref_slot"),
        F.explode(F.array_distinct(F.array(run(-1), run(1)))).alias("run"),
    )
    tgt = lines.select(
        "video", "digit", (F.col("idx") - 1).alias("ref_idx"), F.col("image_id").alias("tgt_img"),
        F.col("object_id").alias("tgt_id"), F.col("l_quantity").alias("q2"), "slot", run(0).alias("run"),
    )
    near = F.abs(F.col("ref_slot") - F.col("slot")) <= 1
    return ref.join(tgt, ["video", "ref_idx", "digit", "run"]).filter(near).select(
        "video", "ref_idx", "ref_img", "ref_id", "tgt_img", "tgt_id",
        F.round(1 - F.abs(F.col("q1") - F.col("q2")) / 50, 2).alias("hit_ratio"),
        F.least("q1", "q2").cast("int").alias("matched"),
        F.col("q1").cast("int").alias("total"),
        F.struct("video", "ref_idx", "ref_id", "tgt_id").alias("edge_seq"),
    )


MATCH = f"""{DET}, {FRAMES}, placed AS (
 SELECT video, idx, det.image_id, object_id, l_quantity, l_partkey%10 AS digit,
  row_number() OVER (PARTITION BY det.image_id, l_partkey%10 ORDER BY object_id) AS slot
 FROM det JOIN frames ON det.image_id=frames.image_id),
edges AS (
 SELECT a.video, a.idx AS ref_idx, a.image_id AS ref_img, a.object_id AS ref_id,
  b.image_id AS tgt_img, b.object_id AS tgt_id,
  round(1-abs(a.l_quantity-b.l_quantity)/50,2) AS hit_ratio,
  CAST(least(a.l_quantity,b.l_quantity) AS INTEGER) AS matched,
  CAST(a.l_quantity AS INTEGER) AS total
 FROM placed a JOIN placed b ON a.video=b.video AND a.idx+1=b.idx AND a.digit=b.digit
  AND abs(a.slot-b.slot)<=1)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classification vote per box; the object voted on is the image."""
    det = detections(spark, sf_dir, "l_partkey", "l_returnflag")
    sku = (F.col("l_partkey") % 7).cast("string")
    return det.select(
        "image_id", "object_id", F.col("image_id").alias("gid"),
        F.when(F.col("l_returnflag") != "R", sku).alias("sku_id"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("SKU "), sku)).alias("sku_name"),
        F.col("score").alias("confidence"),
    )


VOTES = f"""{DET}, votes AS (
 SELECT image_id, object_id, image_id AS gid,
  CASE WHEN l_returnflag<>'R' THEN CAST(l_partkey%7 AS VARCHAR) END AS sku_id,
  CASE WHEN l_returnflag<>'R' THEN concat('SKU ', CAST(l_partkey%7 AS VARCHAR)) END AS sku_name,
  score AS confidence FROM det)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 points per vector: consecutive coordinate triples."""
    emb = table(spark, sf_dir, "embeddings")
    e = F.col("embedding")
    triple = lambda k: F.struct(
        F.lit(k).alias("k"),
        e[3 * k].cast("double").alias("x"),
        e[3 * k + 1].cast("double").alias("y"),
        e[3 * k + 2].cast("double").alias("z"),
    )
    rows = emb.select(
        "vec_id", "label",
        (F.abs(F.element_at(e, -1).cast("double")) * 10).alias("conf"),
        F.explode(F.array(*[triple(k) for k in range(21)])).alias("p"),
    )
    return rows.select(
        (F.col("vec_id") * 21 + F.col("p.k")).alias("point_id"),
        (F.col("vec_id") % 8).cast("int").alias("frame"),
        "p.x", "p.y", "p.z", "conf", "label",
    )


PTS = """pts AS (
 SELECT vec_id*21+k AS point_id, CAST(vec_id%8 AS INTEGER) AS frame,
  embedding[3*k+1]::DOUBLE AS x, embedding[3*k+2]::DOUBLE AS y, embedding[3*k+3]::DOUBLE AS z,
  abs(embedding[64]::DOUBLE)*10 AS conf, label
 FROM embeddings, (SELECT CAST(range AS INTEGER) AS k FROM range(21)))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth pixels: 20 x 20 pixel frames cut from the event sequence."""
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return ev.select(
        F.floor(i / 400).cast("int").alias("frame"),
        F.floor((i % 400) / 20).cast("int").alias("row"),
        (i % 20).cast("int").alias("col"),
        (1 + F.col("value") / 1000).alias("depth"),
        (F.col("event_type") != "error").alias("valid"),
    )


GRID = """grid AS (
 SELECT CAST(event_id//400 AS INTEGER) AS frame, CAST((event_id%400)//20 AS INTEGER) AS "row",
  CAST(event_id%20 AS INTEGER) AS col, 1+value/1000 AS depth, event_type<>'error' AS valid
 FROM events)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of true and predicted tracks per sequence and day."""
    ev = table(spark, sf_dir, "events")
    return (
        ev.groupBy(
            F.col("user_id").alias("seq"),
            F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("t"),
            F.col("event_type").alias("gt_id"),
            (F.col("event_id") % 5).cast("int").alias("trk_id"),
        )
        .agg((F.max("value") / 500).alias("sim"))
    )


TRACK = """trk AS (
 SELECT user_id AS seq, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS t,
  event_type AS gt_id, CAST(event_id%5 AS INTEGER) AS trk_id, max(value)/500 AS sim
 FROM events GROUP BY ALL)"""
