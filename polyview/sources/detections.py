"""Per-frame detection files and grouped annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = "struct<position: array<double>, confidences: struct<det: double>, classification: string>"
ENTRY = f"struct<classes: array<string>, objects: array<{OBJECT}>>"


def parse_objects(text: Column) -> Column:
    """Objects of a frame payload in any of its three shapes; bad JSON fails the read.

    ``{skus: [{objects}]}`` concatenates all entries, ``[{objects}]`` takes the first,
    ``{objects}`` is taken as is.
    """
    is_list = F.ltrim(text).startswith("[")
    has_skus = F.get_json_object(text, "$.skus").isNotNull()
    skus = F.flatten(F.transform(F.from_json(text, f"struct<skus: array<{ENTRY}>>")["skus"], lambda s: s["objects"]))
    first = F.try_element_at(F.from_json(text, f"array<{ENTRY}>"), F.lit(1))["objects"]
    plain = F.from_json(text, ENTRY)["objects"]
    objects = F.when(is_list, first).when(has_skus, skus).otherwise(plain)
    bad = F.raise_error(F.concat(F.lit("not a detection payload: "), F.substring(text, 1, 80)))
    return F.when(F.try_parse_json(text).isNull() | objects.isNull(), bad.cast(f"array<{OBJECT}>")).otherwise(objects)


def flatten(frames: DataFrame, text: str = "text", first_id: Column | None = None) -> DataFrame:
    """One row per detection, numbered by position; an empty frame keeps one empty row."""
    rest = [c for c in frames.columns if c != text]
    rows = frames.select(*rest, F.posexplode_outer(parse_objects(F.col(text))).alias("pos", "o"))
    start = F.lit(0) if first_id is None else first_id
    side = lambda i, n: F.try_element_at("o.position", F.lit(i + 1)).alias(n)
    return rows.select(
        *rest, (start + F.col("pos")).cast("int").alias("object_id"),
        *[side(i, n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.col("o.confidences.det").alias("score"), F.col("o.classification").alias("classification"),
    )


def read_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections of all digit-named JSON files of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).alias("digits"), F.col("value").alias("text")
    )
    frames = files.filter("digits <> ''").select(F.col("digits").cast("long").alias("image_id"), "text")
    return flatten(frames)


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotations joined to their image and category, and images without annotations kept."""
    doc = spark.read.json(path, multiLine=True)
    one = lambda name: doc.select(F.explode(name).alias("r")).select("r.*")
    names = one("categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    images = one("images").withColumnRenamed("id", "image_id")
    anns = one("annotations").withColumnRenamed("id", "annotation_id").join(names, "category_id", "left")
    return images, images.join(anns, "image_id", "left")
