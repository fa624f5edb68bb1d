"""Classification records, votes, global-object indexes, facets and master data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.plans.scan import along, number

# The record contract, the catch-all product and the folded labels.
SCHEMA_VERSION = "1.0.0"
RECORD_SOURCE = "personalcare"
PROJECT_ID = 51
RESOLVED_KEYS = [
    "schema_version", "source", "project_id", "status",
    "sku_id", "sku_name", "confidence", "metadata",
]
UNAVAILABLE_KEYS = ["schema_version", "source", "project_id", "status", "reason"]
PENDING_METADATA = (
    '{"brand":null,"category":null,"manufacturer":null,'
    '"object_kind":null,"status":"master_data_pending"}'
)
OTHER_SKU_ID = "56642"
OTHER_SKU_NAME = "其他品类"
OTHER_LABEL = "其他"
FOLDED_LABELS = "^(?:100)?[冲沖]劲$"


def reject_reason(text: Column, parsed: Column | None = None) -> Column:
    """Why a JSON classification record is not valid; null for a valid one.  ``parsed`` is its variant, if a column holds it."""
    v = F.try_parse_json(text) if parsed is None else parsed
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    kind = lambda path: F.schema_of_variant(F.variant_get(v, path, "variant"))
    keys = F.sort_array(F.json_object_keys(text))
    status = get("$.status", "string")
    expected = F.when(status == "resolved", F.array(*[F.lit(k) for k in sorted(RESOLVED_KEYS)]))
    expected = expected.when(
        status == "unavailable", F.array(*[F.lit(k) for k in sorted(UNAVAILABLE_KEYS)])
    )
    a_string = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False))
    blank = lambda path: ~a_string(path) | (F.trim(get(path, "string")) == "")
    number_kind = kind("$.confidence").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
    confidence = get("$.confidence", "double")
    good_confidence = F.coalesce(number_kind & confidence.between(0.0, 1.0), F.lit(False))
    good_project = F.coalesce(
        (kind("$.project_id") == "BIGINT") & (get("$.project_id", "long") == PROJECT_ID), F.lit(False)
    )
    same = lambda path, want: F.coalesce(
        a_string(path) & (get(path, "string") == want), F.lit(False)
    )
    return (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "object")
        .when(F.coalesce(keys != expected, F.lit(True)), "schema")
        .when(~same("$.schema_version", SCHEMA_VERSION), "schema_version")
        .when(~same("$.source", RECORD_SOURCE), "source")
        .when(~good_project, "project_id")
        .when(status == "unavailable", F.when(~a_string("$.reason") | (get("$.reason", "string") == ""), "reason"))
        .when(blank("$.sku_id"), "sku_id")
        .when(blank("$.sku_name"), "sku_name")
        .when(~good_confidence, "confidence")
        .when(F.coalesce(get("$.metadata", "string") != PENDING_METADATA, F.lit(True)), "metadata")
    )


def record_outcomes(records: DataFrame, text: str) -> DataFrame:
    """Every record with its ``outcome``, ok or why it is not valid, read once (``validate_records`` reads them for each side)."""
    parsed = records.withColumn("__v", F.try_parse_json(text))
    return parsed.withColumn("outcome", F.coalesce(reject_reason(F.col(text), F.col("__v")), F.lit("ok"))).drop("__v")


def validate_records(records: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Split records into valid rows and rejects with their reason."""
    marked = records.withColumn("reason", reject_reason(F.col(text)))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def split_label(label: Column) -> Column:
    """``id^name`` split at the first separator; null unless both sides are non-blank."""
    at = F.instr(label, "^")
    left = F.trim(F.substring_index(label, "^", 1))
    right = F.trim(label.substr(at + 1, F.length(label)))
    good = (at > 0) & (left != "") & (right != "")
    return F.when(good, F.struct(left.alias("sku_id"), right.alias("sku_name")))


def vote_candidates(votes: DataFrame, key: str = "gid") -> DataFrame:
    """Support of every (group, product); sums are taken in decimal so order never matters."""
    exact = F.sum(F.col("confidence").cast("decimal(28,18)")).cast("double")
    return (
        votes.filter("sku_id IS NOT NULL")
        .groupBy(key, "sku_id", "sku_name")
        .agg(
            exact.alias("confidence_sum"),
            F.count(F.lit(1)).alias("support_count"),
            F.max("confidence").alias("max_confidence"),
        )
    )


def vote_key(other_id: str) -> list[Column]:
    """Canonical candidate order: real products first, then support, then names."""
    return [
        (F.col("sku_id") == other_id).alias("is_other"),
        (-F.col("confidence_sum")).alias("s"),
        (-F.col("support_count")).alias("c"),
        (-F.col("max_confidence")).alias("m"),
        F.col("sku_id").alias("i"),
        F.col("sku_name").alias("n"),
    ]


def vote(votes: DataFrame, key: str = "gid", other_id: str = OTHER_SKU_ID) -> DataFrame:
    """Status and winning product per group; both levels combine map-side."""
    best = F.struct("sku_id", "sku_name", "confidence_sum", "support_count", "max_confidence")
    winners = (
        vote_candidates(votes, key)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.min_by(best, F.struct(*vote_key(other_id))).alias("best"),
        )
    )
    status = (
        F.when(F.col("candidates").isNull(), "unavailable")
        .when(F.col("candidates") == 1, "resolved")
        .otherwise("conflict")
    )
    return (
        votes.select(key).distinct().join(winners, key, "left")
        .select(key, status.alias("status"), F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), "best.*")
    )


def ranked_candidates(votes: DataFrame, key: str = "gid", other_id: str = OTHER_SKU_ID) -> DataFrame:
    """All candidates of a group in canonical order, numbered from 1."""
    return along(vote_candidates(votes, key), [key], vote_key(other_id), {"pos": number()})


def object_index(mapping: DataFrame) -> DataFrame:
    """Per global id: images, instances, active and removed counts."""
    gone = F.sum(F.col("removed").cast("long"))
    return (
        mapping.groupBy("global_id", "image_id")
        .agg(F.count(F.lit(1)).alias("n"), gone.alias("gone"))
        .groupBy("global_id")
        .agg(
            F.count(F.lit(1)).alias("images"),
            F.sum("n").alias("instances"),
            F.sum(F.col("n") - F.col("gone")).alias("active"),
            F.sum("gone").alias("removed"),
        )
    )


def object_members(mapping: DataFrame) -> DataFrame:
    """Object ids of each global id in order, duplicates kept, one row per member."""
    order = [F.col("object_id"), F.col("image_id")]
    return along(
        mapping.select("global_id", "image_id", "object_id"), ["global_id"], order, {"pos": number()}
    )


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """Totals of a mapping from its per-(id, image) counts."""
    gone = F.sum(F.col("removed").cast("long"))
    per = mapping.groupBy("global_id", "image_id").agg(F.count(F.lit(1)).alias("n"), gone.alias("gone"))
    return per.agg(
        F.countDistinct("global_id").alias("global_ids"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("instances"),
        F.coalesce(F.sum(F.col("n") - F.col("gone")), F.lit(0)).alias("active"),
        F.coalesce(F.sum("gone"), F.lit(0)).alias("removed"),
        F.countDistinct("image_id").alias("images"),
    )


def first_boxes(mapping: DataFrame) -> DataFrame:
    """First box, by object id, of each global id in each image, with its centre."""
    box = F.struct("x1", "y1", "x2", "y2")
    return (
        mapping.groupBy("global_id", "image_id")
        .agg(F.min_by(box, "object_id").alias("b"), F.count(F.lit(1)).alias("instances"))
        .select(
            "global_id", "image_id", "instances",
            ((F.col("b.x1") + F.col("b.x2")) / 2).alias("cx"),
            ((F.col("b.y1") + F.col("b.y2")) / 2).alias("cy"),
        )
    )


def facets(objects: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Object counts of several facet columns in one pass; null values are skipped."""
    out = objects.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        F.grouping_id(*columns).alias("__set"), F.count(F.lit(1)).alias("objects")
    )
    width = len(columns)
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mine = F.col("__set") == (2**width - 1) - 2 ** (width - 1 - i)
        facet = F.when(mine, F.lit(c)).otherwise(facet)
        value = F.when(mine, F.col(c).cast("string")).otherwise(value)
    return out.select(facet.alias("facet"), value.alias("value"), "objects").filter("value IS NOT NULL")


def facet_order(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number facet values by count descending, then value."""
    order = [F.col("objects").desc(), F.col("value")]
    return along(counts, by, order, {"pos": number()})


def search(objects: DataFrame, text: str, sku_id: str | None = None) -> DataFrame:
    """Ids containing a text and, if given, whose primary product is ``sku_id``."""
    hit = F.col("gid").cast("string").contains(text)
    return objects.filter(hit if sku_id is None else hit & (F.col("sku_id") == sku_id))


def fold_label(label: Column, pattern: str = FOLDED_LABELS, other: str = OTHER_LABEL) -> Column:
    return F.when(label.rlike(pattern), F.lit(other)).otherwise(label)


def label_errors(data: DataFrame, objects: DataFrame, ident: str) -> DataFrame:
    """``(ident, error)`` where label data and objects don't cover each other: data of an unknown id, or an id without data.

    Null ids on either side are unknown or missing as one id.
    """
    sides = data.select(ident).distinct().withColumn("__d", F.lit(True)).join(
        objects.select(F.col(ident).alias("__o")).distinct().withColumn("__k", F.lit(True)), F.col(ident).eqNullSafe(F.col("__o")), "full_outer"
    )
    error = F.when(F.col("__k").isNull(), "unknown id").when(F.col("__d").isNull(), "missing id")
    return sides.select(F.coalesce(ident, "__o").alias(ident), error.alias("error")).filter("error IS NOT NULL")


def clean_text(text: Column) -> Column:
    """Trimmed text; empty or a literal NULL in any case becomes null."""
    t = F.trim(text)
    return F.when((t != "") & (F.upper(t) != "NULL"), t)


def clean_sku_id(text: Column) -> Column:
    """A canonical decimal id, or null."""
    t = F.trim(text)
    return F.when(t.rlike("^(0|[1-9][0-9]*)$"), t)


def normalize_master(rows: DataFrame) -> DataFrame:
    """Master data with clean ids, texts and flag, plus an error per broken row."""
    sku = clean_sku_id(F.col("sku_id"))
    copies = (
        rows.select(sku.alias("sku_id")).filter("sku_id IS NOT NULL")
        .groupBy("sku_id").agg(F.count(F.lit(1)).alias("copies"))
    )
    cleaned = rows.select(
        F.col("sku_id").alias("raw_id"),
        sku.alias("sku_id"),
        *[clean_text(F.col(c)).alias(c) for c in ("manufacturer", "brand", "category")],
        F.when(F.col("is_posm") == "1", True).when(F.col("is_posm") == "0", False).alias("is_posm"),
    )
    error = (
        F.when(F.col("sku_id").isNull(), "id")
        .when(F.col("is_posm").isNull(), "is_posm")
        .when(F.col("copies") > 1, "duplicate")
    )
    return cleaned.join(copies, "sku_id", "left").withColumn("error", error).drop("copies")


def missing_ids(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested ids the dimension lacks."""
    return requested.select(key).distinct().join(known, key, "left_anti")


def image_documents(rows: DataFrame, key: str, order: Sequence[str], part_rows: int = 4096) -> DataFrame:
    """One JSON document per image, split into parts of bounded length.

    Objects keep their order; an image above ``part_rows`` objects becomes several
    numbered parts, so no document outgrows a task.
    """
    body = [c for c in rows.columns if c != key]
    placed = along(rows, [key], [F.col(c) for c in order], {"__n": number()})
    item = F.struct(F.col("__n"), F.struct(*body).alias("o"))
    return (
        placed.groupBy(key, F.floor((F.col("__n") - 1) / part_rows).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            key, "part",
            F.to_json(F.struct(F.transform("items", lambda i: i["o"]).alias("objects"))).alias("document"),
            F.size("items").alias("objects"),
        )
    )


def annotation_groups(images: DataFrame, annotations: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Every image with its annotations numbered in order; images without any stay."""
    placed = along(annotations, [key], [F.col(c) for c in order], {"pos": number()})
    return images.join(placed, key, "left")
