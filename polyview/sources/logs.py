"""Match logs, metric reports and line-oriented records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.plans.scan import along, group_fits, last_seen, next_seen
from polyview.session import cut

# The line formats of a match log and a metric report.
MATCH_LINE = r"Matched ref\s+(\d+)\s*.*?target\s+(\d+)\s+\(hit ratio:\s+([\d.]+)\s+(\d+)/(\d+)\)"
GROUP_LINE = r"^Matching objects between reference image (\d+) and target image (\d+)"
FOUND_LINE = r"^Found\s+(\d+)\s+matches\s+in\s+image\s+(\d+)"
TRIPLE = r"(?s)\(Recall\): ([\d.]+)%.*?\(Effectiveness\): ([\d.]+)%.*?\(Precision\): ([\d.]+)%"


def read_lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Text lines with their file and a number that grows along the file.

    A line's place is its split's offset and its place in the split, so large files are
    read in parallel.
    """
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
        .select(
            F.lit(folder).alias("root"), F.col("_metadata.file_path").alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("seq"),
            F.col("value").alias("text"),
        )
    )


def attribute_matches(lines: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """Match rows with the frames their footer names: ``lines(root, file, seq, text)``.

    Rows precede the ``Found N`` footer they belong to; the footer's frames are those of
    the last group line.  A footer whose count differs from its rows, or rows without a
    footer, fail the read.  Only forward pairs and the one wrap pair of a root are kept.
    """
    t = F.col("text")
    num = lambda pattern, g: F.regexp_extract(t, pattern, g)
    is_group, is_match = t.rlike(GROUP_LINE), t.rlike(MATCH_LINE)
    found = F.when(~is_group & ~is_match & t.rlike(FOUND_LINE) & (F.try_to_number(num(FOUND_LINE, 1), F.lit("9999999999")) > 0), True)
    marked = lines.select(
        "root", "file", "seq", is_match.alias("is_match"), found.alias("found"),
        F.when(is_group, F.struct(num(GROUP_LINE, 1).cast("int").alias("ref"), num(GROUP_LINE, 2).cast("int").alias("tgt"))).alias("group"),
        F.when(found, num(FOUND_LINE, 1).cast("long")).alias("n"), F.when(found, num(FOUND_LINE, 2).cast("int")).alias("found_tgt"),
        F.when(is_match, F.struct(
            num(MATCH_LINE, 1).cast("int").alias("ref_id"), num(MATCH_LINE, 2).cast("int").alias("tgt_id"),
            num(MATCH_LINE, 3).cast("double").alias("hit_ratio"), num(MATCH_LINE, 4).cast("int").alias("matched"),
            num(MATCH_LINE, 5).cast("int").alias("total"),
        )).alias("m"),
    ).filter("is_match OR found OR group IS NOT NULL")
    keys, order = ["root", "file"], [F.col("seq")]
    marked = cut(marked)
    fits = group_fits(marked, keys)
    grouped = along(marked, keys, order, {"g": last_seen(F.col("group"))}, fits)
    foot = F.when(F.col("found"), F.struct("seq", "n", F.col("found_tgt").alias("tgt"), "g"))
    owned = along(grouped, keys, order, {"foot": next_seen(foot)}, fits).filter("is_match OR found")
    counts = owned.groupBy(*keys, "foot").agg(F.count_if("is_match").alias("rows"))
    wrong = (
        F.when(F.col("foot").isNull(), "rows lack a target group")
        .when(F.coalesce(F.col("foot.g.tgt") != F.col("foot.tgt"), F.lit(True)), "footer and group line disagree")
        .when(F.col("rows") != F.col("foot.n"), "footer count differs from its rows")
    )
    checked = counts.withColumn(
        "ok", F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", "file", wrong)).cast("boolean")).otherwise(True)
    ).filter("ok").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("foot.seq").alias("__seq"))
    # Null-safe, so that rows without a footer reach their check as well.
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("foot_seq").eqNullSafe(F.col("__seq"))]
    rows = owned.filter("is_match").select(
        *keys, "seq", F.col("foot.seq").alias("foot_seq"), F.col("foot.g.ref").alias("ref_idx"), F.col("foot.tgt").alias("tgt_idx"), "m.*"
    ).join(checked, same).drop("__root", "__file", "__seq")
    edges = rows.withColumn("edge_seq", F.struct("file", "seq")).drop("foot_seq", "seq")
    seen = marked.filter("group IS NOT NULL").select("root", F.explode(F.array("group.ref", "group.tgt")).alias("f"))
    ends = seen.groupBy("root").agg(F.max("f").alias("hi"), F.min("f").alias("lo"))
    wrap = (F.col("ref_idx") == F.col("hi")) & (F.col("tgt_idx") == F.col("lo"))
    kept = edges.join(ends, "root", "left").filter((F.col("ref_idx") < F.col("tgt_idx")) | wrap).drop("hi", "lo")
    return kept.filter(F.col("hit_ratio") >= min_ratio) if min_ratio > 0 else kept


def read_match_log(spark: SparkSession, folder: str, min_ratio: float = 0.0) -> DataFrame:
    """Match rows of every summary in a folder named by digits alone; other folders don't count."""
    lines = read_lines(spark, folder, "matching_summary.txt").filter(F.col("file").rlike("/[0-9]+/matching_summary[.]txt$"))
    return attribute_matches(lines, min_ratio)


def report_triples(texts: DataFrame) -> DataFrame:
    """Every (recall, effectiveness, precision) triple of each report; none, no row."""
    t = F.col("text")
    parts = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(TRIPLE), F.lit(g)).alias(n) for g, n in ((1, "recall"), (2, "effectiveness"), (3, "precision"))])
    rows = texts.select("file", F.posexplode(parts).alias("pos", "m"))
    return rows.select("file", "pos", *[F.col("m")[n].cast("double").alias(n) for n in ("recall", "effectiveness", "precision")])


def report_means(triples: DataFrame) -> DataFrame:
    return triples.groupBy("file").agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(c).alias(f"avg_{c}") for c in ("recall", "effectiveness", "precision")]
    )


def read_reports(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return report_triples(texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def last_records(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Selected fields of the last line of each JSON-lines log."""
    last = lines.groupBy("file").agg(F.max_by("text", "seq").alias("text"))
    return last.select("file", *[F.get_json_object("text", f"$.{f}").alias(f) for f in fields])
