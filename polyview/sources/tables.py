"""CSV sources and the versioned paired sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.operators.labels import normalize_master
from polyview.plans.scan import along, lagged

TRUTH_SCHEMA = "reference_img long, target_img long, reference_id long, target_id long, img_src string"
MASTER_SCHEMA = "sku_id string, manufacturer string, brand string, category string, is_posm string"
ODOMETRY_SCHEMA = (
    "timestamp double, frame long, x double, y double, z double, qx double, qy double, qz double, qw double"
)


def read_truth(spark: SparkSession, path: str, contains: str | None = None) -> DataFrame:
    """Ground-truth pairs, optionally of sources whose name contains a text."""
    rows = spark.read.csv(path, header=True, schema=TRUTH_SCHEMA, mode="FAILFAST", enforceSchema=False)
    if contains:
        rows = rows.filter(F.col("img_src").contains(contains))
    return rows.withColumn("pair", F.concat_ws("_to_", "reference_img", "target_img"))


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Normalized master data; the header must match exactly, broken rows carry an error."""
    rows = spark.read.csv(path, header=True, schema=MASTER_SCHEMA, mode="FAILFAST", enforceSchema=False)
    return normalize_master(rows)


def read_odometry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(
        path, header=True, schema=ODOMETRY_SCHEMA, mode="FAILFAST", ignoreLeadingWhiteSpace=True, enforceSchema=False
    )


def odometry_errors(rows: DataFrame) -> DataFrame:
    """Rows that break the contract: frames 0, 1, 2, … and strictly growing timestamps."""
    step = along(rows.select("frame", "timestamp"), [], [F.col("frame"), F.col("timestamp")], {
        "__frame": lagged(F.col("frame")), "__ts": lagged(F.col("timestamp")),
    })
    error = F.when(F.col("frame") != F.coalesce(F.col("__frame") + 1, F.lit(0)), "frame").when(
        F.col("timestamp") <= F.col("__ts"), "timestamp"
    )
    return step.select("frame", error.alias("error")).filter("error IS NOT NULL")


def publish(spark: SparkSession, base: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None]) -> str:
    """Write related tables under one run id, check them, then make them visible together.

    Readers follow the pointer file, which is replaced by one rename as the last step.
    When a write or the check fails, the run's files are removed and the pointer stays.
    """
    run = uuid.uuid4().hex
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    path = hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        for name, df in tables.items():
            df.write.parquet(f"{base}/{run}/{name}")
        check({name: spark.read.parquet(f"{base}/{run}/{name}") for name in tables})
    except Exception:
        fs.delete(path(f"{base}/{run}"), True)
        raise
    draft = path(f"{base}/.CURRENT-{run}")
    out = fs.create(draft, True)
    out.write(bytearray(run, "utf-8"))
    out.close()
    context = hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    gateway = spark.sparkContext._gateway
    options = gateway.new_array(hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, path(f"{base}/CURRENT"), options)
    return run


def read_published(spark: SparkSession, base: str, name: str) -> DataFrame:
    run = spark.read.text(f"{base}/CURRENT").first()["value"]
    return spark.read.parquet(f"{base}/{run}/{name}")
