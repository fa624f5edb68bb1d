"""Session settings and lineage cuts.

``cut`` is the only way this library truncates a plan: the rows are written as
a parquet table in the shared folder that ``spark.checkpoint.dir`` names, so a
lost executor costs a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str = "local[8]", partitions: int = 8, memory: str = "12g", shared: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; without ``shared`` its intermediate tables get a folder of their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("polyview")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    folder = shared or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    builder = builder.config("spark.checkpoint.dir", folder)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every query relies on to a given session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """This run's folder for intermediate tables, below the shared folder that ``spark.checkpoint.dir`` names.

    ``clean`` removes it; results that were not written elsewhere can't be read after that.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{folder.rstrip('/')}/polyview-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` plus the row count, observed during the same write."""
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]
