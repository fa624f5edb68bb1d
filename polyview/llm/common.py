"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.session import cut_counted, prepare

ARROW_ROWS = 500  # rows an Arrow batch may hold: texts of 100 kB each still fit a worker next to its copies


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns of these names in any case: results replace inputs that clash with them."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def append(df: DataFrame, fields: list[T.StructField], compute: Callable[[Iterator[pa.RecordBatch]], Iterator[list]]) -> DataFrame:
    """``df`` plus columns that ``compute`` makes from each Arrow batch (one list of arrays per batch).

    Every other column passes through as it is.
    """
    schema = T.StructType([f for f in df.schema.fields] + fields)

    def run(batches):
        def kept():
            for batch in batches:
                waiting.append(batch)
                yield batch

        waiting: list[pa.RecordBatch] = []
        for arrays in compute(kept()):
            batch = waiting.pop(0)
            names = batch.schema.names + [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return df.mapInArrow(run, schema)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` written once, with a broadcast hint only where it has at most ``rows`` rows.

    The count comes from the same write.  Beyond the bound the join is Spark's choice, a shuffle join as a rule.
    """
    kept, count = cut_counted(df)
    return F.broadcast(kept) if count <= rows else kept
