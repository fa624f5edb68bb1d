"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from polyview.operators.sampling import bottom_k
from polyview.sources.tables import publish


def chunk_windows(events: DataFrame, ts: str, size: str, slide: str, late: str) -> DataFrame:
    """Counts and sums per overlapping time chunk; a chunk closes once the watermark passes."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, size, slide))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")
    )


def first_arrivals(shards: DataFrame, ts: str, keys: Sequence[str], shard: str, late: str) -> DataFrame:
    """All rows of the first shard in which each key arrives; rows of later shards are dropped.

    The state of a key is its shard, of several in one micro-batch the lowest; it is forgotten once the watermark has
    passed the key's last row by ``late``.
    """
    schema = shards.schema
    kind = schema[shard].dataType.simpleString()

    def keep(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        frames = list(frames)
        first = state.get[0] if state.exists else min(f[shard].min() for f in frames)
        state.update((first,))
        last = max(f[ts].max() for f in frames)
        # forget the key once the watermark is past this time
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        for frame in frames:
            yield frame[frame[shard] == first]

    return shards.withWatermark(ts, late).groupBy(*keys).applyInPandasWithState(
        keep, schema, f"{shard} {kind}", "append", GroupStateTimeout.EventTimeTimeout
    )


def stage_totals(receipts: DataFrame) -> DataFrame:
    """Running calls and wall time per stage, for update or complete output."""
    return receipts.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("wall").alias("wall"))


class BottomSample:
    """A bounded uniform sample of a stream, kept as a published table of the lowest hashes.

    Samples merge by the batch rule, so a replayed micro-batch leaves the sample as it was.  The pointer to
    the current version lies next to the versions, so a restart goes on with the sample it finds; versions before the
    last but one are removed.
    """

    def __init__(self, folder: str, ident: str, k: int, seed: int = 42):
        self.folder, self.ident, self.k, self.seed = folder, ident, k, seed

    def current(self, spark: SparkSession) -> str | None:
        """The folder of the current sample."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return f"{self.folder}/{spark.read.text(f'{self.folder}/CURRENT').first()['value']}/sample"

    def merge(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = self.current(spark)
        rows = batch
        if before:
            rows = spark.read.parquet(before).unionByName(batch).dropDuplicates([self.ident])
        run = publish(spark, self.folder, {"sample": bottom_k(rows, self.ident, self.k, self.seed)}, lambda written: None)
        top = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        kept = {run, (before or "").rsplit("/", 2)[-2] if before else "", "CURRENT"}
        for entry in files.listStatus(top):
            if entry.isDirectory() and entry.getPath().getName() not in kept:
                files.delete(entry.getPath(), True)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).start()
