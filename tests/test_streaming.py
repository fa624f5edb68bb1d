"""Streaming operators against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from polyview.operators.ordered import first_source_wins
from polyview.operators.sampling import bottom_k
from polyview.streaming import streams

START = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, batches, schema):
    """A file stream that sees one folder file per batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def events(n):
    return [(i, START + dt.timedelta(seconds=30 * i), float(i % 7), ("a", "b", "c")[i % 3]) for i in range(n)]


SCHEMA = "event_id long, ts timestamp, value double, stage string"


def test_chunk_windows(spark, tmp_path):
    rows = events(80)
    stream = feed(spark, tmp_path, [rows[:40], rows[40:], [(999, START + dt.timedelta(days=1), 0.0, "a")]], SCHEMA)
    run(streams.chunk_windows(stream, "ts", "10 minutes", "5 minutes", "1 minute"), "chunks", "append")
    batch = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("ts", "10 minutes", "5 minutes")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    got = {(r["start"], r["n"], r["total"]) for r in spark.table("chunks").collect()}
    assert got == {(r["window"]["start"], r["n"], r["total"]) for r in batch.collect()}


def test_first_arrivals(spark, tmp_path):
    shards = [[(s, i % 12, START + dt.timedelta(seconds=s), f"{s}-{i}-{c}") for i in range(s * 4, s * 4 + 8) for c in range(2)] for s in range(3)]
    schema = "shard int, key int, ts timestamp, row string"
    stream = feed(spark, tmp_path, shards, schema)
    run(streams.first_arrivals(stream, "ts", ["key"], "shard", "1 hour"), "firsts", "append")
    everything = spark.createDataFrame([r for s in shards for r in s], schema)
    full = lambda df: sorted((r["key"], r["shard"], r["row"]) for r in df.collect())
    want = full(first_source_wins(everything, ["key"], "shard"))
    assert len(want) > len({k for k, _, _ in want}) and full(spark.table("firsts")) == want


def test_bottom_sample_and_stage_totals(spark, tmp_path):
    rows = events(90)
    stream = feed(spark, tmp_path, [rows[:30], rows[30:60], rows[60:]], SCHEMA)
    sample = streams.BottomSample(str(tmp_path / "sample"), "event_id", 20)
    query = sample.start(stream, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    spark.createDataFrame(events(120)[90:], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sample = streams.BottomSample(str(tmp_path / "sample"), "event_id", 20)  # restarted from the checkpoint
    query = sample.start(stream, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    rows = events(120)
    everything = spark.createDataFrame(rows, SCHEMA)
    assert len([p for p in (tmp_path / "sample").iterdir() if p.is_dir()]) == 2
    want = {r["event_id"] for r in bottom_k(everything, "event_id", 20).collect()}
    assert {r["event_id"] for r in spark.read.parquet(sample.current(spark)).collect()} == want
    sample.merge(everything.limit(10), 99)
    assert {r["event_id"] for r in spark.read.parquet(sample.current(spark)).collect()} == want

    run(streams.stage_totals(stream.withColumnRenamed("value", "wall")), "totals", "complete")
    got = {r["stage"]: (r["calls"], r["wall"]) for r in spark.table("totals").collect()}
    batch = everything.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("wall"))
    assert got == {r["stage"]: (r["calls"], r["wall"]) for r in batch.collect()}
