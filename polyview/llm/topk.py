"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are whole numbers ``floor(scale * x)``.  All vectors are turned by the right singular vectors of the whole
table (the eigenvectors of its second moments, added up over the tasks), which gathers length in the first
coordinates.  Vectors are dealt into bands of descending length and blocks within a band; queries into blocks of their own.

1. Every query meets the band of the longest vectors and learns how good its k-th best is there.
2. A band whose longest vector times the query's length can't reach that value holds nothing for the query,
   nor does any band after it: query blocks go only to the bands that remain.
3. Within two blocks the partial sum over the first coordinates plus the product of both remaining
   lengths bounds each score from above; only pairs whose bound reaches the query's k-th best are scored in whole numbers.

Bounds are widened by more than floating-point error can be, so no result depends on the rotation.  Every block
pair is a row of its own, however many vectors are alike.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; missing components at the
end of shorter vectors count as 0; ties go to smaller ids; rows of one id are candidates each, but no candidate for a query of
that id; a query id's rows share one list, from its lowest vector; null ids take no part.  Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyview.session import cut

BANDS = 64
BLOCK = 2048  # vectors of a block; with 8-byte components of 64 dimensions 1 MB
QUERIES = 512
NAMES = ["block", "n", "dims", "ids", "values"]


def whole(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``(id, v, norm2)``: whole-number components of the vectors that take part."""
    x = F.col(embedding)
    fine = F.size(x) > 0
    fine &= ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    own = vectors.filter(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), scaled.alias("v"))
    return own.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.flatten(), np.float64)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), dims))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)] = flat
    return out


def _rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of the table, from second moments that tasks add up first (dims x dims numbers)."""
    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["k", "x"])

    sums = vectors.select("v").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    moments = np.zeros(dims * dims)
    moments[sums["k"].to_numpy()] = sums["x"].to_numpy()
    values, turned = np.linalg.eigh(moments.reshape(dims, dims)) if np.isfinite(moments).all() else (np.zeros(dims), np.eye(dims))
    return turned[:, np.argsort(-values)]


def _packed(vectors: DataFrame, dims: int, size: int, keys: list[str]) -> DataFrame:
    """Blocks of at most ``size`` vectors, one row each: ids and components as bytes, next to their keys."""
    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(part: pa.Table):
            values = _matrix(part.column("v"), dims)
            if np.abs(values).max() < 2**15:
                values = values.astype(np.int16)
            elif np.abs(values).max() < 2**53:
                values = values.astype(np.int64)
            else:
                raise OverflowError("components beyond 53 bits")
            own = {k: [part.column(k)[0].as_py()] for k in keys}
            first = part.column("norm2")
            return pa.table({**own, "n": [part.num_rows], "wide": [values.itemsize], "ids": [part.column("id").to_numpy().astype(np.int64).tobytes()], "values": [values.tobytes()], "longest": [float(np.sqrt(np.max(first.to_numpy())))]})

        def ready(rows: pa.Table, last: bool):
            at = 0
            key = np.stack([rows.column(k).to_numpy() for k in keys], axis=1)
            ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for end in ends:
                while end - at >= size or (at < end and (last or end != len(key))):
                    to = min(end, at + size)
                    yield from flush(rows.slice(at, to - at)).to_batches()
                    at = to
            held[:] = rows.slice(at).to_batches() if at < rows.num_rows else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= size:
                    yield from ready(pa.Table.from_batches(held), False)
        if held:
            yield from ready(pa.Table.from_batches(held), True)

    schema = ", ".join(f"{k} long" for k in keys) + ", n long, wide long, ids binary, values binary, longest double"
    return vectors.select(*keys, "id", "v", "norm2").mapInArrow(run, schema)


def _unpacked(ids: bytes, values: bytes, wide: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int16 if wide == 2 else np.int64
    return np.frombuffer(ids, np.int64), np.frombuffer(values, kind).reshape(-1, dims).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of one query with rows of whole numbers."""
    bound = np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1).max())
    if bound < 2**52:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array(exact, np.int64)  # raises beyond 64 bits


def _best(pairs: DataFrame, dims: int, turn: np.ndarray, k: int) -> DataFrame:
    """The k best ``(query_id, vec_id, score)`` of each query in each pair of blocks, by bounds.

    ``pairs`` hold both blocks and ``floors``: what a candidate of each query has to reach (bytes, or null).
    """
    shared = pairs.sparkSession.sparkContext.broadcast(turn)  # dims x dims numbers
    head = max(1, dims // 4)

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for q_ids, q_values, q_wide, floors, ids, values, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turned = shared.value
                q_id, q = _unpacked(q_ids, q_values, q_wide, dims)
                x_id, x = _unpacked(ids, values, wide, dims)
                floor = np.frombuffer(floors, np.float64).copy() if floors is not None else np.full(len(q), -np.inf)
                order = np.lexsort((x_id, -(x * x).sum(axis=1)))
                x_id, x = x_id[order], x[order]
                qr, xr = q @ turned, x @ turned
                q_len, x_len = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
                rest_q, rest_x = np.sqrt((qr[:, head:] ** 2).sum(axis=1)), np.sqrt((xr[:, head:] ** 2).sum(axis=1))
                for i in range(len(q)):
                    slack = 1e-9 * q_len[i] * x_len[0] + 1e-6
                    best: list[tuple[int, int]] = []
                    limit = floor[i]
                    at = 0
                    while at < len(x) and q_len[i] * x_len[at] + slack >= limit:  # lengths descend
                        to = min(len(x), at + 256)
                        bound = xr[at:to, :head] @ qr[i, :head] + rest_x[at:to] * rest_q[i] + slack
                        open_ = at + np.flatnonzero((bound >= limit) & (x_id[at:to] != q_id[i]))
                        if len(open_):
                            for score, vec in zip(_scores(q[i], x[open_]).tolist(), x_id[open_].tolist(), strict=True):
                                if score >= floor[i]:
                                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (score, -vec))
                            if len(best) == k:
                                limit = max(limit, best[0][0])
                        at = to
                    out[0] += [int(q_id[i])] * len(best)
                    out[1] += [-v for _, v in best]
                    out[2] += [s for s, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    columns = ["q_ids", "q_values", "q_wide", "floors", "ids", "values", "wide"]
    return pairs.select(*columns).mapInArrow(run, "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the k best other rows of ``vectors``."""
    spark = vectors.sparkSession
    own = cut(whole(vectors, vec_id, embedding, scale))
    asked = whole(queries, vec_id, embedding, scale).groupBy("id").agg(F.min(F.struct("v", "norm2")).alias("w")).select("id", "w.v", "w.norm2")
    stats = own.agg(F.max(F.size("v")).alias("dims"), F.expr(f"percentile_approx(norm2, array({', '.join(str(1 - b / BANDS) for b in range(1, BANDS))}), 2000)").alias("edges")).first()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if stats["dims"] is None:
        return none
    dims = max(stats["dims"], asked.agg(F.max(F.size("v"))).first()[0] or 0)
    turn = _rotation(own, dims)
    edges = F.array(*[F.lit(float(e)) for e in stats["edges"]])  # lower ends of all bands but the last, descending
    banded = own.withColumn("band", F.size(F.filter(edges, lambda e: e > F.col("norm2"))).cast("long"))
    banded = banded.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("long"))
    blocks = cut(_packed(banded.repartitionByRange(F.col("band"), F.col("cell")).sortWithinPartitions("band", "cell", F.desc("norm2")).withColumn("cell", F.lit(0).cast("long")), dims, BLOCK, ["band", "cell"]))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))).cast("long"))
    q_blocks = _packed(asked.repartition("part").sortWithinPartitions("part"), dims, QUERIES, ["part"])
    q_blocks = cut(q_blocks.withColumn("q_block", F.monotonically_increasing_id()).select("q_block", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.col("wide").alias("q_wide"), F.col("longest").alias("q_longest")))
    bands = {r["band"]: r["longest"] for r in blocks.groupBy("band").agg(F.max("longest").alias("longest")).collect()}  # BANDS rows at most
    # 1: the longest band tells every query what it has to reach
    first = min(bands)
    seeds = q_blocks.withColumn("band", F.lit(first).cast("long")).join(blocks, "band").withColumn("floors", F.lit(None).cast("binary"))
    found = cut(_top(_best(seeds, dims, turn, k), k).drop("rank"))
    reached = found.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id", "low")
    # 2: floors and lengths decide how far each query block goes
    parts = q_blocks.select("q_block", "q_ids", "q_values", "q_wide")
    listed = parts.mapInArrow(lambda batches: _listed(batches, dims), "q_block long, at long, query_id long, length double")
    known = listed.join(reached, "query_id", "left").select("q_block", "at", "length", F.col("low").cast("double").alias("low"))
    needs = known.groupBy("q_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("low", F.lit(float("-inf"))).alias("low")))), lambda s: s["low"]).alias("lows"), F.min(F.when(F.col("length") > 0, F.col("low") / F.col("length")).otherwise(F.lit(float("-inf")))).alias("need"), F.count("low").alias("sure"), F.count(F.lit(1)).alias("all"))
    longest = F.array(*[F.struct(F.lit(int(b)).cast("long").alias("band"), F.lit(x).alias("longest")) for b, x in sorted(bands.items()) if b != first]) if len(bands) > 1 else None
    if longest is None:
        return _ranked(found, k)
    need = F.when(F.col("sure") == F.col("all"), F.col("need")).otherwise(F.lit(float("-inf")))
    reach = needs.withColumn("need", need).withColumn("to", F.filter(longest, lambda b: (b["longest"] * (1 + 1e-9) + 1e-6 >= F.col("need"))))
    reach = reach.select("q_block", "lows", F.explode("to.band").alias("band"))
    packed = reach.mapInArrow(_floors, "q_block long, band long, floors binary")
    pairs = packed.join(q_blocks, "q_block").join(blocks, "band")
    return _ranked(found.unionByName(_best(pairs, dims, turn, k)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _listed(batches, dims):
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for block, ids, values, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            q_id, q = _unpacked(ids, values, wide, dims)
            out[0] += [block] * len(q_id)
            out[1] += range(len(q_id))
            out[2] += q_id.tolist()
            out[3] += np.sqrt((q * q).sum(axis=1)).tolist()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["q_block", "at", "query_id", "length"])


def _floors(batches):
    for batch in batches:
        lows = [np.array(x, np.float64).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lows, pa.binary())], names=["q_block", "band", "floors"])
