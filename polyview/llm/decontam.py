"""Benchmark decontamination by SimHash windows, in DataFrame functions alone.

Texts are lower-cased runs between white space; shingles are ``WIDTH`` words (all of them, where an item has fewer) and
weigh as often as they occur.  A document leaks an item if one of its windows of the item's length (shorter
at the end of a document) has a weighted Jaccard similarity of at least 0.75 with it.

* Windows: sliding a window right to the next shingle it shares with an item drops nothing shared and nothing
  of the item, so the best window begins with a shared shingle.  Only such windows, at the lengths of the items
  that hold the shingle, are fingerprinted.
* Fingerprints: 64 bits, each the majority over the window's weighted shingle hashes.
* Candidates: fingerprints are cut into ``RADIUS + 1`` blocks; two within ``RADIUS`` bits agree in one of them, so an
  equi-join per block finds every such pair, and only pairs within the radius go on.  At a similarity of 0.75
  fingerprints differ in 11 bits on average with a deviation of 3; ``RADIUS`` lies 4 deviations above.
* Verification: exact multiset similarity of the shingles themselves.

Defined cases: null, empty and blank texts and items link with nothing; repeated rows of one doc_id are one document;
null ids count as one id.  Leaks of a pair give one row: the most similar window, the first of equals
that begin with a shared shingle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import bounded
from polyview.session import cut

WIDTH = 5
RADIUS = 23
ROWS = 1_000_000  # shingles, block keys or words of items that may be broadcast (24 MB at most)
_EDGES = [64 * b // (RADIUS + 1) for b in range(RADIUS + 2)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def _once(value: Column) -> Column:
    """``value`` behind a row number, which keeps the optimizer from copying it into every use of the column."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _at(values: Column, start: Column, width: int) -> list[Column]:
    return [F.get(values, start + i) for i in range(width)]


def _hashes(values: Column, width: int) -> Column:
    """A hash for each shingle of a word array."""
    places = F.sequence(F.lit(0), F.size(values) - width)
    return F.when(F.size(values) >= width, F.transform(places, lambda i: F.xxhash64(*_at(values, i, width))))


def fingerprint(hashes: Column) -> list[Column]:
    """32 sums, each counting bits ``k`` (low half) and ``k + 32`` (high half) over the hashes."""
    def counted(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0000000100000001)))

    return [counted(k).alias(f"__s{k}") for k in range(32)]


def _majority(total: Column) -> Column:
    """64 bits from the sums: set where more than half of the shingles have the bit."""
    low = F.lit(0xFFFFFFFF)
    bits = [F.when(F.col(f"__s{k}").bitwiseAND(low) * 2 > total, F.lit(1 << k)).otherwise(F.lit(0).cast("long")) for k in range(32)]
    bits += [F.when(F.shiftrightunsigned(f"__s{k}", 32) * 2 > total, F.lit((1 << (k + 32)) - (1 << 64) * (k == 31))).otherwise(F.lit(0).cast("long")) for k in range(32)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def with_fingerprint(df: DataFrame, values: str, width: int, name: str = "mark") -> DataFrame:
    hashed = df.withColumn("__h", _hashes(F.col(values), width))
    summed = hashed.select(*df.columns, F.size("__h").alias("__n"), *fingerprint(F.col("__h")))
    return summed.select(*df.columns, _majority(F.col("__n")).alias(name))


def _block(mark: Column, b: int) -> Column:
    size = _EDGES[b + 1] - _EDGES[b]
    return F.shiftrightunsigned(mark, _EDGES[b]).bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def by_blocks(df: DataFrame, mark: str = "mark") -> DataFrame:
    """A row for each block of the fingerprint: its number and its bits."""
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col(mark), b).alias("bits")) for b in range(RADIUS + 1)])
    return df.withColumn("__b", F.explode(blocks)).select(*df.columns, "__b.block", "__b.bits")


def _shingles(values: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(values) - width + 1), lambda i: F.concat_ws(" ", F.slice(values, i, width)))


def _tagged(name: str) -> Column:
    """The shingles in column ``name``, the n-th of equal ones marked with n: a multiset as a set."""
    return F.transform(name, lambda s, i: F.struct(s.alias("s"), F.size(F.filter(F.slice(name, F.lit(1), i), lambda o: o == s)).alias("k")))


def _parts(df: DataFrame, key: str) -> list[DataFrame]:
    """``df`` in broadcast pieces of about ``ROWS`` rows at most: one as a rule."""
    kept = cut(df)
    pieces = -(-kept.count() // ROWS) or 1
    return [F.broadcast(kept.filter(F.pmod(F.xxhash64(key), F.lit(pieces)) == p) if pieces > 1 else kept) for p in range(pieces)]


def _windows(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """``(doc_id, start, n, window)``: windows that begin with an item's shingle, at that item's length."""
    keys = items.select("n", F.explode(_hashes(F.col("item_words"), width)).alias("__key")).distinct()
    worded = docs.select("doc_id", _once(words(F.col("text"))).alias("__words")).filter(F.size("__words") >= width)
    placed = worded.select("doc_id", "__words", F.posexplode("__words").alias("start", "__word")).filter(F.col("start") + width <= F.size("__words"))
    hashed = placed.select("doc_id", "__words", "start", F.xxhash64(*_at(F.col("__words"), F.col("start"), width)).alias("__own"))
    found = [hashed.join(part, F.col("__own") == F.col("__key")) for part in _parts(keys, "__key")]
    cut_out = F.slice("__words", F.col("start") + 1, F.col("n")).alias("window")
    return reduce(DataFrame.union, [f.select("doc_id", "start", "n", cut_out) for f in found])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, n_shared, n_union)`` for documents that hold an item; ``start`` counts words from 0."""
    items = items.select("item_id", words(F.col("text")).alias("item_words")).withColumn("n", F.size("item_words"))
    items = cut(items.filter("n > 0"))
    shape = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.collect_set(F.least("n", F.lit(WIDTH))).alias("widths")).first()
    none = docs.select("doc_id").join(items.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("start"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_union"))
    found = []
    for width in sorted(shape["widths"]):
        own = items.filter(F.least("n", F.lit(WIDTH)) == width)
        listed = F.broadcast(own) if shape["total"] <= ROWS else own
        blocks = bounded(by_blocks(with_fingerprint(own, "item_words", width, "item_mark"), "item_mark").select("item_id", "n", "item_mark", "block", "bits"), ROWS)
        marked = with_fingerprint(_windows(docs, own, width), "window", width)
        apart = F.col("mark").bitwiseXOR(F.col("item_mark"))
        first = F.coalesce(*[F.when(_block(apart, b) == 0, F.lit(b)) for b in range(RADIUS + 1)])
        near = by_blocks(marked).join(blocks, ["n", "block", "bits"]).filter((F.bit_count(apart) <= RADIUS) & (F.col("block") == first))
        pairs = near.select("doc_id", "item_id", "start", "window").join(listed.select("item_id", "item_words"), "item_id")
        # guarded columns of their own: inside the marking, or in a filter on the result, they would be built again for every shingle
        pairs = pairs.withColumns({"__w": _once(_shingles(F.col("window"), width)), "__i": _once(_shingles(F.col("item_words"), width))})
        shared = F.size(F.array_intersect(_tagged("__w"), _tagged("__i")))
        total = F.size("window") + F.size("item_words") - 2 * (width - 1)
        scored = pairs.select("doc_id", "item_id", "start", _once(shared).alias("n_shared"), total.alias("__total"))
        found.append(scored.select("doc_id", "item_id", "start", "n_shared", (F.col("__total") - F.col("n_shared")).alias("n_union")))
    every = reduce(DataFrame.union, found) if found else none
    best = every.filter("100 * n_shared >= 75 * n_union").groupBy("doc_id", "item_id")
    best = best.agg(F.min_by(F.struct("start", "n_shared", "n_union"), F.struct(-F.col("n_shared") / F.col("n_union"), "start")).alias("w"))
    return best.select("doc_id", "item_id", "w.start", "w.n_shared", "w.n_union")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without documents that hold an item (by doc_id; null ids as one)."""
    gone = bounded(leaks(docs, items).select(F.col("doc_id").alias("__gone")).distinct(), ROWS)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
