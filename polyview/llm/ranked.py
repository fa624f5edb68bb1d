"""Exact ranked lexical search with geometric blocks in each posting list.

A document scores the sum, over an item's terms, of a term's whole-number weight times its impact in the document.

* One pass over the texts keeps, per document, its impacts for terms that any item holds, and counts documents, lengths and
  document frequencies over everything.  Nothing is shuffled by it.
* Thresholds: the documents of highest impact for each term are scored exactly; an item's tenth best of them is a score its
  answer reaches.  A document that only holds terms whose largest contributions add up to less can't rank, so the
  item's other terms (its essential ones) reach every document that can.
* Blocks: documents are range-partitioned by a min-hash of their terms, so that similar ones meet, and cut into segments of
  ``SEGMENT``.  In a segment, the posting list of each essential term is clustered around pivots by inner product.  A block keeps, for every
  term that an item reading the list may ask for, the largest impact among its documents (the coordinatewise maximum).
* A block is skipped for an item only if its bound, the sum of weights times those maxima, stays below the threshold.  As
  maxima bound every document of the block, no document that ranks is lost; what is left is scored exactly.

Segments are bounded, so no list, however common its term, meets in one task, and copies fill blocks of their own.  A segment hands on
at most ``k`` documents an item.

Defined cases: null texts and texts without terms count nowhere; items without terms or with terms that no document holds get no
rows; rows of one item_id (nulls are one id) form one item; every row of documents is a document, so repeated rows rank side
by side, equal scores by doc_id (null first); texts are read whole; empty tables give no rows; other columns don't take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from polyview.llm.common import bounded
from polyview.session import cut

PAIRS = 500_000  # item terms that are searched for in one pass; larger sets of items go in several
SEGMENT = 4096
BLOCK = 16  # postings of a block, on average
# Bytes between terms are all below 128, so UTF-8 can be cut byte by byte.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


@dataclass
class Items:
    """A bounded set of items on the driver: ids, their terms as numbers, and what the corpus says of each term."""

    ids: list
    words: dict[bytes, int]
    of: list[np.ndarray]  # term numbers of each item, ascending
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    top: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the largest impact of each term
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the score an item's answer reaches

    def scores(self, numbers: np.ndarray, impacts: np.ndarray, items: list[int]) -> list[int]:
        """For each of ``items``: the sum over its terms of weight times impact, given for ascending term ``numbers``."""
        out = []
        for i in items:
            own = self.of[i]
            at = np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)
            hit = numbers[at] == own
            out.append(int((self.weight[own[hit]] * impacts[at[hit]]).sum()))
        return out

    def essential(self) -> list[tuple[int, int]]:
        """``(item, term)`` pairs: every document that reaches an item's threshold holds one of its terms listed here."""
        out = []
        for i, own in enumerate(self.of):
            most = self.weight[own] * self.top[own]
            order = np.argsort(most, kind="stable")
            out += [(i, int(t)) for t in own[order[np.cumsum(most[order]) >= max(1, int(self.least[i]))]]]
        return out


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            pairs = [(i, t) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], batch.schema.field("item_id").type), pa.array([t for _, t in pairs], pa.binary())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _listed(pairs: DataFrame) -> Items:
    rows = pairs.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).orderBy("item_id").collect()
    words: dict[bytes, int] = {}
    of = [np.sort(np.array([words.setdefault(bytes(t), len(words)) for t in r["terms"]], np.int64)) for r in rows]
    return Items([r["item_id"] for r in rows], words, of)


VECTORS = "uid long, doc_id {kind}, n long, terms array<int>, tfs array<int>"


def _int_lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])).cast(kind))


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """``(uid, doc_id, n, terms, tfs)`` of documents with terms: those that items hold, by ascending number."""
    shared = docs.sparkSession.sparkContext.broadcast(items.words)

    def run(batches):
        words = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found, counts = terms(text), {}
                for t in found:
                    if t in words:
                        counts[words[t]] = counts.get(words[t], 0) + 1
                rows.append((len(found), np.array(sorted(counts.items()), np.int64).reshape(-1, 2)))
            lists = [_int_lists([r[1][:, k] for r in rows], pa.int32()) for k in (0, 1)]
            out = pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *lists], names=["uid", "doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array([r[0] > 0 for r in rows], pa.bool_()))

    named = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("string"))
    return named.mapInArrow(run, VECTORS.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def _with_statistics(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """Impact vectors ``(uid, doc_id, terms, imps)``; weights, largest impacts and thresholds are put into ``items``."""
    seen = Observation()
    counted = cut(vectors(docs, items).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")))
    total, length = seen.get["n"], max(1, seen.get["l"])
    normed = counted.filter(F.size("terms") > 0).withColumn("m", F.expr(f"10L + (90L * n * {total}L) div {length}L"))
    found = normed.select("uid", "doc_id", "terms", F.expr("transform(tfs, t -> (1000000000L * t) div (1000L * t + 8L * m))").alias("imps"))
    size = len(items.words)
    items.weight, items.top, items.least = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(len(items.ids), np.int64)
    posted = found.select(F.explode(F.arrays_zip("terms", "imps")).alias("p")).groupBy("p.terms").agg(F.count(F.lit(1)).alias("df"), F.max("p.imps").alias("top"))
    for r in posted.collect():  # a row a term of the items
        items.weight[r["terms"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["df"] + 1)))
        items.top[r["terms"]] = r["top"]
    pairs = _frame(docs, term=np.concatenate([*items.of, np.zeros(0, np.int64)]), item=np.repeat(np.arange(len(items.ids)), [len(o) for o in items.of]))
    seeds = _best_postings(found, k).join(pairs, "term").select("uid", "item")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "uid"))
    for r in _scored(found, seeds, items).select("item", "score", rank.alias("r")).filter(F.col("r") == k).collect():  # a row an item
        items.least[r["item"]] = r["score"]
    return found


def _frame(like: DataFrame, **columns: np.ndarray) -> DataFrame:
    """A broadcast table of at most ``PAIRS`` rows."""
    return F.broadcast(like.sparkSession.createDataFrame(pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()})))


def _best_postings(found: DataFrame, k: int) -> DataFrame:
    """``(term, uid)`` of the ``k`` postings of highest impact for each term; a task hands on ``k`` a term."""
    def run(batches):
        kept = np.zeros((0, 3), np.int64)
        for batch in batches:
            terms_ = batch.column(batch.schema.names.index("terms"))
            sizes = np.diff(terms_.offsets.to_numpy())
            flat = [np.repeat(batch.column(batch.schema.names.index("uid")).to_numpy(), sizes)]
            flat = np.stack([terms_.flatten().to_numpy(), batch.column(batch.schema.names.index("imps")).flatten().to_numpy(), *flat], axis=1)
            kept = np.concatenate([kept, flat])
            kept = kept[np.lexsort((kept[:, 2], -kept[:, 1], kept[:, 0]))]
            start = np.maximum.accumulate(np.where(np.diff(kept[:, 0], prepend=-1) != 0, np.arange(len(kept)), 0))
            kept = kept[np.arange(len(kept)) - start < k]
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(3)], names=["term", "imp", "uid"])

    best = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("imp"), "uid"))
    return found.select("uid", "terms", "imps").mapInArrow(run, "term long, imp long, uid long").withColumn("__r", best).filter(F.col("__r") <= k).select("term", "uid")


def _scored(found: DataFrame, pairs: DataFrame, items: Items) -> DataFrame:
    """``(item, uid, doc_id, score)`` of ``pairs(uid, item)``, each once, with a score above 0."""
    shared = found.sparkSession.sparkContext.broadcast(items)
    asked = bounded(pairs.groupBy("uid").agg(F.collect_set("item").alias("items")), 100_000)

    def run(batches):
        for batch in batches:
            rows = [
                (i, r["uid"], r["doc_id"], s) for r in batch.to_pylist()
                for i, s in zip(r["items"], shared.value.scores(np.array(r["terms"]), np.array(r["imps"]), r["items"]), strict=True) if s > 0
            ]
            types = [pa.int32(), pa.int64(), batch.schema.field("doc_id").type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["item", "uid", "doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.join(asked, "uid").select("uid", "doc_id", "terms", "imps", "items").mapInArrow(run, f"item int, uid long, doc_id {kind}, score long")


def segmented(found: DataFrame) -> DataFrame:
    """``found`` plus ``segment``: up to ``SEGMENT`` documents each, neighbours by the min-hash of their terms."""
    key = F.array_min(F.transform("terms", lambda t: F.xxhash64(t)))
    near = found.withColumn("__key", key).repartitionByRange("__key", "uid").sortWithinPartitions("__key", "uid")
    return cut(near.withColumn("segment", F.floor(F.monotonically_increasing_id() / SEGMENT)).drop("__key"))


class Lists:
    """The posting lists of a segment's documents, which stand in order of ``uid``."""

    def __init__(self, group: pa.Table):
        group = group.sort_by("uid").combine_chunks()
        self.uids, self.doc_ids = group.column("uid").to_numpy(), group.column("doc_id")
        lists = group.column("terms").combine_chunks()
        self.numbers, self.imps = lists.flatten().to_numpy(), group.column("imps").combine_chunks().flatten().to_numpy()
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.starts = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(self.numbers, kind="stable")
        self.docs, self.by_term = np.repeat(np.arange(len(self.uids)), self.sizes)[order], self.imps[order]
        self.terms, self.first = np.unique(self.numbers[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that hold a term and its impacts there."""
        k = np.searchsorted(self.terms, term)
        if k == len(self.terms) or self.terms[k] != term:
            return self.docs[:0], self.by_term[:0]
        return self.docs[self.first[k] : self.last[k]], self.by_term[self.first[k] : self.last[k]]

    def rows(self, docs: np.ndarray, terms_: np.ndarray) -> np.ndarray:
        """The impacts of ``terms_`` (ascending) in ``docs``, a row a document."""
        sizes = self.sizes[docs]
        at = np.repeat(self.starts[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        column = np.minimum(np.searchsorted(terms_, self.numbers[at]), len(terms_) - 1)
        hit = terms_[column] == self.numbers[at]
        out = np.zeros((len(docs), len(terms_)), np.int64)
        out[np.repeat(np.arange(len(docs)), sizes)[hit], column[hit]] = self.imps[at[hit]]
        return out


def clusters(rows: np.ndarray) -> np.ndarray:
    """A cluster for each row: that of the pivot (every ``BLOCK``-th row) with the largest inner product of directions."""
    if len(rows) <= BLOCK:
        return np.zeros(len(rows), np.int64)
    turned = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    return np.argmax(turned @ turned[::BLOCK].T, axis=1)


def _asked(wanted: list[tuple[int, int]]) -> dict[int, list[int]]:
    of_term: dict[int, list[int]] = {}
    for i, t in wanted:
        of_term.setdefault(t, []).append(i)
    return of_term


def blocks(placed: DataFrame, items: Items, wanted: list[tuple[int, int]]) -> DataFrame:
    """``(segment, term, docs, terms, tops)``: each segment's posting lists of essential terms in blocks of similar documents.

    ``docs`` are places in the segment, ``tops`` the largest impacts among them of every term that an item which reads
    the list may ask for.
    """
    shared = placed.sparkSession.sparkContext.broadcast((items.of, _asked(wanted)))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        of_item, asked = shared.value
        own = Lists(group)
        out: list[list] = [[], [], [], []]
        for term in own.terms.tolist():
            if term not in asked:
                continue
            docs, _ = own.of(term)
            coordinates = np.unique(np.concatenate([of_item[i] for i in asked[term]]))
            rows = own.rows(docs, coordinates)
            home = clusters(rows)
            order = np.argsort(home, kind="stable")
            heads = np.flatnonzero(np.diff(home[order], prepend=-1))
            tops = np.maximum.reduceat(rows[order], heads)
            for members, top in zip(np.split(docs[order], heads[1:]), tops, strict=True):
                used = np.flatnonzero(top)
                for column, value in zip(out, (term, members, coordinates[used], top[used]), strict=True):
                    column.append(value)
        arrays = [pa.array([key[0].as_py()] * len(out[0]), pa.int64()), pa.array(out[0], pa.int32())]
        arrays += [_int_lists(v, t) for v, t in zip(out[1:], (pa.int32(), pa.int32(), pa.int64()), strict=True)]
        return pa.table(arrays, names=["segment", "term", "docs", "terms", "tops"])

    return placed.groupBy("segment").applyInArrow(run, "segment long, term int, docs array<int>, terms array<int>, tops array<long>")


def passing(index: pa.Table, item: int, items: Items, essential: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The places in documents of the item's blocks whose bounds reach its threshold; how many blocks it has and how many pass."""
    terms_ = index.column("term").to_numpy()
    at = np.flatnonzero(np.isin(terms_, essential))
    if not len(at):
        return np.zeros(0, np.int64), 0, 0
    own = index.take(at).combine_chunks()
    summary = own.column("terms").combine_chunks()
    sizes = np.diff(summary.offsets.to_numpy())
    numbers, tops = summary.flatten().to_numpy(), own.column("tops").combine_chunks().flatten().to_numpy()
    place = np.minimum(np.searchsorted(items.of[item], numbers), len(items.of[item]) - 1)
    hit = items.of[item][place] == numbers
    bounds = np.add.reduceat(np.where(hit, items.weight[numbers] * tops, 0), np.cumsum(sizes) - sizes)
    kept = np.flatnonzero(bounds >= max(1, int(items.least[item])))
    return np.unique(own.column("docs").combine_chunks().take(pa.array(kept)).flatten().to_numpy()), len(at), len(kept)


def searched(placed: DataFrame, index: DataFrame, items: Items, wanted: list[tuple[int, int]], k: int) -> DataFrame:
    """``(item, uid, doc_id, score)``: for each segment and item the ``k`` best documents of blocks that pass."""
    essential: dict[int, list[int]] = {}
    for i, t in wanted:
        essential.setdefault(i, []).append(t)
    shared = placed.sparkSession.sparkContext.broadcast((items, {i: np.array(sorted(ts)) for i, ts in essential.items()}))

    def run(docs: pa.Table, listed: pa.Table) -> pa.Table:
        asked, terms_of = shared.value
        rows: list[tuple] = []
        own = Lists(docs) if docs.num_rows and listed.num_rows else None
        for i, terms_ in terms_of.items() if own else ():
            places, _, _ = passing(listed, i, asked, terms_)
            if not len(places):
                continue
            score, chosen = np.zeros(len(own.uids), np.int64), np.zeros(len(own.uids), bool)
            chosen[places] = True
            for t in asked.of[i].tolist():
                holders, imps = own.of(t)
                score[holders] += np.where(chosen[holders], asked.weight[t] * imps, 0)
            found = places[score[places] >= max(1, int(asked.least[i]))]
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], -k)[-k]]
            ranked_ = [(-int(score[d]), (v := own.doc_ids[int(d)].as_py()) is not None, v or 0, int(own.uids[d]), v) for d in found]
            rows += [(i, r[3], r[4], -r[0]) for r in sorted(ranked_, key=lambda r: r[:4])[:k]]
        types = [pa.int32(), pa.int64(), docs.schema.field("doc_id").type, pa.int64()]
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["item", "uid", "doc_id", "score"])

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.groupBy("segment").cogroup(index.groupBy("segment")).applyInArrow(run, f"item int, uid long, doc_id {kind}, score long")


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    found = _with_statistics(docs, items, k)
    wanted = items.essential()
    placed = segmented(found)
    best = searched(placed, cut(blocks(placed, items, wanted)), items, wanted, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "uid")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score above 0 for each item of ``items(item_id, text)``."""
    spark = docs.sparkSession
    pairs = cut(_item_terms(items))
    passes = max(1, -(-pairs.count() // PAIRS))
    kind = items.schema["item_id"].dataType
    found = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for number_ in range(passes):
        own = _listed(pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number_))
        if own.ids:
            names = F.broadcast(spark.createDataFrame(list(enumerate(own.ids)), f"item int, item_id {kind.simpleString()}"))
            found = found.unionByName(_search(docs.select("doc_id", "text"), own, k).join(names, "item").drop("item"))
    return found
