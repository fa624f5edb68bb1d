"""Exact Jaccard join of word shingles by parity sketches.

The set of a text is the distinct runs of ``WIDTH`` words.  A sketch deals the shingle
space into parts and keeps, per part, the XOR of its members' hashes.  A shingle that only one of
two sets has changes one part at most, so the number of differing parts never exceeds the
symmetric difference.

Sets of at least ``3/4`` similarity differ in at most ``(|A| + |B|) / 7`` shingles.  A size band holds
the pairs whose smaller set lies in ``[c, 4c/3)``; with ``D`` the largest difference of the band, two
linked sets agree in all but ``D`` parts.  The first ``D + t`` parts that both list in one common order
therefore share ``t`` parts at least (pigeonhole): every set lists so many parts in hash order, empty parts last.
Sets list parts for their own band and for the one below, where they can be the larger of a pair.

Lists meet by part key in slices.  A list with fewer than ``t`` keys that other sets share can't belong to a link and
goes; that leaves out sets which only have a passage in common.  Of the keys that several sets still share:

* every set is verified against the set that is lowest in most of its keys (one pair per set); links join components;
* keys whose sets still lie in several components are tested pair by pair in blocks inside the
  workers, by sketches alone; pairs that the sketch bound can't refuse are verified exactly.

So each pair of different sets that share a key is verified, refused by a bound that can't be
wrong, or already in one component: the components are exact.  Equal sets are one node throughout.

Defined cases: null, empty and blank texts have no set and are linked with nothing; rows that share a
doc_id are one node; null ids take no part and get no component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.llm.common import append, bounded
from polyview.plans.rounds import components
from polyview.session import cut, cut_counted

WIDTH = 5
SET = ["n_shingles", "set_a", "set_b"]
BLOCK = 256  # sets of one key that a worker compares at once
KEY_SHARES = 4  # packs over which the keys of one lowest set are spread
FEW = 2_000_000  # ids that may be broadcast: 16 MB
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    codes = coded.indices.to_numpy()
    full = np.fromiter((w != "" for w in names), bool, len(names))[codes]
    word = hashes[codes]
    ends = np.asarray(words.offsets)
    counts = np.concatenate([[0], np.cumsum(full)])
    ends = counts[ends - ends[0]]
    word = word[full]
    sets = []
    with np.errstate(over="ignore"):
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            n = end - start
            if n == 0:
                sets.append(np.zeros(0, np.uint64))
                continue
            k = min(width, n)
            rolled = np.full(n - k + 1, np.uint64(k))
            for i in range(k):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + word[start + i : end - k + 1 + i]
            rolled = mix(rolled)
            rolled.sort()
            keep = np.ones(len(rolled), bool)
            keep[1:] = rolled[1:] != rolled[:-1]
            sets.append(rolled[keep])
    return sets


def set_ids(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a, b = np.add.reduce(hashes), np.add.reduce(mix(hashes ^ np.uint64(0xA5A5A5A5)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def band_of(n: int) -> int:
    """The band whose smallest set is at most ``n``: bounds grow by 4/3, rounded up to whole numbers."""
    return int(np.searchsorted(_LOWS, n, side="right")) - 1


def _lows() -> np.ndarray:
    lows = [1]
    while lows[-1] < 2**40:
        lows.append(-(-4 * lows[-1] // 3))  # a set of the next band is over 4/3 of all below but the last
    return np.array(lows, np.int64)


_LOWS = _lows()


def band_difference(band: int) -> int:
    """The largest symmetric difference of a linked pair whose smaller set lies in the band."""
    largest = int(_LOWS[band + 1]) - 1
    return (largest + 4 * largest // 3) // 7


def least_shared(band: int) -> int:
    """Keys that the lists of a linked pair share at least."""
    return 1 + band_difference(band) // 8


def part_keys(hashes: np.ndarray, band: int) -> np.ndarray:
    """Keys of the first ``D + t`` parts in hash order, empty parts last."""
    need = band_difference(band) + least_shared(band)
    parts = need + need // 4 + 8  # more than needed, so that empty ones seldom count
    scrambled = mix(hashes ^ np.uint64(band * 2 + 1))
    part = (scrambled >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    parity = np.bitwise_xor.reduceat(hashes[order], heads)
    salt = np.uint64((band + 1) * 0x1000000)
    keys = np.sort(mix(parity ^ mix(part[heads] + salt)))[:need]
    if len(keys) < need:  # too few parts in use: empty ones follow, in order of their number
        unused = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[heads])[: need - len(keys)]
        keys = np.concatenate([keys, mix(unused + salt + np.uint64(0x7FFF000000000000))])
    return keys


def sketch_bits(n: int) -> int:
    return min(4096, max(64, 1 << int(2 * n - 1).bit_length()))


def parity_bits(hashes: np.ndarray) -> bytes:
    """Each shingle flips one bit; 4096 bits at most, fewer for small sets."""
    bits = sketch_bits(len(hashes))
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def shingled(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_shingles`` and the set's 128 bits ``set_a``, ``set_b`` (0 without words)."""
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(batch.schema.names.index(text)))
            ids = [set_ids(s) for s in sets]
            yield [pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64())]

    return append(docs, [T.StructField(n, T.LongType()) for n in SET], run)


def _slices(docs: DataFrame, slices: int) -> DataFrame:
    """Part keys dealt into ``slices`` by key: per slice and batch packed 40-bit keys with 23-bit row numbers and a
    bit for lists of the band below, next to the ids of the rows."""
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            keys, owners = [], []
            for at, own in enumerate(shingle_sets(batch.column(1))):
                if len(own):
                    band = band_of(len(own))
                    for low in (0, 1) if band else (0,):
                        keys.append(part_keys(own, band - low))
                        owners.append(np.full(len(keys[-1]), 2 * at + low, np.uint64))
            if not keys:
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            slice_of = key % np.uint64(slices)
            packed = ((key // np.uint64(slices)) & np.uint64(2**40 - 1)) << np.uint64(24) | owner
            order = np.argsort(slice_of, kind="stable")
            packed, slice_of = packed[order], slice_of[order]
            heads = np.flatnonzero(np.concatenate([[True], slice_of[1:] != slice_of[:-1]]))
            out: list[list] = [[], [], []]
            for start, end in zip(heads.tolist(), [*heads[1:].tolist(), len(packed)], strict=True):
                part = packed[start:end]
                used, own = np.unique(part >> _ONE & np.uint64(2**23 - 1), return_inverse=True)
                out[0].append(int(slice_of[start]))
                out[1].append((part & ~np.uint64(2**24 - 2) | own.astype(np.uint64) << _ONE).tobytes())
                out[2].append(ids[used.astype(np.int64)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["slice", "packed", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "slice long, packed binary, ids binary")


def shared_keys(docs: DataFrame, slices: int) -> DataFrame:
    """``(key, doc, low)`` for keys that several documents list; ``low`` marks lists of the band below.

    ``docs`` hold no two equal sets under different ids.
    """
    def run(group: pa.Table) -> pa.Table:
        keys, docs_of, base = [], [], 0
        for packed, ids in zip(group.column("packed"), group.column("ids"), strict=True):
            docs_of.append(np.frombuffer(ids.as_buffer(), np.int64))
            raw = np.frombuffer(packed.as_buffer(), np.uint64)
            keys.append(np.stack([raw >> np.uint64(24), (raw >> _ONE & np.uint64(2**23 - 1)) + np.uint64(base), raw & _ONE]))
            base += len(docs_of[-1])
        key, at, low = np.concatenate(keys, axis=1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        again = key[1:] == key[:-1]
        several = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        key, order = key[several], order[several]
        doc, low = np.concatenate(docs_of)[at[order].astype(np.int64)], low[order].astype(np.int64)
        order = np.lexsort((doc, key))
        key, doc, low = key[order], doc[order], low[order]
        if len(key):  # repeated rows of a document count once
            keep = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, doc, low = key[keep], doc[keep], low[keep]
            again = key[1:] == key[:-1]
            several = np.concatenate([again, [False]]) | np.concatenate([[False], again])
            key, doc, low = key[several], doc[several], low[several]
        whole = key.astype(np.int64) * slices + group.column("slice")[0].as_py()
        return pa.table({"key": pa.array(whole, pa.int64()), "doc": pa.array(doc, pa.int64()), "low": pa.array(low, pa.int64())})

    return _slices(docs, slices).groupBy("slice").applyInArrow(run, "key long, doc long, low long")


def enough_keys(shared: DataFrame, every: DataFrame) -> DataFrame:
    """``(key, doc, lead)`` of lists that share enough keys; ``lead`` is the lowest set of the key."""
    bands = F.array(*[F.lit(int(x)) for x in _LOWS])
    least = F.array(*[F.lit(least_shared(b)) for b in range(len(_LOWS) - 1)])
    lists = shared.groupBy("doc", "low").agg(F.count(F.lit(1)).alias("keys"))
    sizes = every.filter("n_shingles > 0").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    band = F.size(F.filter(bands, lambda x: x <= F.col("n"))) - F.col("low")
    fit = lists.join(sizes, "doc").filter(F.col("keys") >= F.element_at(least, band.cast("int"))).select("doc", "low").distinct()
    rows = cut(shared.join(bounded(fit, FEW), ["doc", "low"], "left_semi").select("key", "doc"))
    leads = rows.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).filter("lead <> last").select("key", "lead")
    return cut(rows.join(cut(leads), "key").select("key", "doc", "lead"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc, n, bits, members)`` of the wanted ids, written once."""
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            once = list({(i, *set_ids(s)): k for k, (i, s) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True))}.values())
            batch, sets = batch.take(pa.array(once, pa.int64())), [sets[k] for k in once]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([parity_bits(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], names=["doc", "n", "bits", "members"])

    chosen = docs.join(wanted, docs["doc_id"] == wanted["doc"], "left_semi").select("doc_id", "text")
    return cut(chosen.mapInArrow(run, "doc long, n long, bits binary, members binary"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose sets link."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (one, two) if len(one) <= len(two) else (two, one)
                if 4 * len(small) < 3 * len(large):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep.append(linked(int((large[at] == small).sum()), len(small), len(large)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    near = bounded(pairs, FEW)
    leads = bounded(near.select(F.col("a").alias("lead")).distinct(), FEW)
    members = sets.select("doc", "members")
    half = members.join(near, F.col("doc") == F.col("b")).select("a", "b", F.col("members").alias("y"))
    lead = members.join(leads, F.col("doc") == F.col("lead"), "left_semi").select("doc", F.col("members").alias("x"))
    both = half.join(lead, F.col("a") == F.col("doc")).select("a", "b", "x", "y")
    return cut(both.mapInArrow(run, "a long, b long"))


def _unrefused(rows: DataFrame) -> DataFrame:
    """Pairs across components of one key that the sketches can't refuse, block by block.

    ``rows(key, doc, comp, n, bits)``.  Keys with over ``BLOCK`` sets are dealt into blocks, and each two blocks are
    compared apart from the others, so no key is ever gathered whole.  Keys with one lowest set share few packs, where
    a pair that meets in many of them comes up once; they are at most as many as that set lists.
    """
    packs = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("doc").alias("lowest"))
    dealt = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    near = F.xxhash64("lowest", F.pmod("key", F.lit(KEY_SHARES)), "i", "j")
    dealt = dealt.select(F.pmod(near, F.lit(packs)).alias("pack"), "key", "i", "j", "own", "doc", "comp", "n", "bits")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key, i, j, own, doc, comp, n = (group.column(c).to_numpy() for c in ("key", "i", "j", "own", "doc", "comp", "n"))
        bits = group.column("bits").to_pylist()
        found: set[tuple[int, int]] = set()
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        for start, end in zip(heads.tolist(), [*heads[1:].tolist(), len(key)], strict=True):
            at = np.arange(start, end)
            first, second = at[own[start:end] == i[start]], at[own[start:end] == j[start]]
            compare = _near_few if len(first) * len(second) <= 64 else _near_many
            compare(found, first, second, doc, comp, n, bits)
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("pack").applyInArrow(run, "a long, b long").distinct()


def _near_few(found, first, second, doc, comp, n, bits) -> None:
    marks = {int(k): int.from_bytes(bits[k]) for k in {*first.tolist(), *second.tolist()}}
    for x in first.tolist():
        for y in second.tolist():
            small, large = sorted((int(n[x]), int(n[y])))
            if comp[x] == comp[y] or 4 * small < 3 * large:
                continue
            one, two = (marks[x], len(bits[x])), (marks[y], len(bits[y]))
            while one[1] != two[1]:  # fold the longer sketch onto the shorter
                one, two = sorted((one, two), key=lambda m: m[1])
                half = 4 * two[1]
                two = (two[0] >> half ^ two[0] & (1 << half) - 1, two[1] // 2)
            if 7 * (one[0] ^ two[0]).bit_count() <= small + large:
                found.add((min(int(doc[x]), int(doc[y])), max(int(doc[x]), int(doc[y]))))


def _near_many(found, first, second, doc, comp, n, bits) -> None:
    lengths = np.array([8 * len(bits[k]) for k in second])
    folded: dict[int, np.ndarray] = {}

    def fold(raw: bytes, size: int) -> np.ndarray:
        return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size // 8), axis=0)

    for x in first.tolist():
        own = 8 * len(bits[x])
        fit = np.flatnonzero((comp[second] != comp[x]) & (4 * np.minimum(n[x], n[second]) >= 3 * np.maximum(n[x], n[second])))
        for size in np.unique(np.minimum(lengths[fit], own)).tolist():
            if size not in folded:
                folded[size] = np.stack([fold(bits[k], size) if 8 * len(bits[k]) >= size else np.zeros(size // 8, np.uint8) for k in second])
            some = fit[np.minimum(lengths[fit], own) == size]
            apart = np.bitwise_count(folded[size][some] ^ fold(bits[x], size)).sum(axis=1, dtype=np.int64)
            for o in doc[second[some[7 * apart <= n[x] + n[second[some]]]]].tolist():
                found.add((min(int(doc[x]), o), max(int(doc[x]), o)))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row: the lowest id that links of 0.75 or more reach."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = cut(shingled(own).drop("text"))
    lowest = every.filter("n_shingles > 0 and doc_id is not null").groupBy(*SET)
    lowest = cut(lowest.agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")))
    # equal sets go on under their lowest id only
    copied = lowest.filter("node <> last").drop("last")
    mark = F.struct(*SET)
    ids = every.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"))
    mixed_ids, mixed = cut_counted(ids.filter("lo <> hi").select("doc_id"))  # ids of several sets: none, as a rule
    copies = every.join(copied, SET).filter("doc_id <> node").select("doc_id").distinct().join(mixed_ids, "doc_id", "left_anti")
    single = own.filter("doc_id is not null").join(bounded(copies, FEW), "doc_id", "left_anti")
    shared = enough_keys(cut(shared_keys(single, slices)), every)
    # per set one pair, with the lowest set of most of its keys
    stars = shared.filter("doc <> lead").groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("keys"))
    stars = stars.groupBy("doc").agg(F.min_by("lead", F.struct(-F.col("keys"), "lead")).alias("lead"))
    stars = cut(stars.select(F.col("lead").alias("a"), F.col("doc").alias("b")))
    sets = _sets(own, bounded(shared.select("doc").distinct(), FEW))
    links = _verified(stars, sets)
    nodes = sets.select(F.col("doc").alias("node")).distinct()
    comps = bounded(components(nodes, links).select("node", "component"), FEW)
    open_rows = shared.select("key", "doc").join(comps, F.col("doc") == F.col("node")).select("key", "doc", F.col("component").alias("comp"))
    open_rows = cut(open_rows)
    open_keys = open_rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("doc").alias("x"), F.max("doc").alias("y"), F.count(F.lit(1)).alias("k"))
    tried = bounded(stars, FEW)  # a key of two sets that were verified already is settled
    open_keys = open_keys.filter("lo <> hi").join(tried, (F.col("k") == 2) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left_anti").select("key")
    rows, left = cut_counted(open_rows.join(open_keys, "key", "left_semi"))
    if left:
        links = links.union(_verified(_unrefused(rows.join(sets.drop("members"), "doc")), sets))
    bridges = _bridges(every, lowest, mixed_ids)
    if left or mixed:
        links = links.union(bridges)
        nodes = nodes.union(bridges.select("a")).union(bridges.select("b")).distinct()
        comps = components(nodes, links).select("node", "component")
    joined = lowest.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    moved = cut(joined.filter("component <> last or node <> last").select(*SET, "component"))
    out = every.join(moved, SET, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _bridges(every: DataFrame, lowest: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs of nodes whose sets share one of ``ids``."""
    own = every.join(ids, "doc_id", "left_semi").select("doc_id", *SET).join(lowest, SET).select("doc_id", "node")
    first = own.groupBy("doc_id").agg(F.min("node").alias("a"))
    return own.join(first, "doc_id").select("a", F.col("node").alias("b")).distinct()


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` without those that a lower doc_id stands for; rows that share a doc_id stay together."""
    gone = jaccard_classes(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = bounded(gone, FEW)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
