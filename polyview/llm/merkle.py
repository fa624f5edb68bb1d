"""Merkle manifest of a table on a SHA-256 midstate tree.

A leaf is the hash of a row's fields; ``FAN`` consecutive nodes become the hash of their digests until one is left per
tree (a source), and the trees' roots, in order of their sources, become one root by the same rule.

* A digest is 64 letters, which is one SHA-256 block.  So the state of a parent's hash before each of its child slots is
  eight words, and the manifest keeps those states next to the children (``states``: 32 bytes a slot).
* Folding a changed leaf takes, at each level, the state kept before its slot and runs on with the replacement and the
  siblings to the right; siblings to the left are never hashed again.
* Rows are numbered inside a tree over range tiles, so no tree passes through one task.  Each level is one grouping of 16
  rows a key.  Paths come down from the root by joins on unique keys: a run of 16 leaves learns the path all of them
  share, and no level is collected.

Defined cases: null fields hash as ``-``; a null doc_id comes first in its tree and is never tampered with; equal doc_ids stand in
order of their leaves, so repeated rows (equal leaves) give equal digests wherever they stand, though each has its own place and
proof; a lone leaf is its tree's root; without siblings the proof is the hash of no input; an empty table has no rows; texts
of any length are hashed whole, on the JVM; columns beside the hashed ones don't take part and are not returned.

Numbers inside a tree come from ``polyview.plans.scan``; all else is here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.llm.common import append
from polyview.plans.scan import along, group_size, number
from polyview.session import cut

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LANES = 4096  # hashes that advance side by side: their words fit a core's cache
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found if p <= isqrt(k)):
            found.append(k)
        k += 1
    return found


def _root_bits(value: int, degree: int) -> int:
    """The first 32 bits behind the point of the root of that degree, in whole numbers."""
    target = value << (32 * degree)
    low, high = 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**degree <= target else (low, mid)
    return low & 0xFFFFFFFF


# SHA-256's constants by their rule: fractions of cube and square roots of the first primes.
ROUNDS = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)


def _turned(x: np.ndarray, *bits: int) -> np.ndarray:
    """The exclusive or of ``x`` turned right by each of ``bits``."""
    return reduce(np.bitwise_xor, [(x >> np.uint32(b)) | (x << np.uint32(32 - b)) for b in bits])


def _advance(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    words = [np.ascontiguousarray(w) for w in block.T]
    for t in range(16, 64):
        near, far = words[t - 2], words[t - 15]
        near = _turned(near, 17, 19) ^ (near >> np.uint32(10))
        far = _turned(far, 7, 18) ^ (far >> np.uint32(3))
        words.append(near + words[t - 7] + far + words[t - 16])
    a, b, c, d, e, f, g, h = start = [np.ascontiguousarray(s) for s in state.T]
    for word, constant in zip(words, ROUNDS, strict=True):
        one = h + _turned(e, 6, 11, 25) + (g ^ (e & (f ^ g))) + constant + word
        two = _turned(a, 2, 13, 22) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([x + y for x, y in zip((a, b, c, d, e, f, g, h), start, strict=True)], axis=1)


def advance(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (rows of 8 words) after one more block each (rows of 16 words)."""
    parts = [_advance(state[i : i + LANES], block[i : i + LANES]) for i in range(0, len(state), LANES)]
    return np.concatenate(parts) if parts else state.copy()


def finished(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests, as blocks of hex letters, of hashes that have taken ``blocks`` whole blocks."""
    end = np.zeros((len(state), 16), np.uint32)
    end[:, 0] = 1 << 31
    end[:, 14], end[:, 15] = blocks.astype(np.uint64) * 512 >> 32, (blocks.astype(np.uint64) * 512) & 0xFFFFFFFF
    return as_blocks(advance(state, end).astype(">u4").tobytes().hex())


def as_blocks(digests: str) -> np.ndarray:
    """Digests in a row, as blocks of 16 words."""
    return np.frombuffer(digests.encode(), ">u4").astype(np.uint32).reshape(-1, 16)


def as_digests(blocks: np.ndarray) -> list[str]:
    text = blocks.astype(">u4").tobytes().decode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def slot_states(children: list[str]) -> tuple[list[bytes], list[str]]:
    """For parents given as their children's digests in a row: the states before each slot, and the parents' digests."""
    counts = np.array([len(c) // 64 for c in children], np.int64)
    blocks, first = as_blocks("".join(children)), np.cumsum(counts) - counts
    state = np.tile(START, (len(children), 1))
    kept = np.zeros((len(children), max(counts, default=0), 8), np.uint32)
    for slot in range(kept.shape[1]):
        open_ = np.flatnonzero(counts > slot)
        kept[open_, slot] = state[open_]
        state[open_] = advance(state[open_], blocks[first[open_] + slot])
    raw = kept.astype(">u4")
    return [raw[i, :c].tobytes() for i, c in enumerate(counts)], as_digests(finished(state, counts))


def resumed(states: np.ndarray, new: np.ndarray, rights: list[str], slots: np.ndarray) -> np.ndarray:
    """The parents' digests (blocks) with ``new`` in a slot: from the state before it, over it and ``rights``, the siblings behind it."""
    counts = np.array([len(r) // 64 for r in rights], np.int64)
    blocks, first = as_blocks("".join(rights)), np.cumsum(counts) - counts
    state = advance(states, new)
    for k in range(max(counts, default=0)):
        open_ = np.flatnonzero(counts > k)
        state[open_] = advance(state[open_], blocks[first[open_] + k])
    return finished(state, slots + 1 + counts)


def leaf(fields: Sequence[Column]) -> Column:
    """The hash of the fields: ``-`` for null, else the length in bytes, a colon and the value."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(tree, doc_id, leaf, changed)`` per row; ``changed`` is the leaf with A to Z of the text in lower case, where ``tampered`` holds."""
    own = leaf([F.col(c) for c in FIELDS])
    low = leaf([F.translate("text", UPPER, UPPER.lower()) if c == "text" else F.col(c) for c in FIELDS])
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # the null source comes first
    changed = F.when(F.coalesce(tampered, F.lit(False)), low) if tampered is not None else F.lit(None).cast("string")
    return docs.select(tree.alias("tree"), "doc_id", own.alias("leaf"), changed.alias("changed"))


@dataclass(frozen=True)
class Manifest:
    """``runs(tree, pos, n, docs, children, states, digest)``: up to 16 leaves in order; ``levels``: their parents and so on, without
    ``docs``; ``top``: the levels over the trees' roots; ``roots(tree, pos, n, digest)``; ``root``: the digest of all (none: no rows).

    ``n`` counts the nodes of the tree on the row's level (of ``runs``: its leaves' level too, as ``size``).
    """

    runs: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame
    root: str | None


def _with_states(parents: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            states, digests = slot_states(batch.column(batch.schema.names.index("children")).to_pylist())
            yield [pa.array(states, pa.binary()), pa.array(digests, pa.string())]

    return append(parents, [T.StructField("states", T.BinaryType()), T.StructField("digest", T.StringType())], run)


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``nodes(tree, pos, n, digest)``, lowest first; trees of one node have none."""
    out = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        keys = ["tree", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("n") / FAN).alias("n")]
        grouped = nodes.filter("n > 1").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("__c"))
        children = grouped.select("tree", "pos", "n", F.array_join(F.col("__c.digest"), "").alias("children"))
        nodes = cut(_with_states(children))
        out.append(nodes)
        most = -(-most // FAN)
    return out


def build(rows: DataFrame) -> Manifest:
    """The manifest of ``rows(tree, doc_id, leaf, changed)``, written level by level to the shared folder."""
    ordered = along(cut(rows), ["tree"], [F.col("doc_id"), F.col("leaf")], {"place": number(), "size": group_size()}, fits=False)
    place = F.col("place") - 1
    docs = F.array_sort(F.collect_list(F.struct(place.alias("place"), "doc_id", "leaf", "changed")))
    runs = ordered.groupBy("tree", F.floor(place / FAN).alias("pos"), "size").agg(docs.alias("docs"))
    runs = runs.select("*", F.ceil(F.col("size") / FAN).alias("n"), F.array_join(F.col("docs.leaf"), "").alias("children"))
    lone = F.col("size") == 1
    runs = cut(_with_states(runs).withColumn("digest", F.when(lone, F.col("children")).otherwise(F.col("digest"))))
    levels = _levels(runs.select("tree", "pos", "n", "digest"))
    ends = [x.filter("n = 1").select("tree", "digest") for x in [runs, *levels]]
    roots = along(cut(reduce(DataFrame.union, ends)), [], [F.col("tree")], {"place": number(), "n": group_size()}, fits=False)
    roots = cut(roots.select("tree", (F.col("place") - 1).alias("pos"), "n", "digest"))
    top = _levels(roots.select(F.lit("").alias("tree"), "pos", "n", "digest"))
    last = (top[-1] if top else roots).select("digest").first()
    return Manifest(runs, levels, top, roots, last[0] if last else None)


STEP = "struct<left:string,right:string,state:binary>"


def _below(parents: DataFrame) -> DataFrame:
    """``(tree, pos, path)`` of the children of ``parents(..., path)``: their own step before their parent's path."""
    at = F.col("__slot")
    step = F.struct(
        F.substring("children", F.lit(1), at * 64).alias("left"),
        F.substring("children", at * 64 + 65, F.length("children")).alias("right"),
        F.substring("states", at * 32 + 1, F.lit(32)).alias("state"),
    )
    slots = F.explode(F.sequence(F.lit(0), (F.length("children") / 64 - 1).cast("int"))).alias("__slot")
    own = parents.select("tree", "pos", "children", "states", "path", slots)
    return own.select("tree", (F.col("pos") * FAN + at).alias("pos"), F.concat(F.array(step), "path").alias("path"))


def _paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """``(tree, pos, path)`` of the nodes below ``levels``; ``ends(tree, path)`` are the paths of the trees' roots."""
    found = None
    for level in reversed(levels):
        start = level.filter("n = 1").select("tree", "pos", "children", "states").join(ends, "tree")
        if found is not None:
            start = start.unionByName(level.filter("n > 1").select("tree", "pos", "children", "states").join(found, ["tree", "pos"]))
        found = _below(start)
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row of the manifest.

    ``folded_root`` is the root that follows from ``changed`` (the leaf, where that is null) and the stored siblings.
    """
    nothing = F.array().cast(f"array<{STEP}>").alias("path")
    above = _paths(manifest.top, manifest.roots.sparkSession.createDataFrame([("",)], "tree string").select("tree", nothing))
    roots = manifest.roots.select("tree", "pos", F.col("digest").alias("subroot"))
    ends = roots.join(above.drop("tree"), "pos") if above is not None else roots.select("*", nothing)
    ends = cut(ends.select("tree", "subroot", "path"))
    runs = manifest.runs.select("tree", "pos", "n", "docs", F.when(F.col("size") > 1, F.col("states")).alias("states"))
    inner = _paths(manifest.levels, ends.select("tree", "path"))
    with_path = runs.filter("n = 1").join(ends.select("tree", "path"), "tree")
    if inner is not None:
        with_path = with_path.unionByName(runs.filter("n > 1").join(inner, ["tree", "pos"]))
    with_path = with_path.join(ends.select("tree", "subroot"), "tree")
    root = manifest.root
    kind = manifest.runs.schema["docs"].dataType.elementType["doc_id"].dataType
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, T.StringType()) for n in names] + [T.StructField("verified", T.BooleanType())])

    def run(batches):
        for batch in batches:
            rows = batch.select(["docs", "states", "path", "subroot"]).to_pylist()
            docs = [(d, i, k) for i, r in enumerate(rows) for k, d in enumerate(r["docs"])]
            leaves_ = [[d["leaf"] for d in r["docs"]] for r in rows]
            tails = ["".join(s["left"] + s["right"] for s in r["path"]) for r in rows]
            proof = [hashlib.sha256(("".join(leaves_[i][:k] + leaves_[i][k + 1 :]) + tails[i]).encode()).hexdigest() for _, i, k in docs]
            folded = _folded(rows, docs, leaves_)
            columns = [pa.array([d["doc_id"] for d, _, _ in docs]), [d["leaf"] for d, _, _ in docs], [rows[i]["subroot"] for _, i, _ in docs]]
            columns += [[root] * len(docs), proof, folded, [f == root for f in folded]]
            columns[0] = columns[0].cast(batch.schema.field("docs").type.value_type.field("doc_id").type)
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=schema.names)

    return with_path.select("docs", "states", "path", "subroot").mapInArrow(run, schema)


def _folded(rows: list[dict], docs: list[tuple], leaves_: list[list[str]]) -> list[str]:
    """The root from each document's leaf (changed, if it is): replaced nodes that several share are folded once a level."""
    home = np.array([i for _, i, _ in docs], np.int64)
    slot = np.array([k for _, _, k in docs], np.int64)
    digest = as_blocks("".join(d["changed"] or d["leaf"] for d, _, _ in docs))
    in_run = np.flatnonzero([rows[i]["states"] is not None for i in home])
    if len(in_run):
        kept = np.stack([np.frombuffer(rows[home[x]]["states"], ">u4").astype(np.uint32).reshape(-1, 8)[slot[x]] for x in in_run])
        digest[in_run] = resumed(kept, digest[in_run], ["".join(leaves_[home[x]][slot[x] + 1 :]) for x in in_run], slot[in_run])
    for depth in range(max((len(r["path"]) for r in rows), default=0)):
        open_ = np.flatnonzero([len(rows[i]["path"]) > depth for i in home])
        keyed = np.concatenate([home[open_, None].astype(np.uint32), digest[open_]], axis=1)
        _, first, back = np.unique(keyed, axis=0, return_index=True, return_inverse=True)
        chosen = open_[first]
        steps = [rows[i]["path"][depth] for i in home[chosen]]
        kept = np.stack([np.frombuffer(s["state"], ">u4").astype(np.uint32) for s in steps])
        new = resumed(kept, digest[chosen], [s["right"] for s in steps], np.array([len(s["left"]) // 64 for s in steps], np.int64))
        digest[open_] = new[back.reshape(-1)]
    return as_digests(digest)
