"""Toxicity scores from a small convolutional text classifier.

Words are hashed into embedding rows; filters of several widths slide over the whole text, the
strongest response of each filter is kept (max pooling) and a linear layer with a sigmoid scores it.
``train_all`` trains on every labelled row with its whole text: ids fall into hash shards of about ``SAMPLE`` ids or ``WORDS`` words, each
shard takes steps of Adam in numpy from the shared state, and after each of ``ROUNDS`` rounds the shards' states are averaged.  A word's
count of texts covers all rows, too.  A fifth of the ids never trains; the shared state with the least loss on it is kept.
``train`` fits a bounded sample on the driver: the first ``SAMPLE`` ids in hash order with ``WORDS`` words (a text that doesn't fit any more is
passed over).  Scoring covers every word of every text.

The raw score depends on the text alone.  Thresholds are calibrated per language on the rows that the
fit doesn't see: of all cuts, the one with the best F1, pulled towards the overall cut where
a language has few toxic rows.  ``score`` then is rescaled by the overall cut, so that 0.7 is that cut, and
``flagged`` compares with the cut of the row's language (the overall one for languages that weren't seen).

Defined cases: null, empty and wordless texts score what a text without words scores; null labels
and rows without text don't train; a repeated id trains once, with its lowest text, as toxic if any of its labels says so.  Without both
classes in the rows that train all scores are 0.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.llm.common import append, without
from polyview.session import cut, cut_counted

ROWS = 1 << 18  # embedding rows; row 0 stands for nothing
SAMPLE = 16000  # ids of a shard, about; labelled rows that ``train`` fits at most
WORDS = 10_000_000  # words of a shard, about, and of the rows that ``train`` fits: 40 MB
SEEN = 1000  # a word must occur in 1 of so many labelled texts, and in 3; all others embed as zero
ROUNDS, STEPS = 6, 400  # shared states, and steps of a shard between two of them
KNOWN = 1_000_000  # labelled ids that are broadcast at most
PIECE = 4096  # numbers of a state that are averaged at once
BINS = 200  # cuts of ``train_all`` lie between bins of the logit, so many a unit
CHUNK = 200_000  # words scored at once
CUT = 0.7


@dataclass
class Model:
    """Embeddings (rows x dims), per width a filter bank (width, dims, filters) with bias, and the output layer."""

    table: np.ndarray
    banks: list[tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    bias: float
    cut: float  # raw score that counts as toxic
    cuts: dict[str, float]  # the same by language, on the scale of ``score``

    def rescale(self, raw: np.ndarray) -> np.ndarray:
        """Monotone, 0 and 1 stay, the overall cut becomes ``CUT``."""
        return np.where(raw < self.cut, raw / self.cut * CUT, CUT + (raw - self.cut) / max(1e-9, 1 - self.cut) * (1 - CUT))


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words of all texts, and where each text ends.

    Words are runs between white space, in lower case and without marks at their ends.
    """
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    coded = words.flatten().dictionary_encode()
    names = pc.utf8_trim(coded.dictionary, characters="%*#$&.,;:!?\"'()[]<>").to_pylist()
    rows = np.fromiter((1 + xxhash.xxh32_intdigest(w) % (ROWS - 1) if w else 0 for w in names), np.int32, len(names))
    codes = coded.indices.to_numpy()
    found = rows[codes]
    ends = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
    keep = found > 0
    return found[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def _pooled(model: Model, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The strongest response of every filter in each text (0 where a text is shorter than the filter)."""
    return np.concatenate([_bank(model, k, rows, ends)[0] for k in range(len(model.banks))], axis=1)


def _bank(model: Model, k: int, rows: np.ndarray, ends: np.ndarray, places: bool = False):
    weights, bias = model.banks[k]
    width = len(weights)
    n, filters = len(ends), weights.shape[2]
    best = np.zeros((n, filters), np.float32)
    where = np.full((n, filters), -1, np.int64)
    if len(rows) < width:
        return best, where
    x = model.table[rows]
    count = len(rows) - width + 1
    response = np.broadcast_to(bias, (count, filters)).astype(np.float32)
    for i in range(width):
        response += x[i : count + i] @ weights[i]
    starts = np.concatenate([[0], ends[:-1]])
    fits = np.flatnonzero(ends - starts >= width)
    # responses that cross the end of a text don't count
    for i in range(1, width):
        cross = ends[:-1] - i
        response[cross[(cross >= 0) & (cross < count)]] = -np.inf
    if len(fits):
        best[fits] = np.maximum(0, np.maximum.reduceat(response, starts[fits], axis=0))
        if places:
            owner = np.repeat(np.arange(n), ends - starts)[:count]
            for f in range(filters):
                hit = np.flatnonzero((response[:, f] == best[owner, f]) & (response[:, f] > 0))
                where[owner[hit[::-1]], f] = hit[::-1]
    return best, where


def _places(model: Model, k: int, rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_bank`` with the winning places; texts of more than ``CHUNK`` words go in overlapping runs."""
    starts = np.concatenate([[0], ends[:-1]])
    if not len(ends) or (ends - starts).max() <= CHUNK:
        return _bank(model, k, rows, ends, places=True)
    best, where = [], []
    for start, end in zip(starts, ends, strict=True):
        top, at = None, None
        for lo in range(start, max(start + 1, end), CHUNK):
            own = rows[lo : min(end, lo + CHUNK + len(model.banks[k][0]) - 1)]
            b, w = _bank(model, k, own, np.array([len(own)]), places=True)
            w = np.where(w >= 0, w + lo, w)
            top, at = (b, w) if top is None else (np.maximum(top, b), np.where(b > top, w, at))
        best.append(top)
        where.append(at)
    return np.concatenate(best), np.concatenate(where)


def raw_scores(model: Model, texts: pa.Array) -> np.ndarray:
    return _raw(model, *word_rows(texts))


def _raw(model: Model, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ends), np.float64)
    at = 0
    while at < len(ends):  # whole texts, about CHUNK words at a time
        start = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + CHUNK, side="right")))
        own = ends[at:to] - start
        pooled = _pooled_long(model, rows[start : ends[to - 1]]) if own[-1] > 2 * CHUNK else _pooled(model, rows[start : ends[to - 1]], own)
        out[at:to] = 1 / (1 + np.exp(-(pooled @ model.out + model.bias)))
        at = to
    return out


def _pooled_long(model: Model, rows: np.ndarray) -> np.ndarray:
    """One very long text in overlapping runs: the maximum over runs is that of the text."""
    widest = max(len(w) for w, _ in model.banks) - 1
    runs = [rows[max(0, s - widest) : s + CHUNK] for s in range(0, len(rows), CHUNK)]
    return np.max([_pooled(model, r, np.array([len(r)])) for r in runs], axis=0)


def fit(texts: pa.Array, labels: np.ndarray, langs: list[str], **options) -> Model:
    """``fit_rows`` of texts."""
    return fit_rows(*word_rows(texts), labels, langs, **options)


def _fresh(rng: np.random.Generator, dims: int = 8, filters: int = 8, widths: tuple[int, ...] = (1, 2, 3)) -> Model:
    model = Model(
        rng.normal(0, 0.1, (ROWS, dims)).astype(np.float32),
        [(rng.normal(0, 1 / math.sqrt(w * dims), (w, dims, filters)).astype(np.float32), np.zeros(filters, np.float32)) for w in widths],
        rng.normal(0, 0.5, len(widths) * filters).astype(np.float32), 0.0, CUT, {},
    )
    model.table[0] = 0
    return model


def _never(model: Model) -> Model:
    """Scores of 0 for every text."""
    model.out[:], model.bias = 0, -50.0
    return model


def fit_rows(rows: np.ndarray, ends: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7, dims: int = 8, filters: int = 8,
        widths: tuple[int, ...] = (1, 2, 3), steps: int = 3000, batch: int = 32, rate: float = 0.01) -> Model:
    """Train on four fifths of the texts, calibrate the cuts on the rest."""
    rng = np.random.default_rng(seed)
    model = _fresh(rng, dims, filters, widths)
    if len(set(labels.tolist())) < 2:
        return _never(model)
    rows, ends, labels = np.asarray(rows), np.asarray(ends), np.asarray(labels)
    starts = np.concatenate([[0], ends[:-1]])
    texts_of = np.zeros(ROWS, np.int32)
    for start, end in zip(starts, ends, strict=True):
        texts_of[np.unique(rows[start:end])] += 1
    rare = texts_of < max(3, len(ends) / SEEN)
    model.table[rare] = 0
    rows = np.where(rare[rows], np.int32(0), rows)
    order = rng.permutation(len(ends))
    held = order[: len(order) // 5]
    train = order[len(order) // 5 :]
    model.bias = float(np.log((labels[train].sum() + 1) / (len(train) - labels[train].sum() + 1)))
    heavy = _heavy(int(labels[train].sum()), len(train))
    state = _Adam(model, rate)
    best, kept = math.inf, copy.deepcopy(model)
    queue = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(queue) < batch:
            queue = np.concatenate([queue, rng.permutation(train)])
        own, queue = queue[:batch], queue[batch:]
        piece = np.concatenate([rows[starts[k] : ends[k]] for k in own])
        _step(model, state, piece, np.cumsum(ends[own] - starts[own]), labels[own], heavy)
        if step % (steps // 10) == 0 and len(held):  # the state that does best on rows it doesn't see
            loss = _losses(_raw(model, np.concatenate([rows[starts[k] : ends[k]] for k in held]), np.cumsum(ends[held] - starts[held])), labels[held]).mean()
            if loss < best:
                best, kept = loss, copy.deepcopy(model)
    model = kept if best < math.inf else model
    raw = _raw(model, rows, ends)
    calm = held if 0 < labels[held].sum() < len(held) else order
    model.cut = min(0.98, max(0.02, _best_cut(raw[calm], labels[calm])))
    for lang in sorted(set(langs)):
        own = np.array([k for k in calm if langs[k] == lang], np.int64)
        toxic = int(labels[own].sum()) if len(own) else 0
        if 0 < toxic < len(own):
            trust = toxic / (toxic + 20)
            model.cuts[lang] = float(trust * model.rescale(np.array([_best_cut(raw[own], labels[own])]))[0] + (1 - trust) * CUT)
    return model


def _heavy(toxic: int, rows: int) -> float:
    """The weight of a toxic row."""
    return min(1.5, (rows - toxic) / max(1, toxic))


def _losses(raw: np.ndarray, labels: np.ndarray) -> np.ndarray:
    raw = np.clip(raw, 1e-6, 1 - 1e-6)
    return -np.where(labels == 1, np.log(raw), np.log(1 - raw))


def _best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of best F1."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    ranked = scores[order]
    after = np.append(ranked[1:], 0.0)
    f1[ranked == after] = -1  # a cut can't part equal scores
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = top[np.argmax(ranked[top] - after[top])]
    return float((ranked[k] + after[k]) / 2)


class _Adam:
    def __init__(self, model: Model, rate: float):
        self.rate, self.step = rate, 0
        self.table = (np.zeros_like(model.table), np.zeros_like(model.table))
        self.banks = [tuple((np.zeros_like(p), np.zeros_like(p)) for p in bank) for bank in model.banks]
        self.out = (np.zeros_like(model.out), np.zeros_like(model.out))
        self.bias = (np.zeros(1), np.zeros(1))

    def move(self, value: np.ndarray, grad: np.ndarray, moments: tuple, at=...) -> None:
        m, v = moments
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad**2
        scale = self.rate * math.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        value[at] -= (scale * m[at] / (np.sqrt(v[at]) + 1e-8)).astype(value.dtype)


def _step(model: Model, state: _Adam, rows: np.ndarray, ends: np.ndarray, labels: np.ndarray, heavy: float) -> None:
    """One step down the gradient of the weighted log loss; only the winning places of a filter get a share."""
    state.step += 1
    found = [_places(model, k, rows, ends) for k in range(len(model.banks))]
    pooled = np.concatenate([best for best, _ in found], axis=1)
    score = 1 / (1 + np.exp(-(pooled @ model.out + model.bias)))
    loss = ((score - labels) * np.where(labels == 1, heavy, 1.0) / len(labels)).astype(np.float32)
    back = loss[:, None] * model.out[None, :]
    touched: list[np.ndarray] = []
    grads: list[np.ndarray] = []
    at = 0
    for k, (weights, bias) in enumerate(model.banks):
        width, dims, filters = weights.shape
        own, where = back[:, at : at + filters], found[k][1]
        at += filters
        doc, f = np.nonzero(where >= 0)
        place, g = where[doc, f], own[doc, f]
        dw, db = np.zeros_like(weights), np.zeros_like(bias)
        np.add.at(db, f, g)
        for i in range(width):
            word = rows[place + i]
            touched.append(word)
            grads.append(g[:, None] * weights[i][:, f].T)
            per = np.zeros((filters, dims), np.float32)
            np.add.at(per, f, g[:, None] * model.table[word])
            dw[i] = per.T
        state.move(weights, dw, state.banks[k][0])
        state.move(bias, db, state.banks[k][1])
    state.move(model.out, loss @ pooled, state.out)
    bias = np.array([model.bias])
    state.move(bias, np.array([loss.sum()]), state.bias)
    model.bias = float(bias[0])
    if touched:
        word, back_to = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(word), model.table.shape[1]), np.float32)
        np.add.at(total, back_to, np.concatenate(grads))
        state.move(model.table, total[word > 0], state.table, word[word > 0])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 by 3 (null ids: as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> Model:
    """A model from labelled rows outside the held-out third.

    Texts are cut into words on the executors; the driver gets embedding rows of the sample alone.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    own = docs.select(F.col("doc_id"), F.col("text"), lang.cast("string").alias("lang")).filter("text is not null")
    own = own.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("r"))
    own = own.select(F.xxhash64("doc_id").alias("at"), "r.lang", "toxic", "r.text")

    def run(batches):
        for batch in batches:
            rows, ends = word_rows(batch.column(3))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends, prepend=0), pa.int64()), lists], names=["at", "lang", "toxic", "n", "rows"])

    found = cut(own.mapInArrow(run, "at long, lang string, toxic int, n long, rows array<int>"))
    sizes = found.select("at", "n").toPandas().sort_values(["at", "n"])  # two numbers per row of the sample
    fits, total = [], 0
    for at, n in zip(sizes["at"].tolist(), sizes["n"].tolist(), strict=True):
        if total + n <= words:
            fits.append((at,))
            total += n
    chosen = docs.sparkSession.createDataFrame(fits, "at long")
    first = found.join(F.broadcast(chosen), "at", "left_semi")
    first = first.toArrow().sort_by([("at", "ascending"), ("toxic", "ascending"), ("n", "ascending"), ("lang", "ascending")])
    rows = np.asarray(first.column("rows").combine_chunks().flatten(), np.int32)
    ends = np.cumsum(np.asarray(first.column("n"), np.int64))
    return fit_rows(rows, ends, np.array(first.column("toxic").to_pylist(), np.int64), [x or "" for x in first.column("lang").to_pylist()])


@dataclass
class _State:
    """What the shards share: a model over the words that occur often enough, its moments, and the number of steps."""

    model: Model
    adam: _Adam
    rows: np.ndarray  # place in the model's table of each embedding row

    def arrays(self) -> list[np.ndarray]:
        moments = [self.adam.table, *[m for bank in self.adam.banks for m in bank], self.adam.out, self.adam.bias]
        return [self.model.table, *[p for bank in self.model.banks for p in bank], self.model.out, *[a for pair in moments for a in pair]]

    def flat(self) -> np.ndarray:
        return np.concatenate([np.array([self.model.bias]), *[a.ravel() for a in self.arrays()]]).astype(np.float32)

    def fill(self, flat: np.ndarray) -> None:
        self.model.bias, at = float(flat[0]), 1
        for a in self.arrays():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size


def _labelled(docs: DataFrame, labels: DataFrame, sample: int, words: int) -> DataFrame:
    """``(shard, id, lang, toxic, held, rows)``: a row per labelled id outside the held-out third, its shard in one partition."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
    known, ids = cut_counted(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    own = docs.select(F.col("doc_id"), F.col("text"), lang.cast("string").alias("lang")).filter(F.col("text").isNotNull() & ~held_out())
    own = own.join(F.broadcast(known) if ids <= KNOWN else known, "doc_id")
    letters = own.agg(F.sum(F.octet_length("text").cast("double"))).first()[0] or 0.0
    shards = max(1, math.ceil(ids / sample), math.ceil(letters / 6 / words))
    own = own.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(4 * shards, "shard")  # so that few partitions hold two
    own = own.groupBy("shard", "doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("r"))

    @F.arrow_udf("array<int>")
    def coded(texts: pa.Array) -> pa.Array:
        rows, ends = word_rows(texts)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rows, pa.int32()))

    # ids of one shard share a remainder of the first hash, so a second one tells the fifth
    held = F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id")), F.lit(5)) == 0
    own = own.select("shard", F.xxhash64("doc_id").alias("id"), F.coalesce("r.lang", F.lit("")).alias("lang"), "toxic", held.alias("held"), coded("r.text").alias("rows"))
    return own.sortWithinPartitions("shard", "id")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A partition's shards one by one: their rows follow each other."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("shard").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for lo, hi in pairwise(edges.tolist()):
            if kept and hi > lo and kept[0].column("shard")[0].as_py() != keys[lo]:
                yield pa.Table.from_batches(kept)
                kept = []
            if hi > lo:
                kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept)


def _texts(group: pa.Table, place: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Rows, ends, labels and held flags of a shard in the order of its ids."""
    lists = group.column("rows").combine_chunks()
    rows = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)
    return rows if place is None else place[rows], ends, np.asarray(group.column("toxic"), np.int64), np.asarray(group.column("held").to_pylist(), bool)


def _taken(rows: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], ends[:-1]])
    return np.concatenate([rows[:0], *[rows[starts[k] : ends[k]] for k in at]]), np.cumsum(ends[at] - starts[at], dtype=np.int64)


def _round(shards: DataFrame, state: _State, heavy: float, steps: int, batch: int, seed: int) -> tuple[np.ndarray, float]:
    """The average of the states that the shards reach from ``state``, and the mean loss of ``state`` itself on rows that don't train."""
    shared = shards.sparkSession.sparkContext.broadcast(state)

    def stepped(group: pa.Table) -> pa.RecordBatch:
        own = copy.deepcopy(shared.value)
        rows, ends, labels, held = _texts(group, own.rows)
        unseen, train = np.flatnonzero(held), np.flatnonzero(~held)
        loss = _losses(_raw(own.model, *_taken(rows, ends, unseen)), labels[unseen]).sum() if len(unseen) else 0.0
        shard = group.column("shard")[0].as_py()
        rng = np.random.default_rng([seed, shard, own.adam.step])
        queue = np.zeros(0, np.int64)
        for _ in range(steps if len(train) else 0):
            while len(queue) < batch:
                queue = np.concatenate([queue, rng.permutation(train)])
            at, queue = queue[:batch], queue[batch:]
            _step(own.model, own.adam, *_taken(rows, ends, at), labels[at], heavy)
        flat = own.flat() if steps else np.zeros(1, np.float32)
        pieces = [flat[k : k + PIECE].tobytes() for k in range(0, len(flat), PIECE)]
        n = len(pieces)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([shard] * n, pa.int32()), "piece": pa.array(range(n), pa.int32()), "part": pa.array(pieces, pa.binary()),
            "n": pa.array([len(train)] * n, pa.int64()), "loss": pa.array([loss] * n, pa.float64()), "unseen": pa.array([len(unseen)] * n, pa.int64()),
        })

    def run(batches):
        for group in _shards(batches):
            yield stepped(group)

    def mean(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("shard")
        n = np.asarray(group.column("n"), np.float64)
        parts = np.stack([np.frombuffer(p, np.float32) for p in group.column("part").to_pylist()])
        part = (n / max(1.0, n.sum())) @ parts
        return pa.table({
            "piece": group.column("piece")[:1], "part": pa.array([part.tobytes()], pa.binary()),
            "loss": pa.array([pc.sum(group.column("loss")).as_py()], pa.float64()), "unseen": pa.array([pc.sum(group.column("unseen")).as_py()], pa.int64()),
        })

    told = shards.mapInArrow(run, "shard int, piece int, part binary, n long, loss double, unseen long")
    got = told.groupBy("piece").applyInArrow(mean, "piece int, part binary, loss double, unseen long").toArrow().sort_by("piece")
    flat = np.concatenate([np.frombuffer(p, np.float64) for p in got.column("part").to_pylist()])
    return flat, got.column("loss")[0].as_py() / max(1, got.column("unseen")[0].as_py())


def _counted(shards: DataFrame, state: _State, every: bool) -> DataFrame:
    """``(lang, bin, toxic, n)``: rows by the bin of their raw score, of the rows that don't train or of all."""
    shared = shards.sparkSession.sparkContext.broadcast(state)

    def told_of(group: pa.Table) -> pa.Table:
        rows, ends, labels, held = _texts(group, shared.value.rows)
        at = np.flatnonzero(held | every)
        raw = np.clip(_raw(shared.value.model, *_taken(rows, ends, at)), 1e-9, 1 - 1e-9)
        bins = np.floor(np.log(raw / (1 - raw)) * BINS).astype(np.int32)
        told = pa.table({"lang": group.column("lang").take(pa.array(at)), "bin": pa.array(bins, pa.int32()), "toxic": pa.array(labels[at], pa.int64())})
        counts = told.group_by(["lang", "bin"]).aggregate([("toxic", "sum"), ("toxic", "count")])
        return counts.select(["lang", "bin", "toxic_sum", "toxic_count"]).rename_columns(["lang", "bin", "toxic", "n"])

    def run(batches):
        for group in _shards(batches):
            yield from told_of(group).to_batches()

    told = shards.mapInArrow(run, "lang string, bin int, toxic long, n long")
    return cut(told.groupBy("lang", "bin").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")))


def _cuts(counts: DataFrame, group: list[str]) -> DataFrame:
    """The group's cut of best F1 between two bins (the middle of the widest gap among equals), its toxic rows and its rows."""
    counts = counts.groupBy(*group, "bin").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    keys = group or [F.lit(0)]
    down = Window.partitionBy(*keys).orderBy(F.col("bin").desc())
    all_of = Window.partitionBy(*keys)
    raw = lambda edge: 1 / (1 + F.exp(-edge / BINS))
    low = raw(F.col("bin"))
    after = F.coalesce(raw(F.lead("bin").over(down) + 1), F.lit(0.0))
    ranked = counts.select(
        *group, low.alias("low"), after.alias("after"), F.sum("toxic").over(all_of).alias("toxic"), F.sum("n").over(all_of).alias("n"),
        F.round(2 * F.sum("toxic").over(down) / (F.sum("n").over(down) + F.sum("toxic").over(all_of)), 12).alias("f1"),
    )
    best = F.max_by(F.struct(((F.col("low") + F.col("after")) / 2).alias("cut"), "toxic", "n"), F.struct("f1", F.col("low") - F.col("after"), "low")).alias("b")
    return ranked.groupBy(*group).agg(best).select(*group, "b.*")


def train_all(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, rounds: int = ROUNDS, steps: int = STEPS, batch: int = 32,
        rate: float = 0.01, seed: int = 7) -> Model:
    """A model from every labelled row outside the held-out third.

    The driver holds the shared state and one row a language; texts and rows stay on the executors.
    """
    shards = _labelled(docs, labels, sample, words).persist()
    try:
        model = _fresh(np.random.default_rng(seed))
        parts = shards.groupBy("held").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
        total, toxic = sum(r["n"] for r in parts), sum(r["toxic"] for r in parts)
        seen_n, seen_toxic = (sum(r[c] for r in parts if not r["held"]) for c in ("n", "toxic"))
        if not 0 < toxic < total:
            return _never(model)

        def count(batches):
            texts_of = np.zeros(ROWS, np.int64)
            for batch in batches:
                for own in batch.column("rows"):
                    texts_of[np.unique(own.values.to_numpy(zero_copy_only=False))] += 1
            word = np.flatnonzero(texts_of)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word, pa.int32()), "n": pa.array(texts_of[word])})

        counts = shards.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
        often = counts.filter(F.col("n") >= max(3, total / SEEN)).toArrow().column("word").to_numpy()  # ROWS at most
        often = np.sort(often[often > 0])
        place = np.zeros(ROWS, np.int32)
        place[often] = np.arange(1, len(often) + 1)
        full, model.table = np.zeros_like(model.table), model.table[np.concatenate([[0], often]).astype(np.int64)]
        model.bias = float(np.log((seen_toxic + 1) / (seen_n - seen_toxic + 1)))
        state = _State(model, _Adam(model, rate), place)
        heavy = _heavy(seen_toxic, seen_n)
        best, kept = math.inf, None
        for k in range(rounds + 1):
            before = copy.deepcopy(state)
            flat, loss = _round(shards, state, heavy, steps if k < rounds else 0, batch, seed)
            # without unseen rows the last state counts
            if k and (loss < best or total == seen_n):
                best, kept = loss, before
            if k < rounds:
                state.fill(flat)
                state.adam.step += steps
        unseen_toxic = toxic - seen_toxic
        counted = _counted(shards, kept, every=not 0 < unseen_toxic < total - seen_n)
        model = kept.model
        model.cut = min(0.98, max(0.02, _cuts(counted, []).first()["cut"]))
        for r in _cuts(counted, ["lang"]).filter("toxic > 0 and toxic < n").orderBy("lang").collect():
            trust = r["toxic"] / (r["toxic"] + 20)
            model.cuts[r["lang"]] = float(trust * model.rescale(np.array([r["cut"]]))[0] + (1 - trust) * CUT)
        full[often] = model.table[1:]
        model.table = full
        return model
    finally:
        shards.unpersist()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``flagged`` (by the cut of the column ``lang``, where there is one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: table and filters

    def run(batches):
        for batch in batches:
            yield [pa.array(shared.value.rescale(raw_scores(shared.value, batch.column(batch.schema.names.index(text)))), pa.float64())]

    scored = append(without(docs, ["score", "flagged"]), [T.StructField("score", T.DoubleType())], run)
    entries = [F.lit(x) for lang, cut in model.cuts.items() for x in (lang, cut)]
    cut = F.lit(CUT)
    if entries and "lang" in docs.columns:
        cut = F.coalesce(F.try_element_at(F.create_map(*entries), F.coalesce(F.col("lang").cast("string"), F.lit(""))), cut)
    return scored.withColumn("flagged", F.col("score") >= cut)
