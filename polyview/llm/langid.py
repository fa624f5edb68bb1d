"""Language spans by script ranges and Viterbi over word scores.

Words are letters with their marks, in lower case.  A word's script leaves only languages that write in it; hashed letter
n-grams and the word itself score those.  A text's best labelling maximises the sum of its words' scores less a penalty
for every switch, so that mixed texts fall into spans; the language with most letters is the text's.

* Training counts features on the executors: of each language at most ``TEXTS`` texts (one per doc_id, in hash order, whole
  texts, each distinct word once).  What comes back are counts: ``BUCKETS`` plus the scripts, per language.
* Scores are whole numbers, so sums don't depend on how texts are batched.
* Viterbi runs block by block: blocks of ``BLOCK`` words of all texts advance together, first for every state before them, then, once
  the blocks of a text are chained, for the one it has.  A text of 100 000 words takes no more steps side by side than ``BLOCK``, plus one
  short step a block.

Defined cases: null texts and texts without letters are ``und`` with score 0 and no spans, so is everything where nothing was
learned; words of a script that no language uses score 0; ties go to the language first by name and to staying; repeated rows are
labelled alike; rows without lang or doc_id teach nothing; result columns replace clashing ones; texts are labelled whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.llm.common import append, bounded, without

TEXTS = 4000  # texts a language is learned from
BUCKETS = 1 << 17
ORDERS = 4  # letters of the longest n-gram
SMOOTH = 0.5
UNIT = 1000  # scores are whole thousandths of a nat
SWITCH = 8.0  # nats a change of language costs
FOREIGN = 30.0  # nats a word of a script that the language doesn't use costs
SHARE = 0.01  # of a language's letters, from which it uses a script
BLOCK = 64
CACHE = 200_000  # words whose scores a task remembers before it starts anew
LETTERS = 500_000  # letters whose n-grams are held at once (one word more at most)
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LAST = regex.compile(r"(?r)\p{L}[\p{L}\p{M}]*")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# First code points of script ranges; a script ends where the next begins.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in RANGES})
_STARTS = np.array([start for start, _ in RANGES])
_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in RANGES])


@dataclass(frozen=True)
class Model:
    """``table[bucket, language]`` and ``allowed[script, language]``; about 0.5 MB for each language."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def scripts(found: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in found), np.int64, len(found))
    return _OF_RANGE[np.searchsorted(_STARTS, first, side="right") - 1]


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words themselves, word by word, and how many each word has."""
    codes = np.frombuffer("".join(f"\x01{w}\x02" for w in found).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in found), np.int64, len(found))
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(codes)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - inside
    grams = np.zeros((len(codes), ORDERS), np.int64)
    valid = np.zeros((len(codes), ORDERS), bool)
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDERS + 1):
        rolled = (rolled + np.pad(codes[n - 1 :], (0, n - 1))) * MULTIPLIER
        grams[:, n - 1], valid[:, n - 1] = _bucket(rolled + np.uint64(n)), left >= n
    power = np.multiply.accumulate(np.full(int(sizes.max(initial=1)), MULTIPLIER))
    whole = _bucket(np.add.reduceat(codes * power[inside], starts) if len(found) else np.zeros(0, np.uint64))
    out = np.insert(grams[valid], np.cumsum(np.add.reduceat(valid.sum(axis=1), starts)) if len(found) else [], whole)
    return out, (np.add.reduceat(valid.sum(axis=1), starts) + 1 if len(found) else sizes)


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def held_out(key: str = "doc_id", parts: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == 0, F.lit(False))


def train(docs: DataFrame, texts: int = TEXTS) -> Model:
    """A model of the languages in ``docs(doc_id, text, lang)``; the caller leaves out rows that mustn't teach."""
    known = docs.select("doc_id", "text", "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("lang", "doc_id").distinct().withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= texts).drop("__r")
    chosen = known.join(bounded(ids, 1_000_000), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.max("text").alias("text"))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sorted(set(words(text)))
                if own:
                    sums = found.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    sums[:BUCKETS] += np.bincount(features(own)[0], minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(scripts(own), [len(w) for w in own], len(SCRIPTS)).astype(np.int64)
        for lang, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], names=["lang", "bucket", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return fitted(rows.column("lang").to_pylist(), rows.column("bucket").to_numpy(), rows.column("n").to_numpy())


def fitted(of: list[str], buckets: np.ndarray, counts: np.ndarray) -> Model:
    """The model of feature counts, given as rows of language, bucket and count."""
    langs = sorted(set(of))
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    sums[buckets, [langs.index(x) for x in of]] = counts
    features_, letters = sums[:BUCKETS], sums[BUCKETS:]
    share = np.log((features_ + SMOOTH) / (features_.sum(axis=0) + SMOOTH * BUCKETS))
    table = (share - share.mean(axis=1, keepdims=True)) * (UNIT / (ORDERS + 1)) if langs else share
    table[features_.sum(axis=1) == 0] = 0
    return Model(langs, np.rint(table).astype(np.int32), letters >= SHARE * letters.sum(axis=0, keepdims=True))


def word_scores(found: list[str], model: Model) -> np.ndarray:
    """Whole-number scores of each word and language."""
    if not found:
        return np.zeros((0, len(model.langs)), np.int64)
    part = np.cumsum([len(w) for w in found]) // LETTERS
    if part[-1] and len(found) > 1:  # in portions, so that the arrays of n-grams stay small
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(found)] if part[0] < part[-1] else range(len(found) + 1)
        return np.concatenate([word_scores(found[a:b], model) for a, b in zip(cuts, cuts[1:], strict=False)])
    buckets, counts = features(found)
    scores = np.add.reduceat(model.table[buckets].astype(np.int64), np.cumsum(counts) - counts)
    allowed = model.allowed[scripts(found)]
    some = allowed.any(axis=1, keepdims=True)
    return np.where(some, scores - np.where(allowed, 0, round(FOREIGN * UNIT)), 0)


def best_labels(scores: np.ndarray, lengths: np.ndarray, switch: int = round(SWITCH * UNIT)) -> np.ndarray:
    """The best label of each word of texts that stand one after another with ``lengths`` (each 1 at least)."""
    n = scores.shape[1]
    per_text = -(-lengths // BLOCK)
    text_of = np.repeat(np.arange(len(lengths)), per_text)
    number = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = (np.cumsum(lengths) - lengths)[text_of] + number * BLOCK
    size = np.minimum(lengths[text_of] - number * BLOCK, BLOCK)
    order = np.argsort(-size, kind="stable")  # long blocks first: those still open are a prefix
    live = [int(np.searchsorted(-size[order], -t, side="left")) for t in range(BLOCK)]

    def steps(reverse: bool = False):
        for t in range(BLOCK - 1, -1, -1) if reverse else range(BLOCK):
            if live[t]:
                yield t, order[: live[t]]

    through = np.full((len(first), n, n), -switch, np.int64)  # from the state before the block to that at its end
    through[:, np.arange(n), np.arange(n)] = 0
    for t, at in steps():
        own = through[at]
        own = own if t == 0 else np.maximum(own, own.max(axis=2, keepdims=True) - switch)
        through[at] = own + scores[first[at] + t][:, None, :]
    heads = np.cumsum(per_text) - per_text
    before = np.zeros((len(first), n), np.int64)
    for k in range(1, int(per_text.max(initial=0))):
        at = heads[per_text > k] + k
        before[at] = (before[at - 1][:, :, None] + through[at - 1]).max(axis=1)
    back = np.zeros((BLOCK, len(first), n), np.int16)
    value = before
    for t, at in steps():
        own = value[at]
        jump = own.max(axis=1, keepdims=True) - switch
        back[t, at] = np.where(own >= jump, np.arange(n), own.argmax(axis=1)[:, None])
        value[at] = np.maximum(own, jump) + scores[first[at] + t]
    entry = np.tile(np.arange(n), (len(first), 1))  # the state before the block, by the one at its end
    for t, at in steps(reverse=True):
        entry[at] = np.take_along_axis(back[t, at].astype(np.int64), entry[at], axis=1)
    ends = heads + per_text - 1
    state = np.zeros(len(first), np.int64)
    state[ends] = value[ends].argmax(axis=1)
    for k in range(1, int(per_text.max(initial=0))):
        at = ends[per_text > k] - k
        state[at] = entry[at + 1, state[at + 1]]
    labels = np.zeros(len(scores), np.int64)
    for t, at in steps(reverse=True):
        labels[first[at] + t] = state[at]
        state[at] = back[t, at, state[at]]
    return labels


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def _spans(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Spans from the first to the last letter of equally labelled words in a row; code points, end exclusive."""
    turns = np.flatnonzero(np.diff(labels)) + 1
    if len(turns):
        places = [m.span() for m in WORD.finditer(text)]
        starts, ends = [0, *turns], [*turns, len(labels)]
        return [{"start": places[a][0], "end": places[b - 1][1], "lang": langs[labels[a]]} for a, b in zip(starts, ends, strict=True)]
    return [{"start": WORD.search(text).start(), "end": LAST.search(text).end(), "lang": langs[labels[0]]}]


def label(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` plus ``lang_pred``, ``score`` (its share of the letters) and ``spans`` (array of start, end, lang)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        langs = own.langs
        known: dict[str, int] = {}
        scores, sizes = np.zeros((0, len(langs)), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            if len(known) > CACHE:
                known, scores, sizes = {}, scores[:0], sizes[:0]
            listed = [WORD.findall(low) if langs and t and len(low := t.lower()) == len(t) else [w.lower() for w in WORD.findall(t or "")] if langs else [] for t in texts]
            fresh = sorted(set().union(*listed).difference(known))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            scores = np.concatenate([scores, word_scores(fresh, own)])
            sizes = np.concatenate([sizes, np.fromiter(map(len, fresh), np.int64, len(fresh))])
            full = [i for i, ws in enumerate(listed) if ws]
            lengths = np.array([len(listed[i]) for i in full], np.int64)
            at = np.fromiter(map(known.__getitem__, chain.from_iterable(listed)), np.int64, int(lengths.sum()))
            labels = best_labels(scores[at], lengths) if full else at
            letters = np.bincount(np.repeat(np.arange(len(full)), lengths) * len(langs) + labels, sizes[at], len(full) * len(langs)).reshape(len(full), len(langs))
            found, share, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for i, counts, own_labels in zip(full, letters, np.split(labels, np.cumsum(lengths)[:-1]), strict=False):
                found[i], share[i] = langs[int(counts.argmax())], float(counts.max() / counts.sum())
                spans[i] = _spans(texts[i], own_labels, langs)
            yield [pa.array(found), pa.array(share), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]
    return append(without(df, [f.name for f in fields]), fields, run)
