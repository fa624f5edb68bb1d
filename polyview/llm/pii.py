"""Personal data: pattern matches, and a skip-chain conditional random field that carries them on.

Base spans follow fixed patterns per kind.  The field then labels every token that holds a digit or
an ``@`` (runs between white space) with a kind or none:

* unary potentials: a softmax regression over the token's shape;
* chain potentials between neighbours with only blanks between them;
* skip potentials between a token and the next one of the same document, however distant, that equals it but for
  case and marks, or ends in the same seven digits.

Tokens of base spans are evidence: their labels are fixed.  Loopy sum-product message passing spreads it, so
that what is known at one place holds for its repetitions.  Tokens that no base span covers but whose
marginal for a kind reaches ``SURE`` become further spans; neighbours of one kind join.  Base spans always stay.

The field learns from the tokens of at most ``SAMPLE`` texts (lowest in hash order of the id, of those
with a digit or ``@``; the lowest text of a repeated id), labelled by the base spans.  The executors count shapes, labels and
label pairs; no text goes to the driver.  Scoring covers whole texts.

Defined cases: null texts count as empty and have no spans; repeated rows get the same spans; without any
token in the sample only base spans are found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyview.llm.common import append, without

KINDS = ["email", "ip", "card", "phone"]  # label 0 stands for none
SAMPLE = 3000
SURE = 0.9
ROUNDS = 20

# The base patterns, written so that a failing start can't be tried again at each of its characters.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
HOLDS = re.compile(r"[0-9@]")
MARKS = "\"'`.,;:!?<>[]{}|=*#$&%/\\"
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
        else:
            free = max(free, start)  # no later @ can reach over this one
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if HOLDS.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or ``@``, without marks at their ends."""
    out, end = [], 0
    for hit in HOLDS.finditer(text):
        if hit.start() < end:
            continue
        start = hit.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = TOKEN.match(text, hit.start()).end()
        word = text[start:end]
        left = len(word) - len(word.lstrip(MARKS))
        out.append((start + left, start + left + len(word.strip(MARKS))))
    return [t for t in out if t[1] > t[0]]


def shape(word: str) -> tuple[int, ...]:
    digits = sum(c in "0123456789" for c in word)
    return (min(digits, 20), min(word.count("."), 4), min(len(word) - digits, 12),
            "@" in word, "+" in word, "-" in word, "(" in word or ")" in word, any(c.isalpha() for c in word))


SIZES = (21, 5, 13, 2, 2, 2, 2, 2)


def shape_columns(shapes: np.ndarray) -> np.ndarray:
    """Shapes as one-hot rows."""
    out = np.zeros((len(shapes), sum(SIZES)), np.float64)
    at = 0
    for k, size in enumerate(SIZES):
        out[np.arange(len(shapes)), at + shapes[:, k]] = 1
        at += size
    return out


@dataclass
class Graph:
    """Tokens of several texts: places, shapes, labels fixed by base spans (-1: free), edges between tokens."""

    doc: np.ndarray
    spans: np.ndarray
    shapes: np.ndarray
    fixed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph(texts: list[str], bases: list[list[tuple[str, int, int]]]) -> Graph:
    doc, spans, shapes, fixed, chain, skip = [], [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        if HOLDS.search(text) is None:
            continue
        last: dict[str, int] = {}
        order = sorted((s, e, KINDS.index(k) + 1) for k, s, e in base)
        at, before = 0, None
        for start, end in tokens(text):
            n = len(doc)
            while at < len(order) and order[at][1] <= start:
                at += 1
            label = next((kind for s, e, kind in order[at : at + 4] if s < end and e > start), -1)
            word = text[start:end]
            doc.append(d)
            spans.append((start, end))
            shapes.append(shape(word))
            fixed.append(label)
            if before is not None and text[before:start].strip(" \t()" + MARKS) == "" and start - before <= 4:
                chain.append((n - 1, n))
            before = end
            bare = "".join(c for c in word.casefold() if c.isalnum())
            digits = "".join(c for c in bare if c in "0123456789")
            joined = set()
            for key in (bare if len(bare) >= 6 else None, "#" + digits[-7:] if len(digits) >= 7 and len(digits) == len(bare) else None):
                if key is not None:
                    if key in last and last[key] not in joined:
                        joined.add(last[key])
                        skip.append((last[key], n))
                    last[key] = n
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(doc, np.int64), pairs(spans), np.array(shapes, np.int64).reshape(-1, len(SIZES)), np.array(fixed, np.int64), pairs(chain), pairs(skip))


@dataclass
class Field:
    """Log potentials: unary weights by shape column and label, label pairs along chain and skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def tally(g: Graph) -> Counter:
    """How often each token shape and label occurs (keys ``(0, *shape, label)``), and the labels of chain (1) and skip (2) edges."""
    label = np.maximum(g.fixed, 0)
    found = Counter((0, *s, y) for s, y in zip(g.shapes.tolist(), label.tolist(), strict=True))
    for kind, edges in ((1, g.chain), (2, g.skip)):
        found.update((kind, *pair) for pair in label[edges].tolist())
    return found


def fit(g: Graph) -> Field:
    """``fit_tally`` of a graph."""
    return fit_tally(tally(g))


def fit_tally(found: Mapping[tuple[int, ...], int]) -> Field:
    """Softmax regression on the shapes; edge potentials from how often labels meet, beyond chance."""
    count = len(KINDS) + 1
    rows = {kind: sorted((*key[1:], n) for key, n in found.items() if key[0] == kind) for kind in range(3)}
    table = np.array(rows[0], np.int64).reshape(-1, len(SIZES) + 2)
    shapes, label, weight = table[:, :-2], table[:, -2], table[:, -1].astype(np.float64)
    unary = np.zeros((sum(SIZES), count))
    if len(label):
        x, y = shape_columns(shapes), np.eye(count)[label]
        for step in range(400):
            p = np.exp(_normal(x @ unary))
            grad = x.T @ ((p - y) * weight[:, None]) / weight.sum() + 1e-4 * unary
            unary -= (4.0 if step < 300 else 1.0) * grad
    share = np.bincount(label, weight, minlength=count) + 1.0
    share /= share.sum()

    def beyond_chance(kind: int, prior: np.ndarray) -> np.ndarray:
        seen = prior.copy()
        for a, b, n in rows[kind]:
            seen[a, b] += n
        seen = (seen + seen.T) / (2 * seen.sum())
        return np.clip(np.log(seen / np.outer(share, share)), -4, 4)

    even = np.outer(share, share) * count
    return Field(unary, beyond_chance(1, even), beyond_chance(2, even + 4 * np.diag(share)))


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def marginals(field: Field, g: Graph) -> np.ndarray:
    """Label marginals of every token by loopy message passing over both kinds of edges."""
    own = _normal(shape_columns(g.shapes) @ field.unary)
    known = g.fixed >= 0
    own[known] = -50.0
    own[known, g.fixed[known]] = 0.0
    edges = np.concatenate([g.chain, g.skip])
    potential = np.concatenate([np.repeat(field.chain[None], len(g.chain), axis=0), np.repeat(field.skip[None], len(g.skip), axis=0)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    half = len(edges)
    message = np.zeros((2 * half, own.shape[1]))
    for _ in range(ROUNDS if half else 0):
        belief = own.copy()
        np.add.at(belief, target, message)
        back = np.concatenate([message[half:], message[:half]])
        inner = potential + (belief[source] - back)[:, :, None]
        top = inner.max(axis=1, keepdims=True)
        fresh = _normal((top + np.log(np.exp(inner - top).sum(axis=1, keepdims=True)))[:, 0, :])
        change = np.abs(fresh - message).max()
        message = 0.5 * message + 0.5 * fresh
        if change < 1e-3:
            break
    belief = own.copy()
    np.add.at(belief, target, message)
    return np.exp(_normal(belief))


def all_spans(field: Field, texts: list[str]) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base spans of each text, and those that the field adds."""
    bases = [base_spans(t) for t in texts]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    g = graph(texts, bases)
    if len(g.doc):
        sure = marginals(field, g)
        label = np.where((g.fixed < 0) & (sure.max(axis=1) >= SURE), sure.argmax(axis=1), 0)
        linked = set(map(tuple, g.chain.tolist()))
        for n in np.flatnonzero(label).tolist():
            own, kind = added[g.doc[n]], KINDS[label[n] - 1]
            start, end = g.spans[n].tolist()
            if n and label[n - 1] == label[n] and (n - 1, n) in linked:
                own[-1] = (kind, own[-1][1], end)
            else:
                own.append((kind, start, end))
    return bases, [sorted(a, key=lambda s: (KINDS.index(s[0]), s[1])) for a in added]


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from the base spans of at most ``sample`` whole texts, one per id."""
    some = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = some.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for value in batch.column(0):
                text = value.as_py()
                found.update(tally(graph([text], [base_spans(text)])))
            yield pa.RecordBatch.from_arrays([pa.array(map(list, found), pa.list_(pa.int32())), pa.array(found.values(), pa.int64())], names=["key", "n"])

    counted = texts.mapInArrow(run, "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return fit_tally({tuple(k): n for k, n in zip(counted.column("key").to_pylist(), counted.column("n").to_pylist(), strict=True)})


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` plus ``base`` and ``added``: arrays of (kind, start, end) in code points, end exclusive."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def listed(spans):
        return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in own] for own in spans], kind)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            yield [listed(x) for x in all_spans(field, texts)]

    return append(without(docs, ["base", "added"]), [T.StructField(n, T.ArrayType(SPAN)) for n in ("base", "added")], run)


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans go as one."""
    def mask(value: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        out, at = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [value[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return value if not spans else "".join([*out, value[at:]])

    def run(batches):
        for batch in batches:
            k = batch.schema.names.index(text)
            values = batch.column(k).to_pylist()
            base, added = all_spans(field, [v or "" for v in values])
            masked = pa.array([mask(v, [*b, *a]) for v, b, a in zip(values, base, added, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == k else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
