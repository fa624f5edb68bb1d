"""Byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of every distinct word; a vectorised check then
tests all adjacent proposed pairs at once.  A sequence whose neighbours are all compatible
is the merge result, so only words with a failing pair run the exact merges.

Two neighbouring tokens are compatible if merging their joined bytes gives the two back.
Only merges across the border can prevent that, and those join a piece of the left
token's right edge with one of the right token's left edge.  Walking back through both
edges, latest merge first, visits each two pieces that ever stood side by side; the border
is crossed if they merge before the left piece is absorbed by its own side, and no later
than the right one (of equal ranks the leftmost merges first).

Words come from the vocabulary's split pattern.  A text is first cut before single spaces
between non-spaces, where no word can cross, so that work is shared per distinct chunk.
Null texts count as empty; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from polyview.llm.common import append, without

# Fixed value: the split pattern of the byte-level vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EDGE = re.compile(r"(?<=\S)(?= \S)")
WIDE = re.compile(r"\s | \s|^\s|\s$")
CACHE = 64_000_000  # bytes of chunks that a worker remembers, from task to task, before it starts anew
ENTRY = 150  # bytes an entry takes beside its own
SHORT = 48  # bytes; longer words merge one by one through a heap
WALK = 256  # bytes; longer words are matched one by one
NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup:
    """Whole numbers by whole-number keys (0 or more), found side by side: open addressing in one array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot, self.probes = self._home(keys), 0
        while len(keys):  # all try their slot, the first of each free one gets it, the rest go on to the next
            free = np.flatnonzero(self.keys[slot] < 0)
            taken = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[taken]], self.values[slot[taken]] = keys[taken], values[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, values, slot, self.probes = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1), self.probes + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't there."""
        slot = self._home(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_], there = at, self.keys[at]
            out[open_] = np.where(there == keys[open_], self.values[at], -1)
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return out


class Codec:
    """A vocabulary with its merges, and what a worker has encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for b, i in self.ids.items():
            self.tokens[i] = b
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([self.ids[raw[a]] for a, _ in pairs], np.int64)
        right = np.array([self.ids[raw[b]] for _, b in pairs], np.int64)
        made = np.array([self.ids[raw[a] + raw[b]] for a, b in pairs], np.int64)
        self.born, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.born[made], self.left[made], self.right[made] = np.arange(len(pairs)), left, right
        self.made = made
        self.byte_ids = np.array([self.ids[bytes((b,))] for b in range(256)], np.int64)
        self.size, self.rank_of = size, Lookup(left * size + right, np.arange(len(pairs)))
        self.ranks = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(left, right, made, strict=True))}
        self.steps, self.ends = self._trie()
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(WORDS)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        whole = np.flatnonzero(self.born >= 0)
        self.whole = np.ones(size, bool)  # tokens whose own bytes merge to them
        self.whole[whole] = self.compatible(self.left[whole], self.right[whole], self.born[whole])
        lengths = np.array([len(b) for b in self.tokens], np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.forget()
        self.exact_words = self.seen_words = 0

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self.rank_of.get(a * self.size + b)
        return np.where(rank < 0, NEVER, rank)

    def _trie(self) -> tuple[Lookup, np.ndarray]:
        """Steps from a prefix of a token over a byte to the next prefix, and the token that each prefix is (-1: none)."""
        states, ends = {b"": 0}, {}
        for token, i in self.ids.items():
            for end in range(1, len(token) + 1):
                states.setdefault(token[:end], len(states))
            ends[states[token]] = i
        keys = np.array([states[p[:-1]] * 256 + p[-1] for p in states if p], np.int64)
        found = np.full(len(states), -1, np.int64)
        found[list(ends)] = list(ends.values())
        return Lookup(keys, np.arange(1, len(states))), found

    def compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair stays apart; with ``own`` ranks, apart until that merge joins it."""
        x, y = a.copy(), b.copy()
        x_until = np.full(len(x), NEVER) if own is None else own.copy()
        y_until = x_until.copy()
        fine = np.ones(len(x), bool)
        live = np.arange(len(x))
        first = own is not None
        while len(live):
            rank = self.pair_ranks(x[live], y[live])
            if first:  # the pair itself may merge at its own rank
                rank, first = np.full(len(live), NEVER), False
            crossed = (rank < x_until[live]) & (rank <= y_until[live])
            fine[live[crossed]] = False
            live = live[~crossed]
            bx, by = self.born[x[live]], self.born[y[live]]
            go_on = (bx >= 0) | (by >= 0)
            live, bx, by = live[go_on], bx[go_on], by[go_on]
            back = bx > by
            lx, ly = live[back], live[~back]
            x_until[lx], x[lx] = bx[back], self.right[x[lx]]
            y_until[ly], y[ly] = by[~back], self.left[y[ly]]
        return fine

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: tokens and the words they belong to, in order.

        Words of up to ``WALK`` bytes walk the trie side by side.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        near = np.flatnonzero(sizes <= WALK)
        tokens, home = self._walked([words[k] for k in near])
        far = [(k, self._longest_matches(words[k])) for k in np.flatnonzero(sizes > WALK)]
        tokens = np.concatenate([tokens, *[np.array(t, np.int64) for _, t in far]])
        home = np.concatenate([near[home], *[np.full(len(t), k) for k, t in far]])
        order = np.argsort(home, kind="stable")
        return tokens[order], home[order]

    def _longest_matches(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        while at < n:
            size = min(self.longest, n - at)
            while (token := self.ids.get(word[at : at + size])) is None:
                size -= 1
            out.append(token)
            at += size
        return out

    def _walked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        stop = np.cumsum([len(w) for w in words])
        owner = np.flatnonzero(np.diff(stop, prepend=0))
        stop = stop[owner]
        at = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        state, token, end = np.zeros_like(at), np.zeros_like(at), at.copy()
        found, homes = [], []
        while len(owner):
            inside = at < stop
            step = np.full(len(at), -1)
            step[inside] = self.steps.get(state[inside] * 256 + data[at[inside]])
            on = step >= 0
            state, at = np.where(on, step, 0), at + on
            hit = on & (self.ends[state] >= 0)
            token, end = np.where(hit, self.ends[state], token), np.where(hit, at, end)
            if not on.all():  # the match is over: its token stands, the walk starts anew behind it
                over = ~on
                found.append(token[over])
                homes.append(owner[over])
                at = np.where(over, end, at)
                if (over & (end == stop)).any():
                    go_on = ~(over & (end == stop))
                    owner, stop, at, state, token, end = (x[go_on] for x in (owner, stop, at, state, token, end))
        return np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0, np.int64), *homes])

    def merge(self, word: bytes) -> list[int]:
        """The exact merges: always the lowest rank, leftmost first."""
        ids = [self.ids[bytes((b,))] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := self.ranks.get((ids[i], ids[i + 1])))]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for u in (before[i], i):
                if u >= 0 and after[u] < n and (found := self.ranks.get((ids[u], ids[after[u]]))):
                    heapq.heappush(heap, (found[0], u, found[1], ids[u], ids[after[u]]))
        return [t for t in ids if t >= 0]

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The exact merges of many words side by side, a merge per word and round: tokens and the words they belong to."""
        found, homes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = self._next_ranks(ids, owner)
        while len(ids):
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, heads)
            done = least == NEVER
            if done.any():
                over = np.repeat(done, np.diff(heads, append=len(ids)))
                found.append(ids[over])
                homes.append(owner[over])
                ids, owner, rank, least = ids[~over], owner[~over], rank[~over], least[~done]
                if not len(ids):
                    break
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
            hits = np.flatnonzero(rank == np.repeat(least, np.diff(heads, append=len(ids))))
            at = hits[np.diff(owner[hits], prepend=-1) != 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))  # one token less for each merge further left
            for changed in (at, at[at > 0] - 1):
                inner = changed[changed < len(ids) - 1]
                rank[changed] = NEVER
                same = inner[owner[inner] == owner[inner + 1]]
                rank[same] = self.pair_ranks(ids[same], ids[same + 1])
        return np.concatenate(found), np.concatenate(homes)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """The exact merges of many words as lists."""
        flat, home = self.merge_flat(words)
        return [x.tolist() for x in np.split(flat[np.argsort(home, kind="stable")], np.cumsum(np.bincount(home, minlength=len(words)))[:-1])]

    def _next_ranks(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        rank = np.full(len(ids), NEVER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        return rank

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word as lists."""
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.encoded(words)]

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word (as 32-bit numbers): proposals where every pair holds, else the exact merges."""
        flat, owner = self.propose(words)
        failing = np.zeros(len(words), bool)
        failing[owner[~self.whole[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.compatible(codes // self.size, codes % self.size)[back]
        failing[owner[inner[~fits]]] = True
        failed = np.flatnonzero(failing)
        lengths = np.array([len(words[k]) for k in failed], np.int64)
        short, long = failed[lengths <= SHORT], failed[lengths > SHORT]
        merged, of_short = self.merge_flat([words[k] for k in short])
        exact = [self.merge(words[k]) for k in long]
        kept = ~failing[owner]
        flat = np.concatenate([flat[kept], merged, *[np.array(e, np.int64) for e in exact]])
        owner = np.concatenate([owner[kept], short[of_short], np.repeat(long, [len(e) for e in exact])])
        order = np.argsort(owner, kind="stable")
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        raw = flat[order].astype(np.int32).tobytes()
        self.seen_words += len(words)
        self.exact_words += len(failed)
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, missing: list[tuple[int, set[str]]]) -> None:
        """Encode chunks that aren't remembered yet; ``1`` marks those after a space."""
        for k, cs in missing:
            plain = [c for c in cs if c.isalpha()]  # one word each
            mixed = [c for c in cs if not c.isalpha()]
            whole = [c.encode() for c in ([" " + c for c in plain] if k else plain)]
            split = [[w.encode() for w in self.words.findall(" " + c if k else c)] for c in mixed]
            words = list(set().union(*split))
            ids = self.encoded(whole + words)
            found = dict(zip(words, ids[len(whole) :], strict=True))
            joined = [b"".join([found[w] for w in ws]) for ws in split]
            self.chunks[k].update(zip(plain, ids, strict=False))
            self.chunks[k].update(zip(mixed, joined, strict=True))
            self.held += sum(map(len, cs)) + sum(map(len, ids[: len(whole)])) + sum(map(len, joined)) + ENTRY * len(cs)

    def pieces(self, text: str) -> list[tuple[bool, list[str]]]:
        """A text as runs of chunks: each but the first stands after one space that is its own."""
        if WIDE.search(text) is None:
            return [(False, text.split(" "))]
        parts = EDGE.split(text)
        return [(False, [parts[0], *[p[1:] for p in parts[1:]]])]

    def forget(self) -> None:
        self.chunks, self.held = ({}, {}), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if self.held > CACHE:
            self.forget()
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif self.split_special is None or self.split_special.search(text) is None:
                cut.append(self.pieces(text))
            else:
                runs, at = [], 0
                for m in self.split_special.finditer(text):
                    runs += (self.pieces(text[at : m.start()]) if m.start() > at else []) + [(True, [m.group()])]
                    at = m.end()
                cut.append(runs + (self.pieces(text[at:]) if at < len(text) else []))
        first, later = self.chunks
        missing: list[tuple[int, set[str]]] = [(0, set()), (1, set())]
        for runs in cut:
            for special, chunks in runs:
                if not special:
                    missing[0][1].add(chunks[0])
                    missing[1][1].update(chunks[1:])
        missing[0][1].difference_update(first)
        missing[1][1].difference_update(later)
        self.learn(missing)
        out = []
        for runs in cut:
            found = []
            for special, chunks in runs:
                if special:
                    found.append(np.int32(self.special[chunks[0]]).tobytes())
                else:
                    found.append(first[chunks[0]])
                    found += [later[c] for c in chunks[1:]]
            out.append(np.frombuffer(b"".join(found), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; invalid UTF-8 turns into replacement marks, unknown ids into nothing."""
        ids = ids[(ids >= 0) & (ids < self.size)].astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.blob[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus the token ids of ``text`` (array of int; null and empty texts: none).

    ``vocabulary`` is the path of the tokenizer file on every machine.
    """
    def run(batches):
        for batch in batches:
            yield [_lists(codec(vocabulary).encode(_texts(batch.column(batch.schema.names.index(text)))))]

    return append(without(df, [ids]), [T.StructField(ids, T.ArrayType(T.IntegerType()))], run)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` plus the text that the token ids stand for (null ids: empty)."""
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            lists = [np.array(x.values) if x.is_valid else np.zeros(0, np.int32) for x in column]
            yield [pa.array([codec(vocabulary).decode(x) for x in lists], pa.string())]

    return append(without(df, [text]), [T.StructField(text, T.StringType())], run)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of the ids in one pass over the workers."""
    def run(batches):
        for batch in batches:
            own = codec(vocabulary)
            found = own.encode(_texts(batch.column(batch.schema.names.index(text))))
            yield [_lists(found), pa.array([own.decode(x) for x in found], pa.string())]

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return append(without(df, [ids, decoded]), fields, run)
