"""Token counts under a unigram model, from scores that words share through a trie.

Every distinct pre-token (a run between white space, with the mark for the space before it) is inserted in a trie.
A node stands for a prefix and holds, once for all words that share it, the best score of any split of that
prefix into pieces and the number of pieces of that split: the forward recursion over the pieces that end there.
A word's terminal count is that of its last node.  Counts of words then add up per text.

Scores are whole numbers, so sums are exact: of two splits with equal scores the one with fewer pieces counts.
Characters that no piece covers count as one unknown token each, far below any piece.  The piece file holds merge ranks
and no probabilities; as log-probability each piece takes Zipf's law of its rank.

Defined cases: null, empty and blank texts have no tokens; repeated rows count alike; words of any length are
split in time linear in their length.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from polyview.llm.common import append, without

SPACE = "▁"
UNKNOWN = -1_000_000
NODES = 1_500_000  # trie nodes a worker keeps before it starts anew (and one word's beyond)
DEPTH = 256  # letters of a word that become nodes; the rest passes in a window as long as the longest piece


def zipf_pieces(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece file with whole-number scores: -10000 ln(rank + 2), ranks in order of the ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -round(10_000 * math.log(rank + 2)) for rank, i in enumerate(ids)}


class Trie:
    """Forward scores of all prefixes inserted so far."""

    def __init__(self, pieces: dict[str, int]):
        # pieces backwards, letter by letter: a walk from a node towards the root finds all that end there
        self.backwards: list[dict[str, int]] = [{}]
        self.piece_scores: list[int | None] = [None]
        for piece, score in pieces.items():
            at = 0
            for c in reversed(piece):
                nxt = self.backwards[at].get(c)
                if nxt is None:
                    nxt = self.backwards[at][c] = len(self.backwards)
                    self.backwards.append({})
                    self.piece_scores.append(None)
                at = nxt
            self.piece_scores[at] = score
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.parent, self.letter, self.score, self.count = [-1], [""], [0], [0]

    def insert(self, word: str) -> int:
        """The terminal count of ``word``; only prefixes that no earlier word had are computed."""
        if len(self.score) > NODES:
            self.clear()
        at = 0
        for c in word[:DEPTH]:
            below = self.children[at]
            nxt = below.get(c) if below else None
            if nxt is None:
                nxt = self._grow(at, c)
                if below is None:
                    self.children[at] = {c: nxt}
                else:
                    below[c] = nxt
            at = nxt
        return self.count[at] if len(word) <= DEPTH else self._beyond(at, word)

    def _beyond(self, at: int, word: str) -> int:
        """The terminal count of a long word from the node of its first ``DEPTH`` letters, without more nodes."""
        letters, states = [], []  # the last letters, and score and count before each of them and after the last
        while at and len(letters) < self.longest:
            letters.append(self.letter[at])
            states.append((self.score[at], self.count[at]))
            at = self.parent[at]
        letters, states = letters[::-1], [(self.score[at], self.count[at]), *states[::-1]]
        for c in word[DEPTH:]:
            letters.append(c)
            best, pieces = states[-1][0] + UNKNOWN, states[-1][1] + 1
            walk, i = 0, len(letters) - 1
            while i >= 0 and (walk := self.backwards[walk].get(letters[i])) is not None:
                own = self.piece_scores[walk]
                if own is not None:
                    total, number = states[i][0] + own, states[i][1] + 1
                    if total > best or total == best and number < pieces:
                        best, pieces = total, number
                i -= 1
            states.append((best, pieces))
            if len(letters) > 8 * self.longest:
                letters, states = letters[-self.longest :], states[-self.longest - 1 :]
        return states[-1][1]

    def _grow(self, parent: int, c: str) -> int:
        best, pieces = self.score[parent] + UNKNOWN, self.count[parent] + 1
        walk, node, before = 0, c, parent
        backwards, scores = self.backwards, self.piece_scores
        letter, up = self.letter, self.parent
        while (walk := backwards[walk].get(node)) is not None:
            own = scores[walk]
            if own is not None:
                total, number = self.score[before] + own, self.count[before] + 1
                if total > best or total == best and number < pieces:
                    best, pieces = total, number
            if before == 0:
                break
            node, before = letter[before], up[before]
        self.children.append(None)
        self.parent.append(parent)
        self.letter.append(c)
        self.score.append(best)
        self.count.append(pieces)
        return len(self.score) - 1


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(zipf_pieces(path))


def token_counts(texts: pa.Array, own: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and pre-tokens of each text."""
    words = pc.utf8_split_whitespace(texts.fill_null(""))
    coded = words.flatten().dictionary_encode()
    each = np.array([own.insert(SPACE + w) if w else 0 for w in coded.dictionary.to_pylist()], np.int64)
    full = np.array([w != "" for w in coded.dictionary.to_pylist()], np.int64)
    codes = coded.indices.to_numpy()
    ends = np.asarray(words.offsets) - words.offsets[0].as_py()

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[codes] if len(values) else np.zeros(0, np.int64))])
        return total[ends[1:]] - total[ends[:-1]]

    return summed(each), summed(full)


def with_counts(df: DataFrame, pieces: str, text: str = "text") -> DataFrame:
    """``df`` plus ``n_tokens`` and ``n_pretokens`` of its texts; ``pieces`` is the path of the piece file."""
    def run(batches):
        for batch in batches:
            yield [pa.array(x, pa.int64()) for x in token_counts(batch.column(batch.schema.names.index(text)), trie(pieces))]
        trie(pieces).clear()  # workers outlive their tasks and serve other operators too

    names = ["n_tokens", "n_pretokens"]
    return append(without(df, names), [T.StructField(n, T.LongType()) for n in names], run)
