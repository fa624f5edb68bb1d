import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from polyview.llm import catalog
from polyview.llm import jaccard as J

SF = "/root/testdata/sf0.001"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows):
    """(doc_id, n, component) of every row, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if J.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in J.jaccard_classes(df).collect()), key=str)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


def test_near_copies_chains_and_passages(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    rows, doc = [], 500
    for base in range(14):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([3, 4, 5, 6, 9, 20, 90, 300, 700]))]
        if base % 3 == 0:
            words += passage
        for _ in range(draw.choice([1, 2, 9])):
            words = edited(draw, words, draw.choice([0, 0, 1, len(words) // 25, len(words) // 18]))  # a chain
            rows.append((doc := doc - 1, " ".join(words).upper() if draw.random() < 0.2 else "\n".join(words)))
    rows += [(900 + k, " ".join(passage + [f"x{k}{i}" for i in range(50)])) for k in range(20)]
    assert classes(spark, rows) == brute(rows)


def test_blocks_of_a_hot_key_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(edited(draw, words, draw.choice([1, 2, 3, 4])))) for k in range(60)]
    assert classes(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (7, "x"), (7, "x"), (8, "q w e r t y"), (8, "x"), (9, "q w e r t y"),
            (10, "é " * 30000), (11, "É " * 30000), (12, "a b")]
    got = {(r[0], r[1]): r[2] for r in classes(spark, rows)}
    assert got[(5, 1)] == 4 and got[(12, 1)] == 4 and got[(None, 1)] is None and got[(1, 0)] == 1 and got[(3, 0)] == 3
    assert got[(8, 1)] == 7 and got[(9, 2)] == 7 and got[(8, 2)] == 7 and got[(11, 1)] == 11
    assert classes(spark, []) == []


def test_query_over_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in catalog.QUERIES["op10_jaccard"](spark, SF).collect()), key=str) == brute(rows)


def test_keeps_one_of_each_class(spark):
    rows = [(5, "a b c d e f", "z"), (3, "a b c d e f", "y"), (4, "", "x"), (None, "a b c d e f", "w")]
    kept = J.one_per_class(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    assert sorted((r["key"] for r in kept)) == ["w", "x", "y"]


def values(rng, n):
    return np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_linked_sets_share_a_key(n, seed):
    """Also at the very border of the threshold, wherever the difference falls."""
    rng = np.random.default_rng(seed)
    a = values(rng, n)
    lose = int(rng.integers(0, n // 4 + 1))
    b = np.unique(np.concatenate([a[lose:], values(rng, int(rng.integers(0, n // 3 + 1)))]))
    if not len(b) or not J.linked(len(np.intersect1d(a, b)), len(a), len(b)):
        return
    keys = lambda s: {(k, int(x)) for k in {J.band_of(len(s)), max(0, J.band_of(len(s)) - 1)} for x in J.part_keys(s, k)}
    assert keys(a) & keys(b)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(1, 300), st.integers(0, 10**6))
def test_sketches_never_exceed_the_difference(n, m, seed):
    rng = np.random.default_rng(seed)
    both = values(rng, 50)
    a, b = (np.unique(np.concatenate([both, values(rng, k)])) for k in (n, m))
    bits = min(J.sketch_bits(len(a)), J.sketch_bits(len(b)))
    fold = lambda s: np.bitwise_xor.reduce(np.frombuffer(J.parity_bits(s), np.uint8).reshape(-1, bits // 8), axis=0)
    assert np.bitwise_count(fold(a) ^ fold(b)).sum() <= len(np.setxor1d(a, b))


def test_words_are_cut_as_stated():
    texts = ["A B\tc\x0bd\x0ce\rf", " x ", None, "é É y"]
    got = J.shingle_sets(pa.array(texts))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
