import math
import random
import re

import numpy as np
import pytest

from polyview.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    split = [(d, TERM.findall((t or "").translate(LOW))) for d, t in docs]
    full = [(d, w) for d, w in split if w]
    n, total = len(full), sum(len(w) for _, w in full)
    df = {}
    for _, w in full:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOW)))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, w in full:
            m = 10 + (90 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in df)
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(i, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], "doc_id long, text string, term string, score double")
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, rank string")
    return sorted((tuple(r) for r in ranked.ranked(d, q, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Ünïcode", "ÄÖ", "x_y", "Z"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))) for i in range(n)], vocabulary, rng


@pytest.mark.parametrize("segment", [7, 4096])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(ranked, "SEGMENT", segment)
    monkeypatch.setattr(ranked, "BLOCK", 3)
    docs, vocabulary, rng = corpus(1, 150)
    docs += [(500 + i, docs[3][1]) for i in range(60)] + [(7, docs[7][1])] * 3 + [(None, docs[3][1]), (None, "w1"), (900, None), (901, ""), (902, "?! \x00\x7f")]
    docs.append((903, "w2 " * 50_000 + "rare"))
    items = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for i in range(12)]
    items += [(50, docs[3][1]), (51, "unheard of words"), (52, None), (53, ""), (None, "w5 rare"), (54, "w1 w2"), (54, "w40"), (54, "w40"), (55, "RARE")]
    assert found(spark, docs, items) == brute(docs, items)


def test_sets_of_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ranked, "PAIRS", 15)
    docs, vocabulary, rng = corpus(2, 60)
    items = [(i, " ".join(rng.sample(vocabulary, 5))) for i in range(8)]
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_blocks_bound_their_documents_and_some_are_skipped(spark):
    docs, vocabulary, rng = corpus(3, 400, words=300)
    items = [(i, " ".join(rng.sample(vocabulary, 6))) for i in range(10)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    own = ranked._listed(ranked._item_terms(spark.createDataFrame(items, "item_id long, text string")))
    placed = ranked.segmented(ranked._with_statistics(d, own, 2))
    wanted = own.essential()
    index = ranked.blocks(placed, own, wanted).toArrow().combine_chunks()
    group = ranked.Lists(placed.toArrow().combine_chunks())
    asked = ranked._asked(wanted)
    held = {}
    for r in index.to_pylist():
        coordinates = np.unique(np.concatenate([own.of[i] for i in asked[r["term"]]]))
        rows = group.rows(np.array(r["docs"]), coordinates)
        kept = dict(zip(r["terms"], r["tops"], strict=True))
        assert rows.max(axis=0).tolist() == [kept.get(int(t), 0) for t in coordinates]
        held.setdefault(r["term"], []).extend(r["docs"])
    for term, places in held.items():  # a list's blocks hold each of its documents once
        assert sorted(places) == group.of(term)[0].tolist()
    counts = [ranked.passing(index, i, own, np.array(sorted(t for j, t in wanted if j == i)))[1:] for i in range(len(own.ids))]
    assert sum(kept for _, kept in counts) < sum(n for n, _ in counts)


def test_clusters_keep_copies_together():
    rows = np.array([[1, 0, 5], [4, 0, 0], [0, 3, 0]] * 40)
    home = ranked.clusters(rows)
    assert len({tuple(h) for h in home.reshape(-1, 3)}) == 1
