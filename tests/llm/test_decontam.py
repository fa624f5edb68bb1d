import random
from collections import Counter

from polyview.llm import decontam as D


def brute(docs, items):
    """Every window of every document against every item."""
    found = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if not v:
                continue
            k = min(D.WIDTH, len(v))
            cut = lambda x: Counter(tuple(x[p : p + k]) for p in range(len(x) - k + 1))
            own = cut(v)
            for start in range(len(w) - k + 1):
                window = cut(w[start : start + len(v)])
                shared = (window & own).total()
                union = window.total() + own.total() - shared
                if 100 * shared >= 75 * union and ((d, i) not in found or shared / union > found[(d, i)][1] / found[(d, i)][2]):
                    found[(d, i)] = (start, shared, union)
    return {(d, i, *v[1:]) for (d, i), v in found.items()}


def run(spark, docs, items):
    rows = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({tuple(r)[:2] for r in rows}) == len(rows)
    texts, own = dict(docs), dict(items)
    for r in rows:  # the window begins with a shingle of an item of that length
        w, n = texts[r["doc_id"]].lower().split()[r["start"] :], len(own[r["item_id"]].split())
        assert any(" ".join(w[: min(5, n)]) in " ".join((x or "").lower().split()) for _, x in items if len((x or "").split()) == n)
    return {(r["doc_id"], r["item_id"], r["n_shared"], r["n_union"]) for r in rows}


def test_planted_passages_equal_brute_force(spark):
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(900)}"
    items = [(k, " ".join(word() for _ in range(draw.choice([1, 3, 5, 6, 14, 30, 30, 59])))) for k in range(25)]
    items += [(90, "a b a b a b a b a b a b"), (91, items[3][1]), (92, None), (93, " ")]
    docs = []
    for k in range(60):
        own = draw.choice(items[:25])[1].upper().split()
        for _ in range(draw.choice([0, 0, 1, 2])):
            at = draw.randrange(len(own))
            own[at : at + 1] = draw.choice([[], [word()], [own[at], word()]])
        docs.append((k, "\n".join([word() for _ in range(draw.randrange(40))] + own[draw.choice([0, 0, 2]) :] + [word() for _ in range(draw.randrange(40))])))
    docs += [(100, "x a b a b a b a b a b a b y"), (101, items[4][1]), (101, items[4][1]), (102, None), (103, ""), (104, "a b a b a b")]
    want = brute(docs, items)
    assert len(want) > 20 and run(spark, docs, items) == want


def test_blocks_find_every_pair_within_the_radius():
    draw = random.Random(2)
    for _ in range(300):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), D.RADIUS):
            y ^= 1 << b
        parts = zip(D._EDGES, D._EDGES[1:], strict=False)
        assert any((x ^ y) >> lo & ((1 << hi - lo) - 1) == 0 for lo, hi in parts)


def test_fingerprint_is_the_majority(spark):
    rows = [("a b c d e f g h",), ("a b c d e",), ("z " * 300,)]
    df = spark.createDataFrame(rows, "text string").select(D.words(D.F.col("text")).alias("w"))
    for r in D.with_fingerprint(df.withColumn("h", D._hashes(D.F.col("w"), 5)), "w", 5).collect():
        want = 0
        for b in range(64):
            want |= (sum(h >> b & 1 for h in r["h"]) * 2 > len(r["h"])) << b
        assert r["mark"] & (2**64 - 1) == want


def test_odd_rows_and_cleaning(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = [(1, "say ONE two three four five six now", "x"), (2, None, "y"), (3, "", "z"), (None, "one two three four five six", "v"), (5, "other " * 60000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    assert sorted(r["item_id"] for r in D.clean(docs, items).collect()) == ["u", "y", "z"]
    assert D.leaks(docs.filter("doc_id > 9"), items).collect() == []
    assert D.leaks(docs, items.filter("item_id > 9")).collect() == []
    assert D.clean(docs, items.filter("item_id > 9")).count() == 5
    monkeypatch.setattr(D, "ROWS", 1)  # more shingles than one broadcast may hold
    assert sorted(r["item_id"] for r in D.clean(docs, items).collect()) == ["u", "y", "z"]
