import random

import pytest

from polyview.llm import catalog, topk

SF = "/root/testdata/sf0.001"
INF = float("inf")


def brute(rows, queries, k, scale=256):
    import math
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if queries(i)}):
        own = min(v for i, v in fine if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


def run(spark, rows, queries, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in topk.top_inner_products(df, df.filter(queries), k).collect())


def test_query_over_all_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in catalog.QUERIES["op4_topk"](spark, SF).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_many_blocks_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "BANDS", 8)
    draw = random.Random(4)
    rows = [(k, [draw.gauss(0, 1) * (1 + spread * draw.random()) ** 2 * (j < 3 or 0.2) for j in range(9)]) for k in range(200)]
    rows += [(500 + k, rows[3][1]) for k in range(20)]  # equal vectors
    assert run(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i % 10 == 0, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [0.5, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [INF, 1.0]), (6, [float("nan"), 1.0]), (None, [9.0, 9.0]), (50, [-1.0]), (7, [0.0, 0.0])]
    assert run(spark, rows, "vec_id % 50 = 0") == brute(rows, lambda i: i % 50 == 0, 5)
    assert run(spark, rows[:1], "vec_id = 0") == [] == run(spark, [], "vec_id = 0")
    big = [(0, [3e9, 1.0]), (1, [-3e3, 5.0]), (2, [3e3, 7.0])]
    assert run(spark, big, "vec_id = 0") == brute(big, lambda i: i == 0, 5)
