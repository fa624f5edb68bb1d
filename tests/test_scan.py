"""The tiled scan equals the plain window, with one key holding a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyview.plans import scan, stats

def kinds():
    return {
        "n": scan.number(),
        "s": scan.running_sum(F.col("v")),
        "s0": scan.running_sum(F.col("v"), strict=True),
        "m": scan.running_max(F.col("v")),
        "m0": scan.running_max(F.col("v"), strict=True),
        "last": scan.last_seen(F.col("w")),
        "last0": scan.last_seen(F.col("w"), strict=True),
        "next": scan.next_seen(F.col("w")),
        "next0": scan.next_seen(F.col("w"), strict=True),
        "lag": scan.lagged(F.col("w")),
        "lead": scan.leading(F.col("w")),
        "all": scan.group_sum(F.col("v")),
        "size": scan.group_size(),
    }


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [
        (None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"k{rnd.randrange(9)}"), i, rnd.randrange(20), rnd.randrange(5) if rnd.random() < 0.2 else None)
        for i in range(600)
    ]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "k string, id int, v long, w int").cache()


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("down", [False, True])
def test_tiles_equal_windows(rows, keys, down):
    order = [F.col("v").desc() if down else F.col("v"), F.col("id")]
    plain = scan.along(rows, keys, order, kinds(), fits=True)
    tiled = scan.along(rows, keys, order, kinds(), fits=False)
    assert plain.columns == tiled.columns
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, tiled.collect()), key=str)


def test_limit_setting_picks_the_path(spark, rows):
    assert scan.largest_group(rows, ["k"]) == rows.filter("k = 'hot'").count()
    assert scan.group_fits(rows, ["k"])
    spark.conf.set(scan.LIMIT_SETTING, "100")
    try:
        assert not scan.group_fits(rows, ["k"])
    finally:
        spark.conf.unset(scan.LIMIT_SETTING)


def test_quantiles_by_ranks_equal_percentile(rows):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    fast = stats.quantiles(rows, ["k"], F.col("v"), probs, fits=True)
    slow = stats.quantiles(rows, ["k"], F.col("v"), probs, fits=False)
    flat = lambda df: {r["k"]: [round(x, 9) for x in r[1:]] for r in df.collect()}
    assert flat(fast) == flat(slow)


def test_medians_agree(rows):
    cols = {"a": F.col("v"), "b": F.col("id")}
    key = lambda df: sorted((str(r["k"]), r["a"], r["b"]) for r in df.filter("k IS NOT NULL").collect())
    assert key(stats.medians(rows, ["k"], cols, fits=True)) == key(stats.medians(rows, ["k"], cols, fits=False))


def test_nearest_second_of_an_empty_table(spark):
    from polyview.operators.ordered import nearest_second

    assert nearest_second(spark.createDataFrame([], "t double, i long"), "t", "i").collect() == []


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_quantiles_by_narrowing_histograms(spark, monkeypatch, buckets):
    monkeypatch.setattr(stats, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=60), "b": [3.0], "c": [1.0, 1.0, 1.0, 2.0], None: 10.0 ** rng.uniform(-12, 12, 25) if buckets > 2 else [4.0, 5.0], "d": [-1e308, 0.0, 1e308]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"low": 0.0, "mid": 0.5, "most": 0.95}
    got = {r["k"]: [r[n] for n in probs] for r in stats.quantiles(df, ["k"], F.col("v"), probs, fits=False).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, list(probs.values())).tolist(), rel=1e-12)
    flat = df.filter("k IN ('a', 'c')")
    one = stats.quantiles(flat, [], F.col("v"), probs, fits=False).first()
    every = [v for k, v in rows if k in ("a", "c") and v is not None]
    assert list(one) == pytest.approx(np.quantile(every, list(probs.values())).tolist(), rel=1e-12)


@pytest.mark.parametrize("fits", [True, False])
def test_no_scan_runs_through_the_rest_of_its_group_for_every_row(spark, fits):
    df = spark.range(50).select("id", F.when(F.col("id") % 7 == 3, F.col("id")).alias("v"))
    specs = {"at": scan.next_seen(F.col("v")), "after": scan.next_seen(F.col("v"), strict=True), "last": scan.last_seen(F.col("v"))}
    out = scan.along(df, [], [F.col("id")], specs, fits=fits)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    marks = range(3, 50, 7)
    for r in out.collect():
        assert r["at"] == next((m for m in marks if m >= r["id"]), None)
        assert r["after"] == next((m for m in marks if m > r["id"]), None)
        assert r["last"] == next((m for m in reversed(marks) if m <= r["id"]), None)
