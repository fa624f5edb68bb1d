import zlib

import pytest
from pyspark.sql import functions as F

from polyview.llm import catalog
from polyview.llm.sharding import Tree, place, sized, slots

SF = "/root/testdata/sf0.001"


def shards(spark, tree, n=4000):
    return {r["k"]: r for r in place(spark.range(n).withColumnRenamed("id", "k"), "k", tree).collect()}


def test_query_over_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.QUERIES["op1_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_shares_follow_weights(spark):
    tree = Tree.even(2, 2, 2).weighing(3, 9.0)
    got = shards(spark, tree, 16000)
    share = sum(r["shard"] == 3 for r in got.values()) / len(got)
    assert abs(share - 9 / 16) < 0.02
    assert {(r["region"], r["rack"], r["shard"]) for r in got.values()} == {leaf[:3] for leaf in tree.leaves}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    tree = Tree.even(2, 2, 4)
    for _ in range(2):
        old, new = shards(spark, tree), shards(spark, tree.grown())
        added = max(leaf[2] for leaf in tree.grown().leaves)
        moved = [k for k in old if old[k]["shard"] != new[k]["shard"]]
        assert moved and all(new[k]["shard"] == added for k in moved)
        tree = tree.grown()


def test_other_weights_move_rows_only_through_their_subtree(spark):
    tree = Tree.even(3, 2, 2)
    heavier = tree.weighing(5, 3.0)
    old, new = shards(spark, tree), shards(spark, heavier)
    region, rack = 1, 2
    for k in old:
        if old[k]["region"] != new[k]["region"]:
            assert new[k]["region"] == region
        elif old[k]["rack"] != new[k]["rack"]:
            assert old[k]["region"] == region and new[k]["rack"] == rack
        elif old[k]["shard"] != new[k]["shard"]:
            assert old[k]["rack"] == rack and new[k]["shard"] == 5
    drained = shards(spark, tree.weighing(0, 0.0))
    assert all(r["shard"] != 0 for r in drained.values())


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (None, "é", "z"), (7, "a" * 300000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("slot", F.lit("old"))
    out = slots(place(sized(df), "doc_id", Tree.even(1, 2, 2)), "shard", "doc_id").collect()
    assert sorted(r["size"] for r in out) == [1, 1, 1, 3, 300001]
    assert len({r["shard"] for r in out if r["doc_id"] == 1}) == 1 and len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    for s in {r["shard"] for r in out}:
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    df = spark.createDataFrame([], schema)
    assert slots(place(sized(df), "doc_id", Tree.even(2, 2, 4)), "shard", "doc_id").collect() == []


def brute_place(tree, key_hashes):
    """The descent in plain Python: at each level the child of the least exponential draw, from Spark's hashes of (key, depth, child)."""
    import math

    path, parent = [], -1
    for depth in range(3):
        draws = [(-math.log(((key_hashes[depth, c] >> 11) + 0.5) * 2.0**-53) / w, c) for c, w in tree.level(depth)[parent].items()]
        parent = min(draws)[1]
        path.append(parent)
    return tuple(path)


def test_descent_against_plain_python(spark):
    tree = Tree.even(2, 2, 4).weighing(5, 3.0).grown()
    nodes = sorted({(d, c) for d in range(3) for cs in tree.level(d).values() for c in cs})
    keys = spark.range(400).withColumnRenamed("id", "k")
    hashes = keys.select("k", *[F.xxhash64("k", F.lit(d), F.lit(c)).alias(f"h{d}_{c}") for d, c in nodes]).collect()
    want = {r["k"]: brute_place(tree, {(d, c): r[f"h{d}_{c}"] % 2**64 for d, c in nodes}) for r in hashes}
    got = {r["k"]: (r["region"], r["rack"], r["shard"]) for r in place(keys, "k", tree).collect()}
    assert got == want


def test_slots_of_rows_of_one_id_follow_their_texts(spark):
    rows = [(1, f"text {i}") for i in range(40)] + [(1, "text 0")] * 3 + [(2, "b"), (None, None)]
    df = sized(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("shard", F.lit(0))
    runs = [sorted((r["slot"], r["doc_id"], r["text"]) for r in slots(df.repartition(n), "shard", "doc_id", ties=("text_crc32", "size")).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and [s for s, _, _ in runs[0]] == list(range(len(rows)))
