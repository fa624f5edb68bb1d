import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyview.llm import catalog
from polyview.llm import toxicity as X

SF = "/root/testdata/sf0.001"
BAD = {"en": ["vile", "rotten"], "de": ["fies", "mies"]}


def corpus(n, seed):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        lang = draw.choice(["en", "de"])
        toxic = int(draw.random() < 0.25)
        words = [f"{lang}{draw.randrange(300)}" for _ in range(draw.randint(5, 120))]
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(BAD[lang]) + draw.choice(["", ",", "!"])
        out.append((k, " ".join(words), lang, toxic))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(1500, 1)
    return X.fit(pa.array([r[1] for r in rows]), np.array([r[3] for r in rows]), [r[2] for r in rows], steps=800)


def test_held_out_accuracy(model):
    rows = corpus(600, 2)
    got = model.rescale(X.raw_scores(model, pa.array([r[1] for r in rows]))) >= X.CUT
    want = np.array([r[3] for r in rows]) == 1
    assert (got == want).mean() > 0.97
    assert set(model.cuts) == {"en", "de"} and all(0 < c <= 1 for c in model.cuts.values())


def test_pooling_equals_every_window_by_hand(model):
    texts = ["en1 vile en3", "fies", "", "en1", "en1 en2 en3 en4 vile rotten en9"]
    rows, ends = X.word_rows(pa.array(texts))
    pooled = X._pooled(model, rows, ends)
    start = 0
    for k, end in enumerate(ends):
        x = model.table[rows[start:end]]
        at = 0
        for weights, bias in model.banks:
            width, _, filters = weights.shape
            windows = [sum(x[i + j] @ weights[j] for j in range(width)) + bias for i in range(len(x) - width + 1)]
            want = np.maximum(0, np.max(windows, axis=0)) if windows else np.zeros(filters)
            np.testing.assert_allclose(pooled[k, at : at + filters], want, atol=1e-5)
            at += filters
        start = end


def test_chunks_and_runs_don_t_change_scores(model, monkeypatch):
    texts = pa.array([r[1] for r in corpus(40, 3)] + [" ".join(r[1] for r in corpus(30, 4)), "", None])
    whole = X.raw_scores(model, texts)
    monkeypatch.setattr(X, "CHUNK", 50)
    np.testing.assert_allclose(X.raw_scores(model, texts), whole, atol=1e-5)


def test_cut_is_the_best_f1():
    scores, labels = np.array([0.9, 0.8, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0, 0])
    assert X._best_cut(scores, labels) == pytest.approx(0.55)


def test_odd_rows(spark, model):
    rows = [(1, None, "xx", 5.0), (2, "", None, 1.0), (2, "", None, 1.0), (None, "so vile", "en", 1.0), (4, "vile " * 150000, "de", 0.0)]
    out = X.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double"), model).collect()
    assert [c.lower() for c in out[0].asDict()].count("score") == 1
    assert all(0 <= r["score"] <= 1 and r["flagged"] is not None for r in out)
    assert out[0]["score"] == out[1]["score"] == out[2]["score"]
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_training_uses_no_held_out_row_and_survives_little(spark):
    rows = corpus(60, 5)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    flip = lambda held: spark.createDataFrame([(r[0], 1 - r[3] if held and zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[3]) for r in rows], "doc_id long, toxic int")
    a, b = X.train(docs, flip(False)), X.train(docs, flip(True))
    assert np.array_equal(a.table, b.table) and a.cut == b.cut
    none = X.train(docs, spark.createDataFrame([(None, 1), (5, None), (6, 7)], "doc_id long, toxic int"))
    assert max(r["score"] for r in X.score(docs, none).collect()) < 0.01


def test_query_scores_every_document(spark):
    rows = catalog.QUERIES["op2_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert spark.range(1).select(X.held_out("id")).count() == 1 and F


def test_long_texts_and_repeated_ids_don_t_spoil_the_sample(spark, monkeypatch):
    rows = corpus(60, 6)
    taken = []
    monkeypatch.setattr(X, "fit_rows", lambda rows, ends, labels, langs: taken.append((len(rows), len(ends))))
    frames = lambda rows: (spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"))
    X.train(*frames(rows))
    ids = [r["doc_id"] for r in frames(rows)[0].filter(~X.held_out()).orderBy(F.xxhash64("doc_id")).collect()]
    X.train(*frames(rows + [rows[ids[3]]] * 50))
    assert taken[1] == taken[0] == (taken[0][0], len(ids))
    X.train(*frames([(k, "long " * 20000, lang, toxic) if k == ids[0] else (k, text, lang, toxic) for k, text, lang, toxic in rows]), words=10000)
    assert taken[2][1] == len(ids) - 1 and taken[2][0] <= 10000


def test_every_labelled_row_trains_in_shards(spark):
    """Toxic words that only a late part of the ids holds are learnt too, whatever the shards' size."""
    rows = corpus(900, 7)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = X.train_all(docs, marks, sample=200, steps=150)
    ids = sorted(r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1)
    got = {r["shard"]: r["n"] for r in X._labelled(docs, marks, 200, X.WORDS).groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    assert len(got) > 1 and sum(got.values()) == len(ids)
    test = corpus(400, 8)
    flagged = model.rescale(X.raw_scores(model, pa.array([r[1] for r in test]))) >= X.CUT
    assert (flagged == (np.array([r[3] for r in test]) == 1)).mean() > 0.95
    assert set(model.cuts) == {"en", "de"}
    again = X.train_all(docs, marks.union(marks), sample=200, steps=150)
    np.testing.assert_allclose(again.table, model.table)
    none = X.train_all(docs, spark.createDataFrame([(None, 1), (5, None), (6, 7)], "doc_id long, toxic int"))
    assert max(r["score"] for r in X.score(docs, none).collect()) < 0.01


def test_places_of_long_texts_equal_one_run(model, monkeypatch):
    rows, ends = X.word_rows(pa.array([" ".join(r[1] for r in corpus(9, 9)), "", "vile"]))
    whole = [X._places(model, k, rows, ends) for k in range(3)]
    monkeypatch.setattr(X, "CHUNK", 7)
    for (best, where), k in zip(whole, range(3), strict=True):
        got = X._places(model, k, rows, ends)
        np.testing.assert_allclose(got[0], best, atol=1e-5)
        assert ((got[1] >= 0) == (where >= 0)).all()
