import zlib

import numpy as np
from pyspark.sql import functions as F

from polyview.llm import catalog, langid

SF = "/root/testdata/sf0.01"


def viterbi(scores, switch):
    """The plain recursion, word by word."""
    value, back = np.zeros(scores.shape[1], np.int64), []
    for s in scores:
        jump = value.max() - switch
        back.append(np.where(value >= jump, np.arange(len(value)), value.argmax()))
        value = np.maximum(value, jump) + s
    out = [int(value.argmax())]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_blocks_equal_the_plain_recursion():
    rng = np.random.default_rng(3)
    for langs in (1, 2, 5):
        lengths = np.array([1, 63, 64, 65, 128, 700, 2, 1])
        for spread in (3, 40):  # many ties, few ties
            scores = rng.integers(-spread, spread, (lengths.sum(), langs))
            got = np.split(langid.best_labels(scores, lengths, 5), np.cumsum(lengths)[:-1])
            for own, labels in zip(np.split(scores, np.cumsum(lengths)[:-1]), got, strict=True):
                assert labels.tolist() == viterbi(own, 5)


def test_features_of_a_word_don_t_depend_on_its_neighbours():
    found = ["a", "straße", "это", "a" * 5000]
    buckets, counts = langid.features(found)
    for w, own in zip(found, np.split(buckets, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == langid.features([w])[0].tolist()


def test_held_out_documents_of_the_given_table(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.QUERIES["op12_langid"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    hits, tried = {}, {}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        text = truth[r["doc_id"]]["text"]
        assert (r["lang_pred"] == "und") == (not langid.words(text))
        for s in r["spans"]:
            assert text[s["start"]].isalpha() and 0 <= s["start"] < s["end"] <= len(text)
        if r["held_out"] and r["lang_pred"] != "und":
            lang = truth[r["doc_id"]]["lang"]
            tried[lang] = tried.get(lang, 0) + 1
            hits[lang] = hits.get(lang, 0) + (r["lang_pred"] == lang)
    assert set(tried) == {"en", "de", "es", "fr"}
    assert all(hits[x] >= 0.95 * tried[x] for x in tried), (hits, tried)


def model(spark):
    de, en, ru = "der die und nicht straße für", "the and with this from house", "это дом они был мир"
    return langid.train(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([(de, "de"), (en, "en"), (ru, "ru")] * 20)], "doc_id long, text string, lang string"))


def test_mixed_texts_fall_into_spans(spark):
    text = "1. the house and this, with the house! der die straße und nicht für die straße; это дом они был"
    row = langid.label(spark.createDataFrame([(text,)], "text string"), model(spark)).first()
    assert [(text[s["start"] : s["end"]], s["lang"]) for s in row["spans"]] == [
        ("the house and this, with the house", "en"), ("der die straße und nicht für die straße", "de"), ("это дом они был", "ru"),
    ]
    assert row["lang_pred"] == "de"


def test_defined_cases(spark):
    texts = [None, "", "12 !!", "the house", "the house", "中文字", "x", "the " * 120_000, "A" * 100_000, "İstanbul the house"]
    df = spark.createDataFrame([(t, "clash", 7) for t in texts], "text string, LANG_PRED string, n int")
    rows = langid.label(df, model(spark)).collect()
    assert [r["lang_pred"] for r in rows[:5]] == ["und", "und", "und", "en", "en"] and [r["score"] for r in rows[:4]] == [0, 0, 0, 1]
    assert rows[5]["lang_pred"] == "de"  # a script nobody uses: all tie
    assert rows[7]["spans"] == [(0, 479_999, "en")] and len(rows[8]["spans"]) == 1 and rows[0]["n"] == 7
    assert langid.label(df.limit(0), model(spark)).count() == 0
    blank = langid.train(spark.createDataFrame([(1, None, "en"), (2, "ok", None), (None, "ok", "en")], "doc_id long, text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.label(df, blank).collect()} == {("und", 0.0)}


def test_training_is_bounded_and_takes_one_text_an_id(spark):
    rows = [(i % 50, f"word{'abcdefghij'[i % 10]} text", "en") for i in range(500)] + [(900, "mot", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = langid.train(df.withColumn("extra", F.lit(1)), texts=1)
    assert few.langs == ["en", "fr"] and few.allowed[langid.SCRIPTS.index("latin")].all()
