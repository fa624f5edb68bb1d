import public_tokenizers
import pyarrow as pa
import test_decontam
import test_jaccard
from tokenizers import Tokenizer

import corpus_pipeline
from polyview.llm import pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "bpe"]


def test_run_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.rescale(toxicity.raw_scores(model, pa.array([t for _, t, _ in docs])))
    docs = [d for d, s in zip(docs, scores, strict=True) if s < model.cuts.get(d[2], toxicity.CUT)]
    classes = {i: c for i, _, c in test_jaccard.brute([(i, t) for i, t, _ in docs])}
    docs = [d for d in docs if classes[d[0]] == d[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {x[0] for x in test_decontam.brute([(i, t) for i, t, _ in docs], items)}
    docs = [d for d in docs if d[0] not in leaks]
    kept = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.redact(kept, pii.train(kept)).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(masked) and 0 < len(got) < 200
    for i, text in masked.items():
        assert got[i]["ids"] == library.encode(text, add_special_tokens=False).ids and got[i]["lossless"]


def test_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, "s", None, "a"), (2, "", "en", None, 0, "b"), (3, "x y", "en", "s", 3, "c"), (3, "x y", "en", "s", 3, "c"), (None, "me@x.org", "xx", "s", 8, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in out) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.filter("doc_id > 9"), folder).columns == docs.columns
        docs = stage(spark, docs, folder)
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
