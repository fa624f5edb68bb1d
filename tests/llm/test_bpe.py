import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polyview.llm import bpe, catalog

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "e", " ", "  ", "\n", "'s", "'", "é", "日", "😀", "1", "२", "½", "\t", "\x1c", "\x85", " ", "the", "ing", "ation",
         "<|endoftext|>", ".", "!!", "_", "aaaa", " ", "　", "́", "Å", "ß", "\u0000"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH)


def same(library, own, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = own.encode([text])[0]
    assert got.tolist() == want, text
    assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_mixed_texts_equal_the_library(library, own):
    draw = random.Random(3)
    for _ in range(4000):
        same(library, own, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))))


def test_any_code_points(library, own):
    draw = random.Random(4)
    for _ in range(2000):
        same(library, own, "".join(chr(draw.choice([draw.randint(1, 0x2FF), draw.randint(0x300, 0xD7FF), draw.randint(0xE000, 0x1FFFF)])) for _ in range(8)))


def test_long_words(library, own):
    draw = random.Random(5)
    for text in ["a" * 5000, "".join(draw.choice("abehnrt") for _ in range(20000)), "é" * 999, " " * 3000, "\n" * 3000 + "x"]:
        same(library, own, text)


def test_every_token_and_pair_check(own):
    assert own.whole.all()
    draw = random.Random(6)
    import numpy as np
    a = np.array([draw.randrange(50256) for _ in range(4000)])
    b = np.array([draw.randrange(50256) for _ in range(4000)])
    fits = own.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), fits.tolist(), strict=True):
        assert (own.merge(own.tokens[x] + own.tokens[y]) == [x, y]) == ok


def test_speculation_and_both_mergers_agree(own):
    draw = random.Random(7)
    words = ["".join(draw.choice(["th", "e", "ing", "re", "ê", "ti", "on"]) for _ in range(draw.randint(1, 9))).encode() for _ in range(1500)]
    exact = [own.merge(w) for w in words]
    assert own.merge_short(words) == exact == own.encode_words(words)
    assert own.exact_words < own.seen_words


def test_query_over_all_documents(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.QUERIES["op9_bpe"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "the end", "z"), (4, "z" * 200000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").withColumn("lang", F.lit(None))
    coded = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert coded[0].asDict().keys() == {"doc_id", "text", "lang", "ids", "decoded"}
    assert sorted(len(r["ids"]) for r in coded)[:3] == [0, 0, 0]
    assert all(r["decoded"] == (r["text"] or "") for r in coded)
    assert bpe.decode(bpe.encode(df.filter("doc_id > 9"), PATH), PATH).collect() == []
    assert [r["decoded"] for r in bpe.decode(spark.createDataFrame([(None,), ([50256, -1, 99999],)], "ids array<int>"), PATH).collect()] == ["", "<|endoftext|>"]
