import random

import public_tokenizers
import pyarrow as pa

from polyview.llm import catalog, counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, pieces):
    """The best split by plain dynamic programming over one word."""
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + counts.UNKNOWN, best[end - 1][1] + 1)]
        options += [(best[s][0] + pieces[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in pieces]
        best[end] = min(options, key=lambda o: (-o[0], o[1]))
    return best[-1][1]


def of_text(text, pieces):
    return sum(brute(counts.SPACE + w, pieces) for w in (text or "").split())


def test_words_equal_plain_programming():
    draw = random.Random(2)
    pieces = {"".join(draw.choice("abc▁") for _ in range(draw.randint(1, 4))): -draw.randint(1, 9) for _ in range(60)}
    own = counts.Trie(pieces)
    for _ in range(3000):
        word = "".join(draw.choice("abcd▁") for _ in range(draw.randint(0, 9)))
        assert own.insert(word) == brute(word, pieces)


def test_prefixes_are_computed_once():
    own = counts.Trie({"a": -1, "b": -1, "ab": -1})
    own.insert("abab")
    before = len(own.score)
    own.insert("aba")
    own.insert("abab")
    assert len(own.score) == before == 5
    own.insert("abb")
    assert len(own.score) == before + 1


def test_query_over_all_documents(spark):
    pieces = counts.zipf_pieces(PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.QUERIES["op5_counts"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    memo = {}
    for r in rows[::4]:
        words = docs[r["doc_id"]].split()
        for w in words:
            memo[w] = memo.get(w) or brute(counts.SPACE + w, pieces)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(memo[w] for w in words))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(counts, "NODES", 5)
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", "y"), (None, "日本 the", "z"), (4, "a" * 100000, "z"), (4, "a" * 100000, "z")]
    out = counts.with_counts(spark.createDataFrame(rows, "doc_id long, text string, N_tokens string"), PATH).collect()
    assert [r["n_pretokens"] for r in out] == [0, 0, 0, 2, 1, 1] and out[4]["n_tokens"] == out[5]["n_tokens"] > 100
    assert out[0]["n_tokens"] == 0 and [c.lower() for c in out[0].asDict()].count("n_tokens") == 1
    own = counts.trie(PATH)
    assert counts.token_counts(pa.array(["the end", "the end"]), own)[0].tolist() == counts.token_counts(pa.array(["the end"] * 2), own)[0].tolist()
    assert counts.with_counts(spark.createDataFrame([], "text string"), PATH).collect() == []


def test_long_words_stay_within_the_nodes(monkeypatch):
    draw = random.Random(5)
    pieces = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 5))): -draw.randint(1, 9) for _ in range(70)}
    monkeypatch.setattr(counts, "DEPTH", 12)
    own = counts.Trie(pieces)
    for size in (11, 12, 13, 17, 40, 400):
        for _ in range(60):
            word = "".join(draw.choice("abcd") for _ in range(size))
            assert own.insert(word) == brute(word, pieces)
    monkeypatch.undo()
    monkeypatch.setattr(counts, "NODES", 3000)
    wide = counts.Trie(pieces)
    texts = pa.array(["".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(20_000)) for _ in range(40)])
    counts.token_counts(texts, wide)
    assert len(wide.score) <= counts.NODES + counts.DEPTH
