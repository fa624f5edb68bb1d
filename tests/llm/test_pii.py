import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyview.llm import catalog, pii

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain(text):
    """The patterns as they are stated."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@.%-+_ 0123459(){}é\n", max_size=60))
def test_patterns_equal_their_statement(text):
    assert pii.base_spans(text) == plain(text)


def test_pattern_cases():
    for text in ["a@b.c@d.e.f x@y z@w.v.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255 ١.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (234) 555-1234 +49 30 1234567 +1+23456789012", "a" * 300 + "@" + "b" * 300 + ".c", "@a.b"]:
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans("1" * 200000 + "." + "a" * 200000 + "@") == []
    assert pii.base_spans("1.2.3." + "9" * 20000) == []


def test_tokens_hold_digits_or_at():
    text = "(a1) x b@ 2,\n c3d"
    assert [text[s:e] for s, e in pii.tokens(text)] == ["(a1)", "b@", "2", "c3d"]


def brute_marginals(field, g):
    """Sums over all labelings."""
    count, n = len(pii.KINDS) + 1, len(g.doc)
    own = pii._normal(pii.shape_columns(g.shapes) @ field.unary)
    total = np.zeros((n, count))
    for labels in np.ndindex(*[count] * n):
        if any(f >= 0 and f != x for f, x in zip(g.fixed, labels, strict=True)):
            continue
        score = sum(own[k, x] for k, x in enumerate(labels))
        score += sum(field.chain[labels[a], labels[b]] for a, b in g.chain) + sum(field.skip[labels[a], labels[b]] for a, b in g.skip)
        total[np.arange(n), labels] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def field():
    draw = np.random.default_rng(3)
    texts = []
    for k in range(400):
        number = "".join(map(str, draw.integers(0, 10, 10)))
        texts.append([f"call +1 {number[:3]} {number[3:6]} {number[6:]} now +1{number}", f"order {number[:5]} of 20{number[:2]}", f"mail x{k}@mail.example.com"][k % 3])
    return pii.fit(pii.graph(texts, [pii.base_spans(t) for t in texts]))


def test_messages_equal_sums_over_all_labelings_on_trees(field):
    text = "+15551234567 and 15551234567 then 99 88 x@y.example.com"
    g = pii.graph([text], [pii.base_spans(text)])
    assert len(g.skip) == 1 and len(g.chain) >= 1 and len(g.doc) <= 6
    np.testing.assert_allclose(pii.marginals(field, g), brute_marginals(field, g), atol=2e-3)


def test_labels_carry_over_long_distances(field):
    number, filler = "5551234567", "word " * 400
    text = f"+1{number} {filler} 1{number} {filler} 1{number} {filler} 20011"
    (base,), (added,) = pii.all_spans(field, [text])
    assert [s[0] for s in base] == ["phone"]
    assert [(k, text[s:e]) for k, s, e in added] == [("phone", f"1{number}")] * 2
    (base,), (added,) = pii.all_spans(field, [f"{filler} 20011 and 1{number[:4]}"])
    assert base == [] and added == []


def test_query_over_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = catalog.QUERIES["op7_pii"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        base = plain(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        listed = [":".join(map(str, s)) for s in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(spans) and len(spans) == len(listed) + r["n_added"]
        keys = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in spans)]
        assert keys == sorted(keys)


def test_odd_rows(spark, field):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "me@x.org", "y"), (4, "a1 " * 50000 + "é me@x.org", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, BASE string")
    out = pii.find(df, field).collect()
    assert [len(r["base"]) for r in out] == [0, 0, 0, 1, 1] and out[4]["base"][0]["start"] == 150002
    assert pii.find(df.filter("doc_id > 9"), field).collect() == []
    masked = [r["text"] for r in pii.redact(df, field).collect()]
    assert masked[:4] == [None, "", "", "[EMAIL]"] and masked[4].endswith("é [EMAIL]")
    empty = pii.train(df.filter("doc_id > 9"))
    assert [len(r["added"]) for r in pii.find(df, empty).collect()] == [0] * 5


def test_training_takes_one_row_per_id_and_brings_no_text(spark, monkeypatch):
    texts = [f"call +1 555 {k:03d} {k * 37 % 10000:04d} or 1555{k:03d}{k * 37 % 10000:04d} mail x{k}@mail.example.com 2{k}" for k in range(40)]
    rows = list(enumerate(texts)) + [(7, texts[7])] * 200 + [(7, texts[7] + " " + "9" * 5000 + " a1")]
    brought = []
    real = type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: brought.append(real(df)) or brought[-1])
    got = pii.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = pii.fit(pii.graph(texts, [pii.base_spans(t) for t in texts]))
    for one, two in ((got.unary, want.unary), (got.chain, want.chain), (got.skip, want.skip)):
        np.testing.assert_allclose(one, two, atol=1e-9)
    assert all("text" not in t.column_names and t.num_rows < 2000 for t in brought)
