import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest

from polyview.llm import catalog, warc

SF = "/root/testdata/sf0.001"


def expected(rows):
    first = {}
    for i, html in rows:
        first[html or ""] = max(first.get(html or "", i), i)
    out = set()
    for i, html in rows:
        raw = (html or "").encode()
        own = first[html or ""]
        out.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own == i else "revisit", None if own == i else own))
    return out


def test_query_over_all_pages(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows = catalog.QUERIES["op3_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(rows) == len(pages) and {tuple(r) for r in rows} == expected(pages)


def test_round_trip_members_and_sidecar(spark, tmp_path):
    rows = [(1, "u", "same\r\n\r\nWARC/1.1 text"), (5, "u\nv", "same\r\n\r\nWARC/1.1 text"), (3, None, "same\r\n\r\nWARC/1.1 text"), (4, "x", None), (6, "y", ""), (7, "z", "é" * 400000), (8, "z", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(warc.with_revisits(df), str(tmp_path / "raw"))
    assert sum(r["records"] for r in files.collect()) == 7
    index = warc.normalise(files, str(tmp_path / "members"))
    read = warc.read_records(index).collect()
    assert {tuple(r)[:5] for r in read} == expected([(i, h) for i, _, h in rows])
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == texts[r["page_id"]] for r in read)
    for path in {r["path"] for r in index.collect()}:
        raw = open(path, "rb").read()
        side = [json.loads(x) for x in open(path + ".idx")]
        assert sum(s["length"] for s in side) == len(raw)
        for s in side:  # each member stands alone
            assert gzip.decompress(raw[s["offset"] : s["offset"] + s["length"]]).startswith(b"WARC/1.1\r\nWARC-Type: " + s["type"].encode())
    apart = warc.with_revisits(df, least=5).filter("record_type = 'revisit'").collect()
    assert sorted(r["page_id"] for r in apart) == [1, 3]


def test_streams_of_any_cut():
    records = [warc.record("response", k, "u", b"x" * k, None) for k in (0, 1, 70000)] + [warc.record("revisit", 9, "u", b"abc", 2)]
    whole = b"".join(records)
    for packed in (gzip.compress(whole), b"".join(gzip.compress(r) for r in records)):
        assert b"".join(warc.inflated(io.BytesIO(packed))) == whole
    for size in (1, 7, 5000):
        pieces = (whole[k : k + size] for k in range(0, len(whole), size))
        assert [raw for _, raw in warc.split_records(pieces)] == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([whole[:-10]])))


def test_damage_is_noticed(spark, tmp_path):
    raw = warc.record("response", 1, "u", b"abc", None).replace(b"abc", b"abd")
    path = str(tmp_path / "x.warc.gz")
    member = zlib.compress(raw, 6, 31)
    open(path, "wb").write(member)
    index = spark.createDataFrame([(path, 0, len(member))], "path string, offset long, length long")
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(index).collect()


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "a", 1), (None, None, "b", 1), (2, None, "a", 1)], "page_id long, url string, html string, record_type int")
    rows = warc.read_records(warc.normalise(warc.write_archives(warc.with_revisits(df)))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in rows) == [(0, "response", 0), (0, "revisit", 2), (2, "response", 0)]
    empty = warc.with_revisits(df.filter("page_id > 9"))
    assert warc.read_records(warc.normalise(warc.write_archives(empty))).collect() == []
