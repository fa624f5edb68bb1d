"""WARC archives: a writer, a normaliser for monolithic gzip files, and readers over its index.

``write_archives`` writes each task's records as one gzip stream over the whole file, as many crawls come.  Such a file
can only be read from its start.  ``normalise`` inflates each file once, piece by piece, and writes every record as
a gzip member of its own, next to a sidecar index (JSON lines: record id, offset, length, type); memory holds one
record and one piece of the stream at a time.  ``read_records`` fetches single members by offset.

Files lie in a folder all machines share.  Names hold the task's partition and a random part, and only
names that a finished task returned are read on, so that repeated or lost tasks leave nothing but unused files.

Records with equal payloads are written once: the largest id is the response, the others revisit it.  Payloads
under ``least`` bytes are always written.  Defined cases: null payloads count as empty; rows with a null id get a
record without page id and are compared like the others (a null id loses to any); ids are taken as unique.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.common import bounded
from polyview.session import cut, shared_dir

PIECE = 1 << 16
LEVEL = 6
DUPLICATES = 1_000_000  # digests of repeated payloads that may be broadcast: 80 MB
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def record(kind: str, page_id: int | None, uri: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the response's head only, and the digest and size of the full payload."""
    block = HEAD + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in pieces."""
    inflate = zlib.decompressobj(31)
    while piece := source.read(PIECE):
        while piece:
            yield inflate.decompress(piece, 16 * PIECE)
            while inflate.unconsumed_tail:
                yield inflate.decompress(inflate.unconsumed_tail, 16 * PIECE)
            piece = b""
            if inflate.eof:
                piece, inflate = inflate.unused_data, zlib.decompressobj(31)


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and raw bytes of each record in a stream of pieces."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while True:
            while held[:2] == b"\r\n":  # blank lines between records
                del held[:2]
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            fields = parse_head(bytes(held[:end]))
            total = end + 4 + int(fields["content-length"]) + 4
            if len(held) < total:
                break
            yield fields, bytes(held[:total])
            del held[:total]
    if held.strip():
        raise ValueError("the archive ends within a record")


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _folder(df: DataFrame, folder: str | None) -> str:
    folder = folder or f"{shared_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    return folder


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, url, html, record_type, refers_to)``: of equal payloads the largest id is the response.

    Only digests of repeated payloads meet the pages again; copies of one payload are counted before they are shuffled.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha1(body).alias("__sha"), F.octet_length(body).alias("__size"))
    groups = own.select("page_id", "__sha", "__size").groupBy("__sha", "__size")
    groups = groups.agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__copies")).filter(f"__copies > 1 and __size >= {int(least)}")
    repeated = bounded(groups.select("__sha", "__size", "__first"), DUPLICATES)
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    joined = own.join(repeated, ["__sha", "__size"], "left")
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``(page_id, url, html, record_type, refers_to)``: a monolithic ``.warc.gz`` file a task.

    Returns ``(path, records)`` of the files.
    """
    folder = _folder(records, folder)

    def run(batches):
        path, out, deflate, count = "", None, None, 0
        for batch in batches:
            for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, at = _open(path)
                    out, deflate = system.open_output_stream(at, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(deflate.compress(record(kind, page_id, url or "", (html or "").encode(), refers_to)))
                count += 1
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

    return cut(records.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "path string, records long"))


def normalise(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Rewrite ``.warc.gz`` files (``path``) so that every record is a member of its own.

    Returns the index: ``(path, offset, length, record_id, record_type)``; each file's part of it also lies next to
    the file as ``<path>.idx``.
    """
    folder = _folder(files, folder)

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                system, at = _open(path)
                here, place = _open(source)
                rows, offset = [], 0
                with here.open_input_stream(place, compression=None) as stream, system.open_output_stream(at, compression=None) as out, system.open_output_stream(f"{at}.idx", compression=None) as index:
                    for fields, raw in split_records(inflated(stream)):
                        member = zlib.compress(raw, LEVEL, 31)
                        out.write(member)
                        rows.append((path, offset, len(member), fields["warc-record-id"], fields["warc-type"]))
                        index.write(json.dumps({"id": rows[-1][3], "offset": offset, "length": len(member), "type": rows[-1][4]}).encode() + b"\n")
                        offset += len(member)
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 10_000], strict=True)], names=["path", "offset", "length", "record_id", "record_type"])

    spread = files.select("path").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return cut(spread.mapInArrow(run, "path string, offset long, length long, record_id string, record_type string"))


def read_records(index: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)`` of the indexed members.

    A response's size and digest are computed anew from what is read; a damaged payload raises an error.  A revisit
    has no payload (null), its size and digest are those of the record.
    """
    def run(batches):
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if path != opened[0]:
                    if opened[1] is not None:
                        opened[1].close()
                    system, at = _open(path)
                    opened = (path, system.open_input_file(at))
                raw = zlib.decompress(opened[1].read_at(length, offset), 31)
                end = raw.index(b"\r\n\r\n")
                fields = parse_head(raw[:end])
                block = raw[end + 4 : end + 4 + int(fields["content-length"])]
                payload = block[block.index(b"\r\n\r\n") + 4 :] if fields["warc-type"] == "response" else None
                told = fields["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and (digest(payload) != told or len(payload) != int(fields["x-payload-length"])):
                    raise ValueError(f"payload of {fields['warc-record-id']} in {path} is damaged")
                rows.append((_page(fields["warc-record-id"]), int(fields["x-payload-length"]), told, fields["warc-type"], _page(fields.get("warc-refers-to")), payload))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if opened[1] is not None:
            opened[1].close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return index.select("path", "offset", "length").mapInArrow(run, schema)
