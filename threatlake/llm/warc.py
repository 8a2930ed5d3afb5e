"""WARC archives of pages: revisits, segmented records, chunked payloads.

Writing: a page is a response record unless a page with an equal payload of at least
``REVISIT_BYTES`` bytes and a larger page_id exists; then it is a revisit of the largest one.
Payloads travel as HTTP responses with chunked transfer framing.  A block longer than
``SEGMENT_BYTES`` goes on in continuation records.  Records are rows of text files whose line end is
the two line ends that close a record, so Spark writes, commits and repeats the files; each file
is gzip compressed and holds a bounded number of records.

Reading: each file is parsed by its Content-Length fields.  Whole records are decoded where they
are; segments are grouped by the id of the record they continue, ordered by number and checked
against the total length, then their chunked framing is decoded.

Payloads that many pages share are counted before the shuffle, and the pages that look for them
are salted.  Null html is empty.  A null page_id is less than any other and is left out of the
header; pages that repeat the largest page_id with the same payload are all responses.  Repeated
rows give a record each.  Empty tables give no records.  Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

REVISIT_BYTES = 1000
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 8192

_SALTS = 32
_LINE = b"\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = (
    "record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary, origin string, number int, total bigint, block binary"
)


def _kinds(schema: str) -> tuple[list[str], list[pa.DataType]]:
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return [n for n, _ in fields], [types[t] for _, t in fields]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = _kinds(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are skipped."""
    at, parts = 0, []
    while True:
        end = body.index(_LINE, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        if body[at : at + 2] != _LINE:
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[end + 2 : at])
        at += 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response, framed or not."""
    head, _, body = block.partition(_LINE * 2)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    seed = hashlib.sha1(f"{page_id}\0{url}\0{digest}".encode()).hexdigest()
    return f"<urn:uuid:{uuid.UUID(seed[:32])}>"


def _record(headers: dict[str, object], block: bytes) -> bytes:
    """All but the two line ends that close a record."""
    fields = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n%sContent-Length: %d\r\n\r\n%s" % (fields.encode(), len(block), block)


def _page_records(page_id, url, html, digest, first_id, first_url, segment_bytes: int) -> Iterator[bytes]:
    payload = html.encode()
    target = None if url is None else urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    own = _record_id(page_id, url, digest)
    shared = {
        "WARC-Record-ID": own,
        "WARC-Date": _DATE,
        "WARC-Target-URI": target,
        "X-Page-Id": page_id,
        "WARC-Payload-Digest": f"sha1:{base32}",
        "Content-Type": "application/http; msgtype=response",
    }
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first_id is not None:
        refers = {
            "WARC-Profile": _PROFILE,
            "WARC-Refers-To": _record_id(first_id, first_url, digest),
            "X-Refers-To-Page-Id": first_id,
        }
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _record({"WARC-Type": "revisit"} | shared | refers, block)
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    number = {"WARC-Segment-Number": 1} if len(pieces) > 1 else {}
    yield _record({"WARC-Type": "response"} | shared | number, pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": _record_id(k, own, digest),
            "WARC-Date": _DATE,
            "WARC-Segment-Origin-ID": own,
            "WARC-Segment-Number": k,
            "WARC-Segment-Total-Length": len(block) if k == len(pieces) else None,
        }
        yield _record(more, piece)


def write(
    pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write the archives of ``pages`` below ``path``."""
    html = F.coalesce("html", F.lit(""))
    own = F.xxhash64("page_id", "url")
    keyed = pages.select(
        F.col("page_id").cast("bigint"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest")
    ).withColumns({"shared": F.octet_length("html") >= revisit_bytes, "salt": F.pmod(own, F.lit(_SALTS))})
    firsts = (
        keyed.where("shared")
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first.page_id").isNotNull())
        .select("digest", "first", F.explode(F.expr(f"sequence(0L, {_SALTS - 1}L)")).alias("salt"))
    )
    # A short payload is never looked up; its own hash spreads it where many pages have it.
    looked = F.when(F.col("shared"), F.col("digest")).otherwise(F.concat(F.lit("-"), own.cast("string")))
    joined = keyed.withColumn("looked", looked).join(
        firsts.withColumnRenamed("digest", "looked"), ["looked", "salt"], "left"
    )
    later = F.coalesce(F.col("page_id") < F.col("first.page_id"), F.col("first").isNotNull())
    light = joined.select(
        "page_id", "url", "html", "digest",
        F.when(later, F.col("first.page_id")).alias("first_id"),
        F.when(later, F.col("first.url")).alias("first_url"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            records = [r for row in rows for r in _page_records(*row, segment_bytes)]
            yield pa.record_batch([pa.array(records, pa.binary())], ["record"])

    records = light.mapInArrow(build, "record binary").select(F.col("record").cast("string"))
    (
        records.write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError("a record does not start where the one before ends")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record is cut short")
        yield headers, block


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers["warc-type"]
    page_id = int(headers["x-page-id"]) if "x-page-id" in headers else None
    number = int(headers.get("warc-segment-number", 0))
    common = (kind, page_id, headers.get("warc-target-uri"))
    if kind == "continuation" or number:
        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
        total = headers.get("warc-segment-total-length")
        return (*common, None, None, None, None, origin, number, total and int(total), block)
    if kind == "revisit":
        fields = dict(line.split(b": ", 1) for line in block.split(_LINE)[1:] if line)
        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        size, refers_to = int(fields[b"Content-Length"]), int(headers["x-refers-to-page-id"])
        return (*common, refers_to, size, digest, None, None, None, None, None)
    payload = payload_of(block)
    digest = hashlib.sha1(payload).hexdigest()
    return (*common, None, len(payload), digest, payload, None, None, None, None)


def _parse_files(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.open(pa.BufferReader(content.as_buffer())) as stream:
                    for headers, block in parse(stream):
                        row = _row(headers, block)
                        rows.append(row if with_payload else (*row[:6], None, *row[7:]))
                        held += len(block)
                        if held > 1 << 24:
                            yield _batch(rows, _RECORDS)
                            rows, held = [], 0
                yield _batch(rows, _RECORDS)

    return run


def _reassemble(with_payload: bool, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, total, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != [*range(1, len(parts) + 1)] or len(block) != total:
                    rows.append(("incomplete", page_id, url, None, None, None, None))
                    continue
                payload = payload_of(block)
                digest = hashlib.sha1(payload).hexdigest()
                rows.append(("response", page_id, url, None, len(payload), digest, payload if with_payload else None))
            yield _batch(rows, schema)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """record_type, page_id, url, refers_to, payload_bytes, payload_digest and on request payload.

    A segmented record with a missing part, or of another length than announced, is ``incomplete``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = files.mapInArrow(_parse_files(with_payload), _RECORDS)
    pages = "record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    names = _kinds(pages)[0]
    whole = records.where(F.col("origin").isNull()).select(*names)
    # A page's segments are as large as the page, which is a single row of the table.
    grouped = (
        records.where(F.col("origin").isNotNull())
        .groupBy("origin")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max("url").alias("url"),
            F.max("total").alias("total"),
            F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"),
            F.count_if(F.col("number") == 1).alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("page_id", "url", "total", "parts")
    )
    out = whole.unionAll(grouped.mapInArrow(_reassemble(with_payload, pages), pages))
    return out if with_payload else out.drop("payload")
