"""WARC archives of web pages: writing, revisit records for equal payloads, and reassembly of segmented records.

Writing: a page's payload is its html in UTF-8, sent in chunked transfer framing behind a short HTTP header. A block
above `SEGMENT_BYTES` is cut into a first record and continuation records, which name the first one as their origin;
the last of them states the total length. Of pages with equal payloads the one with the largest id is a response and the
others are revisits of it. A record is a string that ends a text file's line, where the line separator is the empty
lines that end a WARC record, so Spark's text writer makes valid archives in any file system it knows.

Reading: archives are parsed by the lengths their headers state. Continuation records are grouped by origin, ordered by
segment number, checked for gaps and against the stated total, joined, and the chunked framing is decoded. Payloads are
checked against the stated digest; a record that fails any check has `problem` set and no payload.

Defined results: NULL html is the empty payload, a NULL url is the empty url, and a NULL page id is carried as NULL.
Rows repeated with equal id and payload are written and listed one by one. Pages without any row give an archive without
files. Further columns are not stored. A file holds at most `FILE_RECORDS` records, and a record at most `SEGMENT_BYTES` of
a block behind its header, so a file of some 17 MB and a page are what a task must hold, however long pages are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lonetext.common import scratch_path, write_out
from lonetext.llm.words import column, slices, texts_of

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_RECORDS = 1_000
MIN_REVISIT_BYTES = 0
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk header without end")
        text = body[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", text):
            raise ValueError("chunk size")
        size, at = int(text, 16), end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk length")
        parts.append(body[at:at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without the empty lines at its end."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def page_urn(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def page_records(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None,
                 segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page."""
    urn = page_urn(page_id, digest)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{urn}>"), *common, ("WARC-Profile", PROFILE),
                        ("WARC-Refers-To", f"<{page_urn(refers_to, digest)}>"),
                        ("Content-Type", "application/http; msgtype=response")], head)]
    block = head + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{urn}>"), *common, kind]
    if len(block) <= segment_bytes:
        return [record(first, block)]
    parts = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    result = [record([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{urn}:{n}>"), *common[:2],
                   ("WARC-Segment-Origin-ID", f"<{urn}>"), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        result.append(record(headers, part))
    return result


def _payloads(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[str]]]:
    for part in slices(batch, "html"):
        payloads = texts_of(part, "html").cast(pa.large_binary()).to_pylist()
        yield part, payloads, [digest_of(p) for p in payloads]


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Digests of payloads that several pages have, with the page that stays a response."""
    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payloads, found in _payloads(batch):
                yield pa.RecordBatch.from_arrays(
                    [column(part, "page_id"), pa.array(found, pa.string()),
                     pa.array([len(p) for p in payloads], pa.int64())], ["page_id", "digest", "n_bytes"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(
        digests, "page_id long, digest string, n_bytes long")
    groups = narrow.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "n_bytes").agg(
        F.max("page_id").alias("keeper"), F.min("page_id").alias("least"), F.count("page_id").alias("known"),
        F.count("*").alias("n"))
    several = (F.col("least") < F.col("keeper")) | (F.col("known") < F.col("n"))
    return groups.filter(several & F.col("keeper").isNotNull()).select("digest", "keeper")


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES,
                   segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write (page_id, url, html) rows as WARC files under `path`.

    Payloads stay where they are read unless several pages share one: the table of shared digests is written first and
    joined by its size.
    """
    shared = write_out(revisits(pages, min_bytes), "warc-shared")

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, found in _payloads(batch):
                yield pa.RecordBatch.from_arrays(
                    [column(part, "page_id"), column(part, "url"), column(part, "html"), pa.array(found, pa.string())],
                    ["page_id", "url", "html", "digest"])

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payloads, found in _payloads(batch):
                result: list[bytes] = []
                for i, url, payload, digest, keeper in zip(
                        column(part, "page_id").to_pylist(), texts_of(part, "url").to_pylist(), payloads, found,
                        column(part, "keeper").to_pylist()):
                    refers = keeper if keeper is not None and keeper != i else None
                    result += page_records(i, url, payload, digest, refers, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(result, pa.binary())], ["record"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        digests, "page_id long, url string, html string, digest string")
    joined = rows.join(shared, "digest", "left").select("page_id", "url", "html", "keeper")
    written = joined.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    (written.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path))


PARSED = ("record_id string, origin string, segment int, total long, type string, about string, target string, "
          "digest string, block binary")
READ = ("record_id string, record_type string, refers string, url string, payload_digest string, "
        "payload_bytes long, payload binary, problem string")


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive as rows of PARSED. ValueError where a record does not end as its length says."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        plain = lambda k: headers[k].strip("<>") if k in headers else None  # noqa: E731, B023
        number = lambda k: int(headers[k]) if k in headers else None  # noqa: E731, B023
        segment = number("warc-segment-number")
        origin = plain("warc-segment-origin-id") or (plain("warc-record-id") if segment is not None else None)
        digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
        yield (plain("warc-record-id"), origin, segment, number("warc-segment-total-length"),
               headers.get("warc-type"), plain("warc-refers-to"), headers.get("warc-target-uri"), digest,
               data[start:stop])
        at = stop + 4


def joined_segments(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of ordered (segment, total, block) parts; ValueError if one is missing or the length is wrong."""
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments missing")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] is None:
        raise ValueError("last segment missing")
    if parts[-1][1] != len(block):
        raise ValueError("total length")
    return block


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header without end")
    if re.search(rb"^transfer-encoding:\s*chunked\s*$", head, re.I | re.M):
        return unchunked(body)
    return body


def _read_row(record_id: str, kind: str, refers: str | None, target: str, digest: str | None,
              block: bytes | list) -> tuple:
    """A row of READ; `block` is a list of ordered segments for a segmented record."""
    if kind != "response":
        return record_id, kind, refers, target, digest, None, None, None
    try:
        payload = payload_of(joined_segments(block) if isinstance(block, list) else block)
        if digest is not None and digest_of(payload) != digest:
            raise ValueError("payload digest")
    except ValueError as e:
        return record_id, kind, refers, target, digest, None, None, str(e)
    return record_id, kind, refers, target, digest or digest_of(payload), len(payload), payload, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                      schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records under `path`, reassembled, decoded and checked.

    Records in one piece are decoded where they are read; only segments are shuffled, keyed by their origin.
    Without `payloads` they are checked and left out.
    """
    payload_at = [p.split()[0] for p in READ.split(", ")].index("payload")

    def shown(row: tuple) -> tuple:
        return row if payloads else (*row[:payload_at], None, *row[payload_at + 1:])

    schema = _arrow("whole boolean, " + PARSED + ", " + READ.replace("record_id string, ", ""))
    out = _arrow(READ)
    parsed_width, read_width = len(PARSED.split(",")), len(READ.split(",")) - 1

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in parse(content.as_py()):
                    if r[2] is not None:
                        rows.append((False, *r, *[None] * read_width))
                    else:
                        full = shown(_read_row(r[0], r[4], r[5], r[6], r[7], r[8]))
                        rows.append((True, r[0], *[None] * (parsed_width - 1), *full[1:]))
                if rows:
                    yield _batch(rows, schema)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, first, times, parts in zip(*(batch.column(i) for i in range(4))):
                first, unique = first.as_py(), {}
                for p in parts.as_py():  # a segment that is there twice counts once
                    unique.setdefault(p["segment"], (p["segment"], p["total"], p["block"]))
                ordered = [unique[k] for k in sorted(unique)]
                if first is None:
                    rows.append((origin.as_py(), "response", None, None, None, None, None, "first segment missing"))
                else:
                    row = shown(_read_row(origin.as_py(), first["type"], first["about"], first["target"],
                                          first["digest"], ordered))
                    rows += [row] * times.as_py()
            if rows:
                yield _batch(rows, out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    ddl = "whole boolean, " + PARSED + ", " + READ.replace("record_id string, ", "")
    rows = write_out(files.mapInArrow(read, ddl), "warc-records", partition_by=("whole",))
    whole = rows.filter("whole").select(*[p.split()[0] for p in READ.split(", ")])
    head = F.when(F.col("segment") == 1, F.struct("type", "about", "target", "digest"))
    groups = rows.filter("NOT whole").groupBy("origin").agg(
        F.max(head).alias("first"), F.sum((F.col("segment") == 1).cast("int")).cast("int").alias("times"),
        # equal segments of a page that is stored very often are one before the shuffle
        F.collect_set(F.struct("segment", "total", "block")).alias("parts"))
    return whole.unionByName(groups.mapInArrow(decode, READ))


def catalogue(records: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits get their response's size."""
    number = lambda c: F.split(F.col(c), ":")[2].try_cast("long")
    narrow = records.select("record_id", "record_type", "refers", "payload_digest", "payload_bytes")
    narrow = write_out(narrow, "warc-catalogue")
    responses = narrow.filter("record_type = 'response'")
    sizes = responses.select(F.col("record_id").alias("refers"), F.col("payload_bytes").alias("size")).distinct()
    again = narrow.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, "refers", "left")
    every = responses.unionByName(again.withColumnRenamed("size", "payload_bytes"))
    return every.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        number("refers").alias("refers_to"))


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the pages as archives, read these back and list them."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return catalogue(read_archives(spark, path, payloads=False))
