"""WARC archives: write pages as records, read archives back, put segmented records together.

Writing. Pages of equal payload share one response record, that of the smallest page_id; the
others become revisit records that refer to it. A payload travels as an HTTP response in chunked
transfer framing. A block longer than ``SEGMENT_BYTES`` is cut into a first record and
continuation records, which carry the origin's record id, their number and, in the last, the total
length. Archives are gzip files of records, written by Spark, each by one task and of bounded size
(``RECORDS_PER_FILE`` records of at most ``SEGMENT_BYTES``).

Reading. Every archive is parsed by the lengths its headers state. A whole record is decoded where
it is found; segments are grouped by origin identifier (one page's pieces at most), ordered by
segment number, verified against the stated total length, joined and then decoded. The chunked
framing is undone and the digest recomputed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.llm.common import bound_batches, stage_path, stored

#: Longest block of one record, longest chunk of the transfer framing, records of one archive.
SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 65_536, 8_192, 2_000

_END = "\r\n\r\n"
_URN = "urn:page:"
_DATE = "2000-01-01T00:00:00Z"  # fixed, so that a repeated task writes the same bytes


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, most: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; chunks end at borders of UTF-8 characters."""
    out, at = [], 0
    while at < len(payload):
        end = _border(payload, at, most)
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def _border(data: bytes, start: int, most: int) -> int:
    """End of a piece of up to ``most`` bytes that does not cut a UTF-8 character."""
    end = min(len(data), start + most)
    while end < len(data) and end > start + 1 and data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def _record(headers: list[tuple[str, str]], block: bytes) -> str:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + _END + block.decode("utf-8")


def _clean(value: str | None) -> str:
    """A header's value: line ends and control characters are percent-encoded, without loss of others."""
    return "".join(c if ord(c) >= 32 and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def page_records(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, unique: str) -> Iterator[str]:
    """The records of one page, in order."""
    name = f"<{_URN}{'' if page_id is None else page_id}:{unique}>"
    common = [
        ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    start = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first_id is not None and first_id != page_id:
        yield _record([
            ("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Refers-To", f"<{_URN}{first_id}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common], start)
        return
    block, at, number = start + chunked(payload), 0, 1
    while True:
        end = _border(block, at, SEGMENT_BYTES)
        whole, last = at == 0 and end == len(block), end == len(block)
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common] if number == 1 else [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{number}>"), ("WARC-Segment-Origin-ID", name),
            ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url))]
        if not whole:
            headers.append(("WARC-Segment-Number", str(number)))
            if last:
                headers.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(headers, block[at:end])
        if last:
            return
        at, number = end, number + 1


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        for k in range(batch.num_rows):
            page_id, url, html, first_id = (batch.column(c)[k].as_py() for c in range(4))
            row += 1
            payload = (html or "").encode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(list(page_records(page_id, url, payload, first_id, f"{part}-{row}")))], ["record"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record a page into gzip archives below ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes only the smallest page_id's is
    written; shorter payloads are always written.
    """
    bound_batches(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit(""))
    based = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    # only payloads that occur again are joined
    again = (
        based.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    met = based.join(stored(again, "op4-repeated"), "digest", "left").select("page_id", "url", "html", "first_id")
    records = met.mapInArrow(_written, "record string")
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers by lower-case name, block)`` of every record, by stated lengths."""
    while True:
        line = archive.readline()
        while line in (b"\r\n", b"\n"):
            line = archive.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := archive.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = archive.read(length)
        if len(block) != length:
            raise ValueError("an archive ends within a record")
        yield headers, block


def payload_of(block: bytes) -> bytes:
    """What an HTTP response block carries."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(
        line.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:])
    return unchunked(body) if framed else body


_RECORD = pa.schema([
    ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("url", pa.string()),
    ("refers_to", pa.string()), ("digest", pa.string()), ("stated_bytes", pa.int64()), ("block", pa.binary()),
])
RECORD_SCHEMA = "origin string, number int, total long, type string, url string, refers_to string, digest string, stated_bytes long, block binary"


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            raw = content.as_buffer()
            reader = pa.BufferReader(raw)
            archive = io.BufferedReader(gzip.GzipFile(fileobj=reader) if raw.size > 1 and raw[:2].to_pybytes() == b"\x1f\x8b" else reader, 1 << 16)
            rows, held = [], 0
            for h, block in parse(archive):
                rows.append((
                    h.get("warc-segment-origin-id", h.get("warc-record-id")), _number(h.get("warc-segment-number")), _number(h.get("warc-segment-total-length")),
                    h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), _number(h.get("x-payload-length")), block))
                held += len(block)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``: a row a record or segment.

    One archive is one row of bytes for a task, so archives should be of bounded size, like those
    of ``write_archives``. No files give no rows.
    """
    bound_batches(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_parsed, RECORD_SCHEMA)


def _joined(total: int | None, parts: list) -> bytes | None:
    """Segments by number as one block; None where one is missing or the length is wrong."""
    parts = sorted(parts, key=lambda p: p["number"])
    block = b"".join(p["block"] for p in parts)
    whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1))
    return block if whole and total == len(block) else None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            block = r["block"] if r["parts"] is None else _joined(r["total"], r["parts"])
            payload, problem = None, None
            if block is None:
                problem = "segments do not add up to the stated length"
            elif r["type"] == "response":
                try:
                    payload = payload_of(block)
                except ValueError as e:
                    problem = f"broken framing: {e}"
                if payload is not None and r["digest"] != "sha1:" + base32_sha1(payload):
                    problem = "the payload's digest is not the stated one"
            rows.append((r["origin"], r["type"], r["url"], r["refers_to"], r["digest"], r["stated_bytes"] if payload is None else len(payload), payload, problem))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGE)] if rows else [pa.array([], f.type) for f in _PAGE], schema=_PAGE)


_PAGE = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string()),
])
PAGE_SCHEMA = "record_id string, type string, url string, refers_to string, digest string, payload_bytes long, payload binary, problem string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, type, url, refers_to, digest, payload_bytes, payload, problem``: a row for each
    response and revisit of the archives below ``path``, segments put together.

    A record whose segments are incomplete, whose framing is broken or whose digest differs keeps
    its row and says so in ``problem``. A revisit has no payload of its own and states the
    length of the full one. Other record types are passed over.
    """
    records = read_records(spark, path)
    none = "array<struct<number:int,block:binary>>"
    whole = records.filter("number IS NULL AND type IN ('response', 'revisit')").withColumn("parts", F.lit(None).cast(none))
    # at most the pieces of one page share an origin
    pieces = records.filter("number IS NOT NULL").groupBy("origin").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "url", "refers_to", "digest", "stated_bytes")],
        F.collect_list(F.struct("number", "block")).alias("parts"))
    columns = ["origin", "total", "type", "url", "refers_to", "digest", "stated_bytes", "block", "parts"]
    both = whole.select(*columns).unionByName(pieces.withColumn("block", F.lit(None).cast("binary")).select(*columns))
    return both.mapInArrow(_decoded, PAGE_SCHEMA)


def page_of(record_id):
    """The page_id in a record id of ``write_archives``; null for a page without one."""
    digits = F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]*)", 1)
    return F.when(digits != "", digits).cast("long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives into the shared folder, read them back and report each page:
    page_id, payload_bytes, payload_digest, record_type, refers_to, problem.

    A null html is an empty payload. A page without page_id is written and read back with a null
    id; it is never what others refer to if one of equal payload has an id. Rows of one page_id
    and payload are all responses. Other columns of the input are not used. No pages, no rows.
    """
    spark = pages.sparkSession
    path = stage_path(spark, "op4-archives")
    write_archives(pages, path, least_bytes)
    return read_payloads(spark, path).select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"), "problem")
