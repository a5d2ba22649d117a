"""WARC archives: written as text records by Spark's own writer, read back and joined into captures.

A page becomes three records: the response (or revisit), the request and the metadata; the last two name the first in
WARC-Concurrent-To. Each record is a gzip member of its own, so a file can be read from any record on, and files end
after a number of bytes. Spark's own writer writes the members as they are, so the files go through its commit protocol
to any store: its line separator is a zero byte, the last byte of every member (of its length, or of an empty member that
is added where the length ends in another).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import DEFLATED, compressobj, decompressobj

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import ship

CRLF = "\r\n"
RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, page_id long, "
    "payload_bytes long, payload_digest string, payload string"
)


def _lines(*parts) -> F.Column:
    """Header lines; a part that is null leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(p, F.lit(CRLF)), F.lit("")) for p in parts])


def _field(name: str, value: F.Column) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value)


def _record(block: F.Column, *headers) -> F.Column:
    return F.concat(_lines(F.lit("WARC/1.1"), *headers, _field("Content-Length", F.octet_length(block).cast("string"))), F.lit(CRLF), block)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 100, date: str = "2026-01-01T00:00:00Z", file_bytes: int = 128 << 20) -> None:
    """Write every page to archives under `path`, files of about `file_bytes` at most but for one larger record.

    Of pages with equal payloads of at least `least_revisit` bytes, that of the smallest id is a response and the
    others are revisits that name it; null ids come last. A null payload is empty; a null url leaves its header out,
    and control characters and spaces in a url are percent-encoded. Repeated rows are repeated records. The digests'
    first holders are found on (digest, id) alone, summed before the shuffle; payloads move once, to meet them.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256)).withColumn("n", F.octet_length("payload"))
    first = rows.where(F.col("n") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("held"))
    rows = rows.join(first.where("held > 1").select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    name = lambda page, kind: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.substring("digest", 1, 32), F.lit(f":{kind}>"))
    url = F.col("url")
    for k in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(k)), F.lit(f"%{k:02X}"))
    dated, uri = F.lit(f"WARC-Date: {date}"), _field("WARC-Target-URI", url)
    http = F.concat(_lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _field("Content-Length", F.col("n").cast("string"))), F.lit(CRLF))
    digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    capture = name(F.col("page_id"), "capture")
    concurrent = _field("WARC-Concurrent-To", capture)
    is_http = lambda what: F.lit(f"Content-Type: application/http; msgtype={what}")
    response = _record(F.concat(http, F.col("payload")), F.lit("WARC-Type: response"), _field("WARC-Record-ID", capture), dated, uri, digest, is_http("response"))
    again = _record(
        http, F.lit("WARC-Type: revisit"), _field("WARC-Record-ID", capture), dated, uri, digest, _field("WARC-Refers-To", name(F.col("first"), "capture")),
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), is_http("response"),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record(asked, F.lit("WARC-Type: request"), _field("WARC-Record-ID", name(F.col("page_id"), "request")), dated, uri, concurrent, is_http("request"))
    told = _lines(_field("page_id", F.col("page_id").cast("string")), _field("payload_bytes", F.col("n").cast("string")))
    metadata = _record(told, F.lit("WARC-Type: metadata"), _field("WARC-Record-ID", name(F.col("page_id"), "metadata")), dated, uri, concurrent, F.lit("Content-Type: application/warc-fields"))
    records = rows.select(F.explode(F.array(F.when(revisit, again).otherwise(response), request, metadata)).alias("value"))
    members = records.select(F.encode("value", "UTF-8").alias("value")).mapInArrow(_members(file_bytes), "volume int, value binary")
    members.select("volume", F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").partitionBy("volume").text(path)


def member(block: bytes, level: int = 5) -> bytes:
    """A gzip member of the block, without its last byte, a zero."""
    made = compressobj(level, DEFLATED, 31)
    out = made.compress(block) + made.flush()
    if out[-1]:
        made = compressobj(level, DEFLATED, 31)
        out += made.flush()
    return out[:-1]


def _members(file_bytes: int):
    """Members of a task's records, and the number of the file that each goes to."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, size = 0, 0
        for b in batches:
            volumes, made = [], []
            for record in b.column(0):
                out = member(record.as_buffer().to_pybytes() + b"\r\n\r\n")
                if size and size + len(out) > file_bytes:
                    volume, size = volume + 1, 0
                size += len(out) + 1
                volumes.append(volume)
                made.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(made, pa.binary())], names=["volume", "value"])

    return of_batches


def inflated(archive: bytes) -> Iterator[bytes]:
    """The contents of a file's gzip members, one by one; what is no gzip file is one block."""
    if archive[:2] != b"\x1f\x8b":
        yield archive
        return
    rest = memoryview(archive)
    while len(rest):
        one = decompressobj(31)
        out, left = [], rest
        while not one.eof and len(left):
            out.append(one.decompress(left[: 1 << 20]))
            left = left[1 << 20 :]
        if not one.eof:
            raise ValueError("torn member")
        yield b"".join(out)
        rest = rest[len(rest) - len(left) - len(one.unused_data) :]


_HEADER = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")
_TOLD = re.compile(rb"^payload_bytes:[ \t]*(\d+)", re.M)
_PAGE = re.compile(rb"urn:page:(-?\d+|null):")


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; raises where a record is torn."""
    for part in inflated(archive):
        at, end = 0, len(part)
        while at < end:
            if part[at : at + 2] == b"\r\n":
                at += 2
                continue
            if part[at : at + 5] != b"WARC/":
                raise ValueError(f"no record at byte {at}")
            head = part.index(b"\r\n\r\n", at) + 4
            line = part.index(b"\r\n", at) + 2
            headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(part, line, head)}
            size = int(headers["content-length"])
            if head + size > end:
                raise ValueError(f"torn record at byte {at}")
            yield headers, part[head : head + size]
            at = head + size


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under `path`; without `payload` that column is null and only digests leave.

    payload_bytes and payload_digest are of the full payload: of a response from its bytes, of a revisit from its
    headers; payload_bytes of a metadata record is what its fields say. page_id is the id in the record's name, null where the page had none.
    """
    ship(spark)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse(content.as_buffer().to_pybytes()):
                    kind, size, digest, body = h["warc-type"], None, None, None
                    if kind in ("response", "revisit"):
                        http, _, body = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, digest = len(body), sha256(body).hexdigest()
                        else:
                            fields = {k.lower(): v for k, v in _HEADER.findall(http + b"\r\n")}
                            size, digest, body = int(fields[b"content-length"]), h["warc-payload-digest"].removeprefix("sha256:"), None
                    elif kind == "metadata":
                        told = _TOLD.search(block)
                        size, body = int(told[1]) if told else None, block
                    page = _PAGE.search(h["warc-record-id"].encode())
                    page_id = int(page[1]) if page and page[1] != b"null" else None
                    shown = body.decode() if payload and body is not None else None
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), page_id, size, digest, shown))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(of_batches, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, page_id, response, request, metadata, refers_to).

    Request and metadata records join the response or revisit whose record id they name in concurrent_to. Identical
    records share their id: a capture that was written twice comes back twice. A capture without request or metadata
    has null there; records that name no known capture are left out. Per capture one record of each kind is kept (of the
    smallest id, then target, a missing one before others), found by minima that are summed before the shuffle.
    """
    kept = F.struct("record_id", "type", "target_uri", "date", "page_id", "payload_bytes", "payload_digest", "payload", "refers_to")
    capture = F.coalesce("concurrent_to", "record_id")
    main = F.col("type").isin("response", "revisit")
    least = lambda which: F.min_by(F.when(which, kept), F.when(which, F.struct("record_id", "target_uri")))
    grouped = records.groupBy(capture.alias("capture_id")).agg(
        least(main).alias("response"),
        least(F.col("type") == "request").alias("request"),
        least(F.col("type") == "metadata").alias("metadata"),
        F.count_if(main).alias("copies"),
    )
    found = grouped.where("response is not null").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    refers = F.when(F.col("response.type") == "revisit", F.regexp_extract("response.refers_to", r"urn:page:(-?\d+):", 1).try_cast("long"))
    return found.select("capture_id", F.col("response.page_id").alias("page_id"), "response", "request", "metadata", refers.alias("refers_to"))
