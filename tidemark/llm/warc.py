"""Operator 6: WARC archives through a chunked record table.

Writing: a page becomes rows (record, chunk number, text), one for each WARC segment. A payload over
CHUNK bytes is cut at character borders into a response and continuation records, as WARC 1.1
provides for; each row is one whole segment of bounded size, the digest is carried from chunk to
chunk, and the last one states it with the total length. Rows are written in order by Spark's text
writer as gzip files, so an archive can lie in any store that Spark can write.

Reading: the archive's lines are streamed; a state machine follows the segments, hands out rows
(record, chunk number, chunk, digest so far) and never holds more than one line and one chunk.

Records whose payloads are equal and have at least `dedup_bytes` bytes: that with the largest page_id
is the response, the others are revisit records, which hold no payload but its digest, its length
and the response's id. Null html is an empty payload. A null page_id never is a group's response
unless the group has no other; repeated rows of a response are responses again. Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

CHUNK = 1 << 16
DEDUP_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to): payload null where the record is a revisit.

    The groups are counted before anything is joined, so a payload that fills a third of the table
    is one row there; the join can then be split by Spark where a payload is that frequent.
    """
    body = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), F.col("url"), body.alias("payload"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    first = p.where(F.col("bytes") >= dedup_bytes).groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("page_id").alias("keeper")).where("c > 1")
    joined = p.join(first, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")), F.col("keeper"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "bytes", refers.alias("refers_to"))


def cut(payload: bytes, size: int) -> Iterator[bytes]:
    """Chunks of at most size bytes that end between characters; one empty chunk for no payload."""
    view, at, n = memoryview(payload), 0, len(payload)
    while True:
        end = min(at + size, n)
        while at < end < n and (payload[end] & 0xC0) == 0x80:
            end -= 1
        yield bytes(view[at:end])
        at = end
        if at >= n:
            return


def b32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def clean(value: str | None) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def segments(page_id: int | None, url: str | None, payload: bytes | None, digest: str, total: int, refers_to: int | None, size: int) -> Iterator[bytes]:
    """The WARC segments of a page without the last line feed, which the text writer adds."""
    name = "none" if page_id is None else page_id
    one = f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{name}:{{}}>\r\nWARC-Date: {DATE}\r\n"
    target = f"WARC-Target-URI: {clean(url)}\r\n"
    if payload is None:
        head = one.format(0) + f"WARC-Type: revisit\r\n{target}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{refers_to}:0>\r\nWARC-Payload-Digest: sha1:{b32(digest)}\r\nWARC-Segment-Total-Length: {total}\r\nContent-Length: 0\r\n\r\n"
        yield head.encode() + b"\r\n\r"
        return
    running, sent = hashlib.sha1(), 0
    for number, chunk in enumerate(cut(payload, size)):
        running.update(chunk)
        sent += len(chunk)
        last = sent == len(payload)
        head = one.format(number) + (f"WARC-Type: response\r\n{target}Content-Type: text/html\r\n" if not number else f"WARC-Type: continuation\r\nWARC-Segment-Origin-ID: <urn:page:{name}:0>\r\n")
        if number or not last:
            head += f"WARC-Segment-Number: {number + 1}\r\n"
        if last:
            head += f"WARC-Payload-Digest: sha1:{b32(running.hexdigest())}\r\nWARC-Segment-Total-Length: {sent}\r\n"
        yield (head + f"Content-Length: {len(chunk)}\r\n\r\n").encode() + chunk + b"\r\n\r"


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK) -> str:
    """Write planned records as gzip archives under path, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):  # one payload at a time leaves Arrow
                for s in segments(*(c[i].as_py() for c in batch.columns), chunk):
                    rows.append(s)
                    held += len(s)
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).view(pa.string())], ["value"])
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).view(pa.string())], ["value"])

    r = records.select("page_id", "url", F.col("payload").cast("binary"), "digest", "bytes", "refers_to")
    r.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return path


class Reader:
    """Follows the lines of one archive; feed() returns what a line completes."""

    def __init__(self, keep: bool):
        self.keep, self.state, self.head, self.left = keep, "between", {}, 0
        self.sha, self.sent, self.number, self.record = hashlib.sha1(), 0, 0, None
        self.parts: list[bytes] = []

    def feed(self, line: bytes) -> tuple | None:
        if self.state == "body":
            n = len(line)
            if n < self.left:
                self.take(line + b"\n")
                return None
            self.take(line[: self.left])
            if line[n - 1 :] != b"\r":
                raise ValueError("a record's block doesn't end with CRLF")
            self.state = "end"
            return self.row()
        if self.state == "head":
            if line != b"\r":
                name, _, value = line.rstrip(b"\r").partition(b": ")
                self.head[name.lower()] = value.decode()
                return None
            self.begin()
            return None
        if line.startswith(b"WARC/1.1"):
            self.state, self.head = "head", {}
        elif line != b"\r":
            raise ValueError("no WARC version line where a record should start")
        return None

    def take(self, data: bytes) -> None:
        self.sha.update(data)
        self.sent += len(data)
        self.left -= len(data)
        if self.keep:
            self.parts.append(data)

    def begin(self) -> None:
        self.left, self.parts, self.state = int(self.head[b"content-length"]), [], "body"
        if self.head[b"warc-type"] != "continuation":
            self.sha, self.sent, self.number = hashlib.sha1(), 0, 0
            self.record, self.kind = self.head[b"warc-record-id"], self.head[b"warc-type"]
        else:
            self.number += 1
            if self.head[b"warc-segment-origin-id"] != self.record or int(self.head[b"warc-segment-number"]) != self.number + 1:
                raise ValueError("a continuation without its record")

    def row(self) -> tuple:
        key = lambda x: None if (k := x.split(":")[2]) == "none" else int(k)
        last = b"warc-payload-digest" in self.head
        digest, sent, refers = self.sha.hexdigest(), self.sent, None
        if last:
            stated = base64.b32decode(self.head[b"warc-payload-digest"][5:]).hex()
            total = int(self.head[b"warc-segment-total-length"])
            if self.kind == "revisit":
                digest, sent, refers = stated, total, key(self.head[b"warc-refers-to"])
            elif (digest, sent) != (stated, total):
                raise ValueError(f"{self.record}: the payload doesn't have the stated digest")
        return key(self.record), self.number, b"".join(self.parts) if self.keep else None, sent, digest, last, self.kind, refers


CHUNKS = "page_id long, chunk_number int, chunk binary, bytes_so_far long, digest_so_far string, last boolean, record_type string, refers_to long"


def read_chunks(spark, path: str, keep: bool = True) -> DataFrame:
    """The chunked record table of archives; keep=False leaves the chunks' bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(keep)
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            rows = [r for line in batch.column(0).to_pylist() if (r := reader.feed(line)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if reader.state not in ("between", "end"):
            raise ValueError("an archive ends inside a record")

    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary")).mapInArrow(run, CHUNKS)


def archive_and_read(pages: DataFrame, *, chunk: int = CHUNK, dedup_bytes: int = DEDUP_BYTES, path: str | None = None) -> DataFrame:
    """Write all pages, read the archives back: one row for each record."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/tidemark/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(pages, dedup_bytes), path, chunk)
    found = read_chunks(spark, path, keep=False).where("last")
    return found.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
