"""Operator 2, WARC: archives with one gzip member a record, written and read back one record at a time.

Writing: pages with equal payloads find each other by digest (an aggregation and a join; a hot
payload's rows stay spread). Tasks make the gzip members and gather them to archives of bounded
size, and Spark's text writer puts each archive in a file of its own, byte for byte. It ends each
with one zero byte, which gzip readers skip as padding.

Reading: a file is inflated piece by piece. A record's header is read up to its blank line, its block
by its content length, and its digest is compared with the payload's; a mismatch stops the job.

Null payloads are empty. Pages with a null id are written too; they are never what a revisit refers to.
Rows of one page_id with equal payloads are all responses when theirs is the largest id. Control
characters in a url are percent-encoded, a null url is empty. Other columns of pages are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltgrain.llm.common import new_path, table, text_bytes

#: Payloads from so many bytes on are stored once.
MIN_SHARED = 1000
ARCHIVE_BYTES = 16 << 20
#: Bytes of a file that go to the inflater at once.
PIECE = 1 << 16
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: The profile URI that the WARC standard fixes for such revisits.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_kinds(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_shared: int) -> DataFrame:
    """page_id, url, payload, digest, and the page that each revisit refers to (null: a response)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_bytes(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.filter(F.octet_length("payload") >= min_shared).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    old = (F.octet_length("payload") >= min_shared) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when(old, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    target = "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def _archives(limit: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(record(*(x.as_py() for x in row)))
                size += len(held[-1])
                if size >= limit:
                    yield pa.RecordBatch.from_pydict({"content": [b"".join(held)]}, pa.schema([("content", pa.binary())]))
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"content": [b"".join(held)]}, pa.schema([("content", pa.binary())]))

    return batches


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_shared: int = MIN_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One WARC record a row, in files below path."""
    rows = with_kinds(pages, id_col, url_col, payload_col, min_shared)
    archives = rows.mapInArrow(_archives(archive_bytes), "content binary").select(F.col("content").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


class Stream:
    """Sequential reader over gzip members: inflates as much as the caller asks for."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.buffer = memoryview(raw), 0, bytearray()
        self.member = None

    def fill(self) -> bool:
        """Inflate one more piece; false at the end."""
        if self.member is None or self.member.eof:
            while self.at < len(self.raw) and not self.raw[self.at]:
                self.at += 1  # padding
            if self.at >= len(self.raw):
                return False
            self.member = zlib.decompressobj(31)
        piece = self.raw[self.at : self.at + PIECE]
        if not piece:
            raise ValueError("an archive ends within a record")
        self.buffer += self.member.decompress(piece)
        self.at += len(piece) - len(self.member.unused_data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is dropped; None at a clean end."""
        seen = 0
        while (i := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("an archive ends within a header")
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill():
                raise ValueError("an archive ends within a block")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def records(raw: bytes) -> Iterator[tuple]:
    """The records of one archive, as RECORD has them; a revisit's payload is null."""
    stream = Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        f = fields(head)
        block = stream.take(int(f["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a block is not as long as its header says")
        http, _, payload = block.partition(b"\r\n\r\n")
        size, kind = int(fields(http)["content-length"]), f["warc-type"]
        digest = f["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{f['warc-record-id']}: the payload does not have its digest")
        yield _number(f["warc-record-id"]), f["warc-target-uri"], kind, size, digest, _number(f.get("warc-refers-to")), payload if kind == "response" else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record below path, as RECORD has them."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for raw in batch["content"]:
                rows, size = [], 0
                for row in records(raw.as_py()):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size >= 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(batches, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_SHARED} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_SHARED} AND page_id < top THEN top END AS refers_to
FROM m
"""
