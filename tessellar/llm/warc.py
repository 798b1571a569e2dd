"""WARC archives: written by Spark's text writer, read back by boundary chains.

Writing: one response record for each payload, revisit records for later equal ones. The html goes through a shuffle
only where the map of revisits is too large to broadcast. Files are bounded by records and by bytes: records of one size
class share files, of so many records that the largest of the class fit.

Reading: anything that looks like the start of a record may lie inside a payload. Tasks emit every candidate with the
offset of its successor, and the end of each file; pointer jumping from offset 0 of each file then doubles the reach in
each round, and what is not reached is no record. A file whose end is not reached is an error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import cut, shared_dir, small_batches

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 4096
FILE_BYTES = 128 << 20
#: Records of a file in each size class, a class taking records of at most a file's bytes by that number; and bytes that a record has besides url and html, at most.
CLASSES = (4096, 512, 64, 8, 1)
RECORD_BYTES = 1024
BROADCAST_ROWS = 200_000
CRLF = "\r\n"

CANDIDATES = "file string, offset long, successor long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(digest, first): payloads of at least so many bytes that several page ids have, with the smallest id."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.where(F.octet_length(payload) >= least).select(F.sha2(payload, 256).alias("digest"), F.col(f"`{page_id}`").cast("long").alias("id"))
    return rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """One record per row, in files of at most ``records_per_file`` records and ``file_bytes`` bytes; a record larger than that has a file of its own.

    Of rows with equal payloads of at least 100 bytes the smallest page_id is the response (all rows of that id, if it
    repeats); the others are revisits without a block. A null html is an empty payload, a null page_id is written as ``-``
    and is never referred to, a null url is empty, line breaks in a url become spaces. No rows: no records.
    """
    first = cut(revisits(pages, page_id, html))
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), "[\r\n]", " ").alias("uri"), text.alias("payload"))
    size = F.octet_length("uri").cast("long") + F.octet_length(F.col("payload").cast("binary")) + RECORD_BYTES
    fits = F.coalesce(*[F.when(size * n <= file_bytes, n) for n in CLASSES], F.lit(CLASSES[-1]))
    held = sorted((r["fits"] for r in rows.select(fits.alias("fits")).distinct().collect()), reverse=True) or CLASSES[:1]
    for k, n in enumerate(held):
        some = _records(rows.where(fits == n), first)
        some.write.mode("append" if k else "errorifexists").option("lineSep", CRLF * 2).option("maxRecordsPerFile", min(records_per_file, n)).text(path)


def _records(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(value): the record of every row (id, uri, payload), without the blank line at its end."""
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length(F.col("payload").cast("binary")))
    rows = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    length = F.octet_length(head) + F.when(again, 0).otherwise(F.col("size"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        name(F.col("id")),
        F.lit(f"{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}WARC-Target-URI: "),
        F.col("uri"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        length.cast("string"),
        F.lit(CRLF * 2),
        head,
        F.when(again, F.lit("")).otherwise(F.col("payload")),
    )
    return rows.select(record.alias("value"))


_START = re.compile(rb"WARC/1\.[01]\r\n")
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def _fields(content: bytes, at: int, end: int) -> dict[bytes, tuple[int, bytes]]:
    """Name: (offset, value) of the lines between, the last of each name; so they hold for later starts before the same end too."""
    found, at = {}, content.find(b"\r\n", at, end)
    while at >= 0:
        stop = content.find(b"\r\n", at + 2, end)
        k, s, v = content[at + 2 : end if stop < 0 else stop].partition(b":")
        if s:
            found[k.strip().lower()] = at, v.strip()
        at = stop
    return found


def _candidate(content: bytes, end: int, fields: dict[bytes, bytes]) -> tuple | None:
    """Successor and fields of the record with this header and its end, or None if its length or end are not a record's."""
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return None
    body, successor = end + 4, end + 4 + int(size) + 4
    if content[successor - 4 : successor] != b"\r\n\r\n":
        return None
    block = content[body : successor - 4]
    kind, page, refers = fields.get(b"warc-type", b"").decode("utf-8", "replace"), _PAGE.match(fields.get(b"warc-record-id", b"")), _PAGE.match(fields.get(b"warc-refers-to", b""))
    head = block.find(b"\r\n\r\n")
    if kind == "revisit":
        stated = re.search(rb"(?i)\r\nContent-Length: *(\d+)", block[: head + 2])
        n, digest = int(stated[1]) if stated else None, fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("utf-8", "replace")
    else:
        payload = block[head + 4 :] if head >= 0 and block.startswith(b"HTTP/") else block
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return successor, int(page[1]) if page else None, kind, n, digest, int(refers[1]) if refers else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every candidate of each file, and a row without fields where the file ends; of bytes that no candidate chain could use, nothing."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("successor", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            content = raw.as_py() or b""
            name, rows, end, lines = path.rsplit("/", 1)[-1], [], -1, {}
            for m in _START.finditer(content):
                at = m.start()
                if at > end:  # the blank line and its header lines are sought once for all starts before it
                    end = content.find(b"\r\n\r\n", at)
                    if end < 0:
                        break
                    lines = _fields(content, at, end)
                if found := _candidate(content, end, {k: v for k, (line, v) in lines.items() if line > at}):
                    rows.append((name, at, *found))
            if content:
                rows.append((name, len(content), *[None] * 6))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All candidate records and the ends of the folder's files; a file is read whole by one task (files of up to 2 GB)."""
    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_scan, CANDIDATES)


def reachable(found: DataFrame) -> DataFrame:
    """(file, offset) of the chain from offset 0 of each file, by pointer jumping: round k doubles the reach to 2^k records."""
    longest = found.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    jump = cut(found.select("file", "offset", F.col("successor").alias("jump"), (F.col("offset") == 0).alias("reached")))
    span = 1
    while span < longest:
        a, b = jump.alias("a"), jump.select("file", F.col("offset").alias("jump"), F.col("jump").alias("next"), F.lit(True).alias("there"))
        moved = a.join(b, ["file", "jump"], "left")
        own = moved.select("file", "offset", F.col("next").alias("jump"), "reached")
        marks = moved.where("reached and there").select("file", F.col("jump").alias("offset"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("reached"))
        jump = cut(own.unionByName(marks).groupBy("file", "offset").agg(F.max("jump").alias("jump"), F.max("reached").alias("reached")))
        span *= 2
    return jump.where("reached").select("file", "offset")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive folder: page_id, record_type, payload_bytes, payload_digest, refers_to, file, offset.

    Payloads that hold whole records of their own are not taken apart. Length and digest of a response are those of the
    bytes read; a revisit has no block and states those of the payload that it refers to. An archive without records gives no rows.
    A file whose chain ends before the file does raises a ValueError.
    """
    found = cut(candidates(spark, path))
    chain = reachable(found)
    broken = found.where("record_type is null").join(chain, ["file", "offset"], "left_anti").select("file").first()
    if broken:
        raise ValueError(f"the records of {broken['file']} don't reach its end")
    return found.where("record_type is not null").join(chain, ["file", "offset"], "left_semi")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages to a fresh folder of the shared directory and reads them back."""
    path = f"{shared_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    write_warc(pages, path, page_id, url, html)
    return read_warc(pages.sparkSession, path)
