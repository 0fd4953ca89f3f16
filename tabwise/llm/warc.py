"""WARC archives with revisit resolution.

Digests and ids alone are aggregated: of the records with equal payloads the one with the smallest ``page_id``
is the original response, the others become revisit records that refer to it and carry no payload. Archives are written
with fresh headers, one gzip member per record, and read back record by record.

Defined results. A null html is an empty payload; empty payloads are equal to each other. With ``min_bytes`` set,
payloads below it are never shared: all are responses. Rows that repeat the smallest id of their payload are all
responses. A null ``page_id`` sorts last: such a row is a response only if its payload has no row with an id, and a
revisit otherwise; it is written without an identifier. A null url gives a record without a target. Control characters
in a url are percent-encoded. An empty table gives no archive and no rows. Other columns are ignored.

Scale. Digests are built-in functions; only (digest, page_id) is aggregated, map-side first, so a payload shared by a
third of all pages costs one row per task. Pages join the digests that occur more than once; those are the few rows of
the other side, which Spark broadcasts if its own size check allows; else the join shuffles pages with their payloads once,
with Spark's skew splitting. Archives are read back by one task each. Archives
roll over at ``ARCHIVE_BYTES``; a task streams its records and holds one at a time. Files appear by an atomic move, so a
lost executor's rerun leaves the same archives.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import atomic_output, cut, new_folder, open_filesystem

ARCHIVE_BYTES = 256_000_000
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: four characters for every five hexadecimal digits."""
    hexed = F.sha1(payload)
    parts = []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload, digest and size of every page; the payload is UTF-8."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("long")})


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The headers with ``original``: the page a revisit refers to, null for responses."""
    rows = headers(pages).withColumn("sharing", F.col("size") >= min_bytes)
    shared = rows.where("sharing").groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = cut(shared.select("digest", "first"))
    joined = rows.join(firsts, "digest", "left")
    revisits = F.col("sharing") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", "size",
                         F.when(revisits, F.col("first")).alias("original"))


def record(page_id, url, payload: bytes, digest: str, size: int, original) -> bytes:
    """One WARC record. A revisit keeps digest and size of the payload it leaves out."""
    revisit = original is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block += b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <{ID}{page_id}>")
    lines.append(f"WARC-Date: {DATE}")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines.append(f"WARC-Refers-To: <{ID}{original}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the resolved rows below ``folder``; returns (path, records) of the archives, already written."""
    def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        records = (r for batch in batches for r in zip(*[batch.column(k) for k in range(6)]))
        waiting = next(records, None)
        while waiting is not None:
            name, written, count = f"pages-{task:06d}-{number:05d}.warc.gz", 0, 0
            with atomic_output(folder, name) as out:
                while waiting is not None and written < archive_bytes:
                    raw = record(*[x.as_py() for x in waiting])
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(packer.compress(raw) + packer.flush())
                    written, count = written + len(raw), count + 1
                    waiting = next(records, None)
            number += 1
            yield pa.record_batch([pa.array([name]), pa.array([count], pa.int64())], ["path", "records"])

    wanted = rows.select("page_id", "url", "payload", "digest", "size", "original")
    return cut(wanted.mapInArrow(dump, "path string, records long"))


def members(stream) -> Iterator[io.BufferedIOBase]:
    """The decompressed bytes of an archive as one buffered stream, across its gzip members."""
    import gzip

    return io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        found = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            found[name.decode().lower()] = value.strip().decode()
        length = int(found["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield found, block


def read(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """page_id, url, size, digest, type, original and payload of every record in the archives."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{name}", compression=None) as raw:
                    rows, held = [], 0
                    for found, block in parse(members(raw)):
                        rows.append(_row(found, block))
                        held += len(block)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=READ)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=READ)

    # A number that is asked for is kept, while small partitions without one would be merged into a single task.
    files = archives.select("path").repartition(max(1, archives.count()), F.col("path"))
    return files.mapInArrow(load, "page_id string, url string, size long, digest string, type string, "
                                  "original string, payload binary")


READ = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("size", pa.int64()), ("digest", pa.string()),
                  ("type", pa.string()), ("original", pa.string()), ("payload", pa.binary())])


def _row(found: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    plain = lambda key: found[key][1 + len(ID):-1] if key in found else None
    return {"page_id": plain("warc-record-id"), "url": found.get("warc-target-uri"), "size": size,
            "digest": found["warc-payload-digest"].removeprefix("sha1:"), "type": found["warc-type"],
            "original": plain("warc-refers-to"), "payload": payload}


def report(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and tell per page what its record is."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    kind = pages.schema["page_id"].dataType
    records = read(spark, folder, write(resolve(pages), folder))
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("original").cast(kind).alias("refers_to"))
