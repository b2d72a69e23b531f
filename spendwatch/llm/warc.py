"""WARC archives of pages: a distributed writer and a splittable reader.

Writer: one gzip member per record.  The records go through Spark's own text
writer, so its commit protocol and file systems apply: a row is a member
without its last byte and the line separator is that byte.  The last byte of a
member is the top byte of its length and 0 below 16 MiB; a longer record is
followed by an empty member, whose last byte is 0 again.  Of pages with equal
payloads, that with the smallest page_id is a response and the others are
revisits that refer to it.

Reader: the files are cut into byte ranges, one task row each.  A task searches
its range for the gzip magic, tries each candidate by decoding the start of its
content, and owns the records whose first byte lies inside; it reads on past
the end of its range for the last one.  A record is accepted when its WARC
header parses and its block has the stated length.  Ranges are read through
``pyarrow.fs``, which opens local, HDFS and object store paths.

Defined cases: a null html is an empty payload; a null url gives a record
without target; a null page_id gives a record without id, which comes back as
null; line breaks in a url are percent-encoded; repeated rows are separate
records, responses if they have the smallest page_id of their payload; an empty
table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch_path
from .common import materialize, small_side

RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 18
MAX_TASKS = 50_000         # beyond it a task reads several ranges
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _urn(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One uncompressed WARC record; ``refers_to`` not None makes it a revisit."""
    http = _HTTP % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {_urn(page_id)}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member whose last byte is 0."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    if out[-1]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out


def _member_rows(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            out = []
            for page_id, url, html, refers_to in zip(*[c.slice(lo, 500).to_pylist() for c in b.columns]):
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.append(member(record(page_id, url, payload, digest, refers_to))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["m"])


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``refers_to`` (null for responses).

    Payloads are compared by SHA-1.  Only digests that occur more than once
    join back to the pages, and they are one row each, so a payload that very
    many pages share is a split side of the join, never one task.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = p.withColumn("__d", F.when(F.octet_length(html) >= min_bytes, F.sha1(html)))
    first = materialize(p.where("__d is not null").groupBy("__d").agg(F.min("page_id").alias("__first"), F.count("*").alias("n"))
                        .where("n > 1").select(F.col("__d").alias("__k"), "__first"), "warc_first")
    out = p.join(small_side(first), F.col("__d") == F.col("__k"), "left")
    return out.select("page_id", "url", "html", F.when(
        F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first")),
        F.col("__first").cast("string")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes the pages as WARC files under ``path``."""
    rows = with_roles(pages, min_bytes).withColumn("page_id", F.col("page_id").cast("string"))
    rows = rows.mapInArrow(_member_rows, "m binary").select(F.col("m").cast("string").alias("value"))
    rows.write.option("lineSep", "\x00").text(path)


class _Range:
    """Bytes of one file from a position on, read as they are needed."""

    def __init__(self, path: str, start: int):
        from pyarrow import fs
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.start, self.data, self.done = start, bytearray(), False
        self.file.seek(start)

    def more(self) -> bool:
        got = b"" if self.done else self.file.read(READ_BYTES)
        self.done = not got
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[:to - self.start]
        self.start = to


def _decode(r: _Range, at: int) -> tuple[bytes, int] | None:
    """(content, position after it) of the gzip member at ``at`` if it holds a WARC record."""
    z, out, pos, checked = zlib.decompressobj(31), [], at, False
    try:
        while not z.eof:
            if pos - r.start >= len(r.data) and not r.more():
                return None
            part = r.data[pos - r.start:pos - r.start + (READ_BYTES if checked else 512)]
            out.append(z.decompress(part))
            pos += len(part)
            if not checked and sum(map(len, out)) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    return (b"".join(out), pos - len(z.unused_data)) if checked else None


def read_record(content: bytes) -> dict | None:
    """Headers and block of one record, None if it is not whole."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    n = fields.get("content-length", "")
    if not gap or not n.isdigit() or rest[int(n):] != b"\r\n\r\n" or "warc-type" not in fields:
        return None
    return {**fields, "block": rest[:int(n)]}


def _page(urn: str | None) -> str | None:
    return urn[len("<urn:x-page:"):-1] if urn and urn.startswith("<urn:x-page:") else None


def read_range(path: str, start: int, end: int):
    """(position, record) of every record that begins in [start, end)."""
    r = _Range(path, start)
    at = start
    while True:
        while (k := r.data.find(MAGIC, at - r.start)) < 0:
            at = max(at, r.start + len(r.data) - len(MAGIC) + 1)
            if at >= end or not r.more():
                return
        at = r.start + k
        if at >= end:
            return
        r.drop(at)
        found = _decode(r, at)
        rec = read_record(found[0]) if found else None
        if rec:
            yield at, rec
            at = found[1]
        else:
            at += 1


_FIELDS = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, position long"


def _record_rows(batches):
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64()]
    for b in batches:
        for path, start, end in zip(*[c.to_pylist() for c in b.columns]):
            rows, size = [], 0
            for at, rec in read_range(path, start, end):
                http, _, payload = rec["block"].partition(b"\r\n\r\n")
                if rec["warc-type"] == "response":
                    digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                else:                    # a revisit states its payload, it does not carry it
                    digest = rec.get("warc-payload-digest", "").removeprefix("sha1:")
                    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    payload = None
                rows.append((_page(rec.get("warc-record-id")), rec.get("warc-target-uri"), rec["warc-type"],
                             _page(rec.get("warc-refers-to")), digest, n, payload, path, at))
                size += n
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all WARC files under ``path``, read by byte ranges."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("start"),
                          "length")
    ranges = materialize(ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end")), "warc_ranges")
    # a number of tasks is stated: the few bytes of this table would be coalesced into one
    n = max(1, min(ranges.count(), MAX_TASKS))
    return ranges.repartition(n).mapInArrow(_record_rows, _FIELDS)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes the pages to archives on the shared checkpoint storage and returns the records read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    kind = pages.schema["page_id"].dataType
    out = read_archives(spark, path, range_bytes)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
