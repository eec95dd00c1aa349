"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Archives hold one gzip member per record. The reader inflates a file incrementally, finds each record by its
Content-Length, checks its block and payload digests, and never holds more than one record and one read
buffer. Files are written by the executors through Arrow's file systems straight into the shared folder, under
a name of their own per attempt; only files that a finished task reports are read, so a lost executor leaves
at most an unread file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, cut, partitions, shared_path, slices, to_batches

#: Shorter payloads are always stored, as a revisit record would not be smaller.
LEAST_SHARED_BYTES = 100
FILE_BYTES = 128 << 20
READ_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One response or revisit record, uncompressed. A revisit carries the HTTP head and the full payload's digest and length, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return top.encode() + block + b"\r\n\r\n"


def inflate_members(read, size: int = READ_BYTES) -> Iterator[bytes]:
    """Inflated pieces of a file of gzip members; an empty piece ends each member."""
    z, rest = zlib.decompressobj(31), b""
    inside = False
    while True:
        raw = rest or read(size)
        if not raw:
            if inside:
                raise WarcError("the file ends inside a gzip member")
            return
        inside = True
        piece = z.decompress(raw, size)
        rest = z.unconsumed_tail
        if piece:
            yield piece
        if z.eof:
            rest, z, inside = z.unused_data, zlib.decompressobj(31), False
            yield b""


def parse_record(raw: bytearray) -> tuple[Record, int] | None:
    """The first whole record in ``raw`` and the bytes it takes, or None if more are needed."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = bytes(raw[:end]).decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        raise WarcError("a record without a Content-Length") from None
    start, total = end + 4, end + 4 + length + 4
    if len(raw) < total:
        return None
    if raw[start + length : total] != b"\r\n\r\n":
        raise WarcError("a record longer than its Content-Length")
    return Record(headers, bytes(raw[start : start + length])), total


def read_records(read) -> Iterator[Record]:
    """The records of one archive, in order. Each must be one gzip member."""
    held = bytearray()
    for piece in inflate_members(read):
        held += piece
        if piece:
            continue
        found = parse_record(held)
        if found is None:
            raise WarcError("a gzip member without a whole record")
        record, total = found
        if total != len(held):
            raise WarcError("a gzip member with more than one record")
        held.clear()
        yield record


def payload_of(record: Record) -> tuple[bytes, int]:
    """(the payload stored here, the full payload's length by its HTTP head), after checking the digests."""
    if f"sha256:{hashlib.sha256(record.block).hexdigest()}" != record.headers.get("warc-block-digest"):
        raise WarcError(f"block digest of {record.headers.get('warc-record-id')} differs")
    head, _, payload = record.block.partition(b"\r\n\r\n")
    stated = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if k.lower() == b"content-length"), 0)
    if record.headers["warc-type"] == "response":
        if len(payload) != stated or f"sha256:{hashlib.sha256(payload).hexdigest()}" != record.headers.get("warc-payload-digest"):
            raise WarcError(f"payload digest of {record.headers.get('warc-record-id')} differs")
    return payload, stated


def page_of(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def plan_records(pages: DataFrame, least_bytes: int = LEAST_SHARED_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest page_id with the same payload, null for responses.

    Payloads meet by digest alone: groups are aggregated before the shuffle, and only ids and digests take part until the
    last join, which brings the verdict of the revisits to their pages.
    """
    hashed = pages.select(F.col("page_id").cast("long"), "url", as_bytes("html").alias("html")).withColumn("digest", F.sha2("html", 256))
    groups = hashed.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ids = hashed.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest").join(groups, "digest").filter("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return hashed.join(ids, ["page_id", "digest"], "left")


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the planned records into ``folder``; returns (path, n_records), the finished files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, count, written = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for rows in slices(batches):
            for page_id, url, html, digest, refers_to in rows:
                if out is None:
                    name, count, written = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip_member(record_bytes(page_id, url, html, digest, refers_to, refers_to is not None))
                out.write(member)
                count, written = count + 1, written + len(member)
                if written >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count))
        if done:
            yield from to_batches(done, [("path", pa.string()), ("n_records", pa.int64())])

    return records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, n_records long")


READ_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives named in ``files`` (path, n_records); fails if a digest or a record count differs."""
    fields = READ_FIELDS + ([("payload", pa.binary())] if with_payload else [])

    def rows_of(path: str, expected: int) -> Iterator[tuple]:
        store, at = pafs.FileSystem.from_uri(path)
        n = 0
        with store.open_input_stream(at, compression=None) as f:
            for record in read_records(f.read):
                payload, length = payload_of(record)
                h, n = record.headers, n + 1
                yield (page_of(h["warc-record-id"]), h["warc-target-uri"], length, h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], page_of(h.get("warc-refers-to")), *([payload] if with_payload else []))
        if n != expected:
            raise WarcError(f"{path} has {n} records, not {expected}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files_here in slices(batches):
            for path, expected in files_here:
                held = []
                for row in rows_of(path, expected):
                    held.append(row)
                    if len(held) >= 500:
                        yield from to_batches(held, fields)
                        held = []
                if held:
                    yield from to_batches(held, fields)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    # a file is the unit of reading; dealing by path gives each task its own
    return files.select("path", "n_records").repartition(partitions(files.sparkSession), "path").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_SHARED_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and return the table of finished files.

    Null html is an empty payload, null url an empty target. Of rows with equal payloads of ``least_bytes`` or more the smallest
    page_id is the response; rows that repeat that page_id are responses too. A null page_id is written as a response.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    return cut(write_archives(plan_records(pages, least_bytes), folder), "warc-files")
