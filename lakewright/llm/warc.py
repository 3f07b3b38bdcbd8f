"""WARC archives: one gzip member a record, written in order, read back in order.

The reader inflates member by member with an incremental decompressor, cuts records by their Content-Length,
never holds more than one record and one chunk, and verifies each payload's digest.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged

#: Bytes read and inflated at a time: what is left of a chunk behind a member is copied.
CHUNK = 1 << 16
#: Records are handed on when they hold this many bytes.
BATCH_BYTES = 16 << 20
#: An archive file is closed beyond this many bytes and the next one begun.
ARCHIVE_BYTES = 1 << 30
MIN_REVISIT_BYTES = 100
_SALTS = 16


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""
    extra: dict = field(default_factory=dict)


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    block = _http(len(payload)) + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class MemberStream:
    """Bytes of successive gzip members; take() never crosses into the next member."""

    def __init__(self, source):
        self.source, self.raw, self.out, self.inflate, self.ended = source, b"", b"", None, False

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
        if not self.raw:
            return False
        self.inflate, self.out, self.ended = zlib.decompressobj(31), b"", False
        return True

    def _more(self) -> bool:
        if self.ended:
            return False
        data = self.inflate.unconsumed_tail or self.raw or self.source.read(CHUNK)
        if not data:
            raise ValueError("an archive ends within a record")
        if not self.inflate.unconsumed_tail:
            self.raw = b""
        self.out += self.inflate.decompress(data, CHUNK)
        if self.inflate.eof:
            self.ended, self.raw = True, self.inflate.unused_data
        return True

    def line(self) -> bytes:
        while (at := self.out.find(b"\r\n")) < 0:
            if not self._more():
                raise ValueError("a record's header has no end")
        got, self.out = self.out[:at], self.out[at + 2 :]
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < n:
            self.out = b""
            if not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            parts.append(self.out)
            have += len(self.out)
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]

    def finish(self) -> bytes:
        while self._more():
            pass
        got, self.out = self.out, b""
        return got


def read_records(source) -> Iterator[Record]:
    """Records of an open binary file, in order."""
    stream = MemberStream(source)
    while stream.next_member():
        if not stream.line().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.take(int(headers["content-length"]))
        if stream.finish() != b"\r\n\r\n":
            raise ValueError("a record does not end after its Content-Length")
        yield Record(headers, block)


def parse(record: Record) -> dict:
    """page_id, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to; verifies the digest."""
    h = record.headers
    head, _, body = record.block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    revisit = h["warc-type"] == "revisit"
    if not revisit and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"payload and digest differ in {h['warc-record-id']}")
    number = lambda x: int(n) if (n := x.rstrip(">").rpartition(":")[2]) else None
    return {
        "page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload": None if revisit else body, "payload_bytes": length, "payload_digest": digest,
        "record_type": h["warc-type"], "refers_to": number(h["warc-refers-to"]) if revisit else None,
    }


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: the smallest page_id of an equal payload of MIN_REVISIT_BYTES or more, null for that page itself.

    Only digests and ids meet by digest; the smallest ids are repeated per salt, so no payload's copies meet in one task.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    slim = base.where(F.octet_length("html") >= MIN_REVISIT_BYTES).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    revisit = slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")).join(salted, ["digest", "salt"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    return base.join(revisit, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page (page_id, url, html) as a WARC record; (archive, records, bytes) of the files written.

    A null html is an empty payload; a null url has no target header; rows that repeat, page_ids included, are
    written one by one (equal rows of one smallest id are all responses). A page without an id is a response,
    has no number in its record id and is referred to by none. Other columns are ignored, an empty table writes no archive. folder: a URI that Arrow can open, on storage that all
    executors share. Each task writes under a name of its own attempt and renames at the end, so a task that
    is run again leaves no half archive in the result.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _open(folder)
        where.create_dir(top, recursive=True)
        task = TaskContext.get()
        number, out, name, records, size = 0, None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            final = f"part-{task.partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
            where.move(name, posixpath.join(top, final))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{final}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for b in batches:
            for page, digest, url, html, refers in zip(*(b.column(k).to_pylist() for k in ("page_id", "digest", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name = posixpath.join(top, f".open-{uuid.uuid4().hex}")
                    out, records, size = where.open_output_stream(name), 0, 0
                member = make_record(page, url, html.encode(), digest, refers)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, out = number + 1, None
        if out is not None:
            yield close()

    rows = with_revisits(pages).select("page_id", "digest", "url", "html", "refers_to")
    return staged(rows.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives (column archive: URIs); one task reads a file from start to end."""
    spark = archives.sparkSession
    names = ["page_id", "url", *["payload"] * with_payload, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in names], names)

        for b in batches:
            for uri in b.column(0).to_pylist():
                where, path = _open(uri)
                rows, size = [], 0
                with where.open_input_stream(path, compression=None) as source:
                    for record in read_records(source):
                        rows.append(parse(record))
                        size += len(record.block)
                        if len(rows) >= 1000 or size > BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").repartition(parts, "archive").mapInArrow(read, ", ".join(f"{k} {sql[kinds[k]]}" for k in names))
