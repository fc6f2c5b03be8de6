"""WARC files as a chunked record table.

A record's payload becomes rows (record_id, chunk_no, ...) of at most ``chunk_bytes``, read from the
stream as they come: no step holds a whole record, however large.  Each row carries the running
SHA-256 of the payload up to its end, so the last row has the payload's digest and a reader can
verify or resume after any row.

Cases: an empty payload has one row of no bytes; a null page or URL is an empty payload or a record
without a target; ids needn't be unique, since a record is told apart by file and offset;
blanks and control characters in a URL are percent-encoded; a header may have any length; a very long payload is many
rows; repeated rows are records of their own; other columns, whatever their names, are ignored; an empty table gives no files
and no rows.  Damage (no header where one is due or an unfinished one, a length that is missing, negative or no number, a
payload that ends early, broken gzip data) gives one last row of the file with the offset of the record and ``error``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.llm.common import col, shared_dir, string, written

CHUNK_BYTES = 16 << 10
#: Bytes that a task holds before it hands a batch of rows on.
BATCH_BYTES = 4 << 20

SCHEMA = "file string, record_offset long, record_id string, warc_type string, target_uri string, content_length long, chunk_no int, payload binary, sha256 string, last boolean, error string"
_TYPES = pa.schema([("file", pa.string()), ("record_offset", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("content_length", pa.int64()), ("chunk_no", pa.int32()), ("payload", pa.binary()), ("sha256", pa.string()), ("last", pa.bool_()), ("error", pa.string())])


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Stream:
    """Bytes of a file as asked for; gzip members, one after another, are inflated on the way."""

    def __init__(self, source, step: int = 1 << 18) -> None:
        self.source, self.step, self.buffer, self.at = source, step, b"", 0
        self.raw = source.read(2)
        self.gzip, self.inflater = self.raw == b"\x1f\x8b", None

    def _more(self) -> bool:
        if not self.gzip:
            new = self.raw or self.source.read(self.step)
            self.raw = b""
            self.buffer += new
            return bool(new)
        while True:
            if not self.raw:
                self.raw = self.source.read(self.step)
                if not self.raw:
                    return False
            if self.inflater is None:
                self.inflater = zlib.decompressobj(31)
            # a bounded piece at a time, so that a bomb can't fill the memory
            new = self.inflater.decompress(self.raw, self.step)
            self.raw = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.raw, self.inflater = self.inflater.unused_data, None
            if new:
                self.buffer += new
                return True

    def read(self, n: int) -> bytes:
        """Up to n bytes; fewer only at the end."""
        while len(self.buffer) < n and self._more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is skipped, however many; None if the stream ends first."""
        found = self.buffer.find(mark)
        if found < 0:
            # grown in place and searched once, so that a long stretch takes linear time
            held = bytearray(self.buffer)
            while found < 0:
                self.buffer, start = b"", max(0, len(held) - len(mark) + 1)
                if not self._more():
                    self.buffer = bytes(held)
                    return None
                held += self.buffer
                found = held.find(mark, start)
            self.buffer = bytes(held)
        out, self.buffer = self.buffer[:found], self.buffer[found + len(mark) :]
        self.at += found + len(mark)
        return out


class Damage(ValueError):
    """What is wrong with the record at ``offset``."""

    def __init__(self, offset: int, what: str) -> None:
        super().__init__(what)
        self.offset = offset


def _length(offset: int, field: str | None) -> int:
    if field is None or not field.isascii() or not field.isdigit() or len(field) > 18:
        raise Damage(offset, f"no content length: {field!r:.60}")
    return int(field)


def chunks(stream: Stream, chunk_bytes: int) -> Iterator[dict]:
    """The rows of all records of one stream, without the file; the last has ``error`` if the stream is damaged."""
    at = 0
    try:
        for row in _chunks(stream, chunk_bytes):
            at = row["record_offset"]
            yield row
    except (Damage, zlib.error, OSError) as damage:
        yield {"record_offset": getattr(damage, "offset", at), "error": str(damage)}


def _chunks(stream: Stream, chunk_bytes: int) -> Iterator[dict]:
    while True:
        while stream.buffer[:2] == b"\r\n" or (len(stream.buffer) < 2 and stream._more()):
            if stream.buffer[:2] == b"\r\n":
                stream.read(2)
        offset = stream.at
        head = stream.until(b"\r\n\r\n")
        if head is None:
            if stream.buffer:
                raise Damage(offset, "the header ends early")
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/"):
            raise Damage(offset, f"no WARC record: {lines[0][:60]!r}")
        left = length = _length(offset, fields.get("content-length"))
        digest, number = hashlib.sha256(), 0
        while True:
            payload = stream.read(min(left, chunk_bytes))
            if len(payload) < min(left, chunk_bytes):
                raise Damage(offset, "the payload ends early")
            left -= len(payload)
            digest.update(payload)
            yield {"record_offset": offset, "record_id": fields.get("warc-record-id", "").strip("<>") or None, "warc_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "content_length": length, "chunk_no": number, "payload": payload, "sha256": digest.hexdigest(), "last": left == 0}
            number += 1
            if not left:
                break


def _read(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, at = _opened(path)
            with system.open_input_stream(at, compression=None) as source:
                rows, held = [], 0
                for row in chunks(Stream(source), chunk_bytes):
                    rows.append({"file": path.rsplit("/", 1)[-1], **row})
                    held += len(row.get("payload") or b"") + len(row.get("target_uri") or "") + 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)


def read_warc(paths: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the files named in ``paths`` (path string), one task for a file."""
    rows = paths.select(F.col("path").cast("string")).where("path IS NOT NULL")
    return rows.repartition(max(1, rows.count()), "path").mapInArrow(lambda batches: _read(batches, chunk_bytes), SCHEMA)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    name = f"{folder}/part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex[:8]}.warc.gz"
    system, at = _opened(name)
    sink, records = None, 0
    for batch in batches:
        for record_id, uri, scalar in zip(batch.column("id").to_pylist(), batch.column("uri").to_pylist(), batch.column("payload"), strict=True):
            if sink is None:
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                sink = system.open_output_stream(at, compression=None)
            # the batch's own bytes; nothing is copied but what the packer takes
            payload = scalar.as_buffer() if scalar.is_valid else b""
            target = "" if uri is None else "WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri) + "\r\n"
            head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{record_id}>\r\n{target}Content-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            sink.write(packer.compress(head.encode()))
            view = memoryview(payload)
            for k in range(0, len(payload), 1 << 20):
                sink.write(packer.compress(view[k : k + (1 << 20)]))
            sink.write(packer.compress(b"\r\n\r\n") + packer.flush())
            records += 1
    if sink is not None:
        sink.close()
        yield pa.RecordBatch.from_pylist([{"path": name, "records": records}], schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a gzipped WARC file for each non-empty partition; (path, records) of the files of successful attempts."""
    rows = pages.select(F.concat(F.lit("urn:page:"), F.coalesce(string(id_col), F.lit("null"))).alias("id"), string(uri_col).alias("uri"), col(payload_col).cast("binary").alias("payload"))
    return written(rows.mapInArrow(lambda batches: _write(batches, folder), "path string, records long"))


def chunked(spark: SparkSession, pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pages written as WARC files to the shared folder and read as chunks."""
    return read_warc(write_warc(pages, shared_dir(spark)), chunk_bytes)


ORACLE = f"""WITH p AS (SELECT 'urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null') AS record_id, regexp_replace(url, ' ', '%20', 'g') AS target_uri, coalesce(encode(html), ''::BLOB) AS b FROM pages),
c AS (SELECT *, octet_length(b) AS n, unnest(generate_series(0, greatest(octet_length(b) - 1, 0) // {CHUNK_BYTES})) AS k FROM p)
SELECT record_id, target_uri, CAST(n AS BIGINT) AS content_length, CAST(k AS INTEGER) AS chunk_no, CAST(least(n - k * {CHUNK_BYTES}, {CHUNK_BYTES}) AS INTEGER) AS n_bytes,
sha256(b[1:(k + 1) * {CHUNK_BYTES}]) AS sha256, sha256(b[k * {CHUNK_BYTES} + 1:(k + 1) * {CHUNK_BYTES}]) AS chunk_sha256, (k + 1) * {CHUNK_BYTES} >= n AS last FROM c"""
