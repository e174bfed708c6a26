"""WARC archives: one gzip member per record, written and read in sequence.

Records with equal payloads of MIN_BYTES or more are written once; the others are revisit records that refer to it.
Tasks write archives of bounded size to the shared folder and report them in a table, so of a task that ran twice only
the archives of the reported run are ever read. The reader decompresses member by member, a block at a time, frames
by Content-Length and checks every digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, small_batches, tidied

MIN_BYTES = 100
#: Bytes after which a new archive begins, and bytes read at a time.
ARCHIVE, BLOCK = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PREFIX = "urn:page:"
BREAK = b"\r\n"


def _clean(value: str) -> str:
    """A header's value: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit record, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{PREFIX}{'' if key is None else key}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{PREFIX}{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([squeeze.compress(lines.encode()), squeeze.compress(block), squeeze.compress(BREAK + BREAK), squeeze.flush()])


@tidied
def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Archives of rows (key, url, text, digest, refers_to); gives (path, records)."""
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    part, made, out, n, size = TaskContext.get().partitionId(), [], None, 0, 0
    for batch in batches:
        for key, url, text, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                name = f"{part:06d}-{uuid.uuid4().hex}.warc.gz"
                out, n, size = store.open_output_stream(f"{at}/{name}", compression=None), 0, 0
            data = record(key, url, (text or "").encode(), digest, refers_to)
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= ARCHIVE:
                out.close()
                made.append((f"{folder}/{name}", n))
                out = None
    if out is not None:
        out.close()
        made.append((f"{folder}/{name}", n))
    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])


def revisits(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with __digest and __refers_to: the smallest key of the rows with its payload, where that is another one.

    Keys of one payload are counted before they meet, so a hot payload costs one row a task.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    marked = df.withColumn("__digest", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    shared = marked.where(size >= MIN_BYTES).groupBy("__digest").agg(F.min(key).alias("__least"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = marked.join(shared, "__digest", "left")
    other = F.col("__least").isNotNull() & ~F.col(key).eqNullSafe(F.col("__least"))
    return joined.withColumn("__refers_to", F.when(other, F.col("__least"))).drop("__least")


def write(df: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Write a record for each row; gives the table (path, records) of the archives.

    folder: a URI all executors can write to, by default one in the shared folder. The payload is the text in UTF-8
    (null: empty). Of rows with equal payloads of MIN_BYTES or more, those with the smallest key hold it, the others
    refer to it; a null key counts as larger than all, and rows without any key all hold theirs. An empty table gives
    no archives.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(text).alias("text"))
    folder = folder or new_path(df.sparkSession, "warc")
    small_batches(df.sparkSession)
    ready = revisits(rows, "key", "text").select("key", "url", "text", "__digest", "__refers_to")
    return cut(ready.mapInArrow(lambda it: _write(it, folder), "path string, records long"), "archives")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed one after the other."""
    wait, parts = b"", None
    while True:
        data = wait or stream.read(BLOCK)
        if not data:
            if parts is not None:
                raise ValueError("archive ends within a record")
            return
        if parts is None:
            parts, inflate = [], zlib.decompressobj(31)
        parts.append(inflate.decompress(data))
        wait = b""
        if inflate.eof:
            wait = inflate.unused_data
            yield b"".join(parts)
            parts = None


def parse(member: bytes) -> dict:
    """A record's fields, framed by its Content-Length; digests are checked."""
    head, _, rest = member.partition(BREAK + BREAK)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    block = rest[:n]
    if not version.startswith("WARC/") or len(block) != n or rest[n:] != BREAK + BREAK:
        raise ValueError("a record's length is not its Content-Length")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a block does not have its digest")
    http, _, payload = block.partition(BREAK + BREAK)
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda name: int(x) if name in fields and (x := fields[name].strip("<>").removeprefix(PREFIX)) else None
    out = {"key": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload_digest": said}
    if out["record_type"] == "revisit":
        length = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
        return out | {"payload": None, "payload_bytes": int(length.removeprefix("Content-Length: "))}
    if hashlib.sha256(payload).hexdigest() != said:
        raise ValueError("a payload does not have its digest")
    return out | {"payload": payload, "payload_bytes": len(payload)}


KINDS = {"key": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}


@tidied
def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    def rows(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], KINDS[n]) for n in names], names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, at = fs.FileSystem.from_uri(path)
            held, size = [], 0
            with store.open_input_stream(at, compression=None) as stream:
                for member in members(stream):
                    held.append(parse(member))
                    size += len(member)
                    if size > 16 << 20 or len(held) > 5000:
                        yield rows(held)
                        held, size = [], 0
            yield rows(held)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(key, url, record_type, refers_to, payload_digest, payload_bytes, payload) of all records of a table (path, ...) of archives; null payload for revisits."""
    names = [n for n in KINDS if payloads or n != "payload"]
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    many = max(1, archives.count())  # a task for each archive
    return archives.select("path").repartition(many, "path").mapInArrow(lambda it: _read(it, names), ", ".join(f"{n} {kinds[KINDS[n]]}" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(archives, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, strlen(t) AS n, sha256(t) AS digest FROM p
), g AS (
  SELECT *, CASE WHEN n >= {MIN_BYTES} THEN min(page_id) OVER (PARTITION BY digest) END AS least FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM g
"""
