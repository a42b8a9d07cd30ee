"""The segment files' binary format: a Spark scan, positional reads, and a writer that runs on executors.

An entry is a little-endian u32 length, an i64 of nanoseconds and the payload; a payload that begins with zstd's magic
bytes is compressed. Files are read as Spark's ``binaryFile`` does, so any store that Spark reads will do; they are written
through Arrow's file systems, to a folder that all executors share. A header that is all zero is the end of a file that was
allocated in advance; an entry may be empty. A damaged payload counts as an entry and has null data.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import segments

HEADER = struct.Struct("<Iq")
#: zstd's magic bytes, the greatest length of an entry, the data files' names.
MAGIC, MOST = b"\x28\xb5\x2f\xfd", 128 << 20
_NAME = re.compile(r"shard-(\d+)/log-(\d+)\.\w+$")
FILE = "shard-{shard:04d}/log-{number:016d}.seg"


def encode(entries: list[tuple[int, bytes]], compress_from: int | None = None) -> bytes:
    """(nanoseconds, payload) pairs as a file's bytes; payloads of compress_from bytes or more are compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = bytearray()
    for ts, data in entries:
        own = squeeze(data) if compress_from is not None and len(data) >= compress_from else data
        out += HEADER.pack(len(own), ts) + own
    return bytes(out)


def hops(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int]]:
    """(place, nanoseconds, stored length) of each whole entry from a place on, without reading payloads."""
    while at + HEADER.size <= len(data):
        size, ts = HEADER.unpack_from(data, at)
        if size > MOST or at + HEADER.size + size > len(data) or not size and not ts:
            return
        yield at, ts, size
        at += HEADER.size + size


def payload(data: bytes, at: int, size: int) -> bytes | None:
    body = data[at + HEADER.size : at + HEADER.size + size]
    if not body.startswith(MAGIC):
        return body
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except zstandard.ZstdError:
        return None


def decode(data: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes | None, int]]:
    """(place, nanoseconds, payload, stored length) of each whole entry."""
    for place, ts, size in hops(data, at):
        yield place, ts, payload(data, place, size), size


def nth(data: bytes, n: int) -> tuple[int, int, bytes | None, int] | None:
    """The n-th entry (from 0) of a file, by hops over those before it."""
    for k, (place, ts, size) in enumerate(hops(data)):
        if k == n:
            return place, ts, payload(data, place, size), size
    return None


_ROW = "shard_id int, path string, entry_in_file long, offset_in_segment long, ts_nanos long, data binary, stored_bytes long"
_SCHEMA = pa.schema([("shard_id", pa.int32()), ("path", pa.string()), ("entry_in_file", pa.int64()), ("offset_in_segment", pa.int64()), ("ts_nanos", pa.int64()), ("data", pa.binary()), ("stored_bytes", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _shard(path: str) -> int | None:
    found = _NAME.search(path)
    return int(found[1]) if found else None


def _entries(batches):
    for b in batches:
        for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
            rows, shard = [], _shard(path)
            for k, (at, ts, data, size) in enumerate(decode(content)):
                rows.append((shard, path, k, at, ts, data, HEADER.size + size))
                if len(rows) == 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "log-*").load(folder)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole entry of the data files below folder, with its place and its stored bytes, header included."""
    return _files(spark, folder).select("path", "content").mapInArrow(_entries, _ROW)


def _at(batches):
    for b in batches:
        rows = []
        for path, content, places in zip(b["path"].to_pylist(), b["content"].to_pylist(), b["places"].to_pylist(), strict=True):
            for at in places:
                one = next(decode(content, at), None)
                if one:
                    rows.append((_shard(path), path, None, one[0], one[1], one[2], HEADER.size + one[3]))
        yield _batch(rows)


def read_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """The entries at positions (path, offset_in_segment); only the files asked for are decoded, and only at these places."""
    wanted = positions.groupBy("path").agg(F.array_sort(F.collect_set(F.col("offset_in_segment").cast("long"))).alias("places"))
    return _files(spark, folder).join(wanted, "path").select("path", "content", "places").mapInArrow(_at, _ROW)


def data_files(scanned: DataFrame) -> DataFrame:
    """shard_id, path, entries, bytes as stored, start_time and end_time (nanoseconds) of each file with an entry, as ``recovery.rebuild`` takes them."""
    return scanned.groupBy("shard_id", "path").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("stored_bytes").alias("bytes"), F.min("ts_nanos").alias("start_nanos"), F.max("ts_nanos").alias("end_nanos")
    )


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """shard_id, path, size of every data file below folder, without reading any."""
    shard = F.regexp_extract("path", r"shard-(\d+)/log-", 1).try_cast("int")
    return _files(spark, folder).select(shard.alias("shard_id"), "path", F.col("length").alias("size"))


_WRITTEN = "shard_id int, segment_id long, path string, start_entry long, entries long, bytes long, start_nanos long, end_nanos long"


def write_segments(log: DataFrame, folder: str, limit: int = segments.MAX_SEGMENT, compress_from: int | None = None) -> DataFrame:
    """Writes log (shard_id, entry_number, ts_nanos, data) as segment files below folder; a row for each file.

    A segment is one group of a task, at most its limit and one entry large. It is written under a name of its own and then
    moved, so a task that is done again leaves the same file.
    """
    sized = log.select("shard_id", "entry_number", "ts_nanos", F.coalesce("data", F.lit(b"")).alias("data")).withColumn("stored_size", (F.octet_length("data") + HEADER.size).cast("long"))
    placed = segments.assign_segments(sized, limit, ("shard_id", "entry_number", "ts_nanos", "data", "stored_size"))

    def write(table: pa.Table) -> pa.Table:
        import uuid

        from pyarrow import fs

        table = table.sort_by("entry_number")
        shard, number, ts = table["shard_id"][0].as_py(), table["segment_id"][0].as_py(), table["ts_nanos"].to_pylist()
        content = encode(list(zip(ts, table["data"].to_pylist(), strict=True)), compress_from)
        store, base = fs.FileSystem.from_uri(folder)
        name = FILE.format(shard=shard, number=number)
        store.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
        own = f"{base}/{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(content)
        store.move(own, f"{base}/{name}")
        row = (shard, number, name, table["entry_number"][0].as_py(), len(table), len(content), min(ts), max(ts))
        return pa.table({n.split()[0]: pa.array([v], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[n.split()[1]]) for n, v in zip(_WRITTEN.split(", "), row, strict=True)})

    return placed.groupBy("shard_id", "segment_id").applyInArrow(write, _WRITTEN)
