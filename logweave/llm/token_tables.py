"""Operator 5: token ids in sorted-string-table shards.

Documents are dealt by ranges of their id and sorted; each task encodes its range and writes one shard:

    blocks | index | Bloom filter | footer

A block holds entries (key, value) up to about ``BLOCK`` bytes. A key is stored as the number of bytes that it shares with
the one before, the rest's length and the rest; a value is the ids as little-endian integers of 2 bytes, or of 4 where an
id of the shard's vocabulary needs them, with a zlib checksum over the block. The index has each block's last key, place and length; the filter has each key; the footer says where they are. A
look-up opens the shard whose range of keys, which the manifest has, holds its key, reads the footer, asks the filter, searches
the index by bisection and decodes one block (more only where a key is repeated over several).

Shards lie in the shared folder under ``spark.checkpoint.dir``, through ``pyarrow.fs`` (local disks, HDFS, object stores).
A task writes under a name of its own and renames, so a repeated task leaves the same shard. The manifest has a row for
each shard and is written before anything is read back.

Null texts count as empty and have the end id alone; texts of any length are one entry, whole in one block. A null doc_id has
the empty key, before all others. Rows with equal ids are neighbours in the order of their texts, over several shards where
they are many. An empty table has no shards. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm._common import frozen, session, shared_dir, shuffle_partitions
from logweave.llm.word_tokens import WordEncoder

END_ID, BLOCK, BITS, PROBES = 1, 1 << 16, 10, 7
_FOOTER = struct.Struct("<6QI8s")
_MAGIC = b"TOKSST01"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bits in them of the keys' places, a row for each probe."""
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    at = np.stack([(low + np.uint64(i) * high) % np.uint64(size) for i in range(PROBES)]).astype(np.int64)
    return at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)


class ShardWriter:
    """Writes entries, which come in the order of their keys, to an open binary file."""

    def __init__(self, out, wide: int = 4):
        self.kind = f"<u{wide}"
        self.out, self.at, self.n, self.tokens = out, 0, 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("Q")
        self.block, self.last, self.first = bytearray(), b"", b""

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian 32-bit integers."""
        value = np.frombuffer(ids, "<u4").astype(self.kind).tobytes()
        if len(self.block) >= BLOCK:
            self._close()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.first, self.last = self.first if self.n else key, key
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        self.n += 1
        self.tokens += len(ids) // 4

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        at, self.at = self.at, self.at + len(data)
        return at, len(data)

    def _close(self) -> None:
        if self.block:
            data = bytes(self.block)
            self.index.append((self.last, *self._put(data + struct.pack("<I", zlib.crc32(data)))))
            self.block = bytearray()

    def finish(self) -> None:
        self._close()
        index = self._put(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        size = max(64, BITS * self.n // 8 * 8)
        bits, keys = np.zeros(size // 8, np.uint8), np.frombuffer(self.hashes, np.uint64)
        for k in range(0, len(keys), 1 << 16):
            at, bit = _bits(keys[k : k + (1 << 16)], size)
            np.bitwise_or.at(bits, at.ravel(), bit.ravel())
        bloom = self._put(bits.tobytes())
        self._put(_FOOTER.pack(*index, *bloom, self.n, self.tokens, int(self.kind[2]), _MAGIC))


class Shard:
    """Reads a shard from a file that can seek."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        index_at, index_n, bloom_at, bloom_n, self.n, self.tokens, wide, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC or wide not in (2, 4):
            raise ValueError("not a token shard")
        self.kind = f"<u{wide}"
        self.bloom = np.frombuffer(self._at(bloom_at, bloom_n), np.uint8)
        data, at, self.index = self._at(index_at, index_n), 0, []
        while at < len(data):
            n, at = _read(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QI", data, at + n)))
            at += n + 12

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, n = self.index[k]
        data = self._at(place, n)
        (crc,) = struct.unpack_from("<I", data, n - 4)
        if zlib.crc32(data[:-4]) != crc:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < n - 4:
            shared, at = _read(data, at)
            rest, at = _read(data, at)
            size, at = _read(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, self.kind, size // int(self.kind[2]), at).astype("<u4").tobytes()
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._entries(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this doc_id."""
        key, out = key_of(doc_id), []
        at, bit = _bits(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64), 8 * len(self.bloom))
        if not (self.bloom[at] & bit).all():
            return out
        k = bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            for own, value in self._entries(k):
                if own == key:
                    out.append(np.frombuffer(value, "<u4"))
                elif own > key:
                    return out
            k += 1
        return out


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str, path: str, end_id: int):
    def write(batches):
        encoder, writer, end = WordEncoder.load(path), None, np.array([end_id], "<u4").tobytes()
        system, base = filesystem(folder)
        part = TaskContext.get().partitionId()
        name, own = f"{base}/shard-{part:06d}.sst", f"{base}/.shard-{part:06d}-{uuid.uuid4().hex}"
        file = None
        for b in batches:
            if len(b) and file is None:
                system.create_dir(base, recursive=True)
                file = system.open_output_stream(own)
                writer = ShardWriter(file, 2 if max(end_id, encoder.most) < 1 << 16 else 4)
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoder.encode(b["body"].to_pylist()), strict=True):
                writer.add(key_of(doc_id), ids + end)
        if file is not None:
            writer.finish()
            file.close()
            system.move(own, name)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{folder}/shard-{part:06d}.sst"]), pa.array([writer.n], pa.int64()), pa.array([writer.tokens], pa.int64()), pa.array([writer.first], pa.binary()), pa.array([writer.last], pa.binary())], names=["shard", "path", "n_docs", "n_tokens", "first_key", "last_key"])

    return write


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs as shards below folder and returns the manifest: shard, path, n_docs, n_tokens, first and last key. path: the tokenizer's file."""
    spark = session(docs.sparkSession)
    bodies = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    # many rows of one id, or of none, may lie in several shards, in the order of their texts
    order = (F.asc_nulls_first("doc_id"), F.substring("body", 1, 32))
    ordered = bodies.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order, "body")
    return frozen(ordered.mapInArrow(_write(folder or shared_dir(spark, "tokens"), path, end_id), "shard int, path string, n_docs long, n_tokens long, first_key binary, last_key binary"), "manifest")


def _scan(batches):
    for b in batches:
        for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist(), strict=True):
            system, name = filesystem(path)
            with system.open_input_file(name) as file:
                rows: list[tuple] = []
                for key, value in Shard(file):
                    rows.append((id_of(key), base, len(value) // 4, zlib.crc32(value), value))
                    base += len(value) // 4
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (little-endian 32-bit) of every document in the manifest's shards."""
    spark = session(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return placed.repartition(shuffle_partitions(spark), "shard").mapInArrow(_scan, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def look_up(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the rows with one doc_id. Only shards whose keys' range has it are opened: one, or several for rows of one id."""
    out, key = [], F.lit(key_of(doc_id))
    for r in manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("shard").toLocalIterator():
        system, name = filesystem(r.path)
        with system.open_input_file(name) as file:
            out += Shard(file).get(doc_id)
    return out
