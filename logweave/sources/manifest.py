"""A shard's manifest in its binary form: heads, consumer offsets, index nodes and data files; read and written as tables.

Little-endian throughout. Header: magic, version (u32), head, write offset (u64), numbers of consumers, nodes and files (u32).
Then consumers (u8 length, name, u64 offset), nodes (u64 entry, u32 file, u64 offset) and files (u16 length, path, and six u64:
start and end offset, start entry, entries, start and end time in nanoseconds). The last file is the current one.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The magic number, the version, the least size.
MAGIC, VERSION, LEAST = 0x434F4D54, 1, 32
_HEAD, _NODE, _FILE = struct.Struct("<IIqqIII"), struct.Struct("<qIq"), struct.Struct("<6q")


@dataclass
class Manifest:
    head: int = 0
    write_offset: int = 0
    offsets: dict[str, int] = field(default_factory=dict)
    #: (entry number, file index, byte offset)
    nodes: list[tuple[int, int, int]] = field(default_factory=list)
    #: (path, start offset, end offset, start entry, entries, start time, end time)
    files: list[tuple[str, int, int, int, int, int, int]] = field(default_factory=list)


def encode(own: Manifest) -> bytes:
    out = [_HEAD.pack(MAGIC, VERSION, own.head, own.write_offset, len(own.offsets), len(own.nodes), len(own.files))]
    for group, offset in own.offsets.items():
        name = group.encode()
        out.append(struct.pack("<B", len(name)) + name + struct.pack("<q", offset))
    out += [_NODE.pack(*n) for n in own.nodes]
    for path, *numbers in own.files:
        name = path.encode()
        out.append(struct.pack("<H", len(name)) + name + _FILE.pack(*numbers))
    return b"".join(out)


def decode(data: bytes) -> Manifest:
    """A ValueError for what is no whole manifest of this version."""
    if len(data) < LEAST:
        raise ValueError("manifest too small")
    magic, version, head, write_offset, consumers, nodes, files = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a manifest of version {VERSION}: {magic:x}, {version}")
    own, at = Manifest(head, write_offset), _HEAD.size
    try:
        for _ in range(consumers):
            n = data[at]
            name = data[at + 1 : at + 1 + n]
            (own.offsets[name.decode()],) = struct.unpack_from("<q", data, at + 1 + n)
            at += 9 + n
        for _ in range(nodes):
            own.nodes.append(_NODE.unpack_from(data, at))
            at += _NODE.size
        for _ in range(files):
            (n,) = struct.unpack_from("<H", data, at)
            path = data[at + 2 : at + 2 + n].decode()
            own.files.append((path, *_FILE.unpack_from(data, at + 2 + n)))
            at += 2 + n + _FILE.size
    except (struct.error, IndexError) as e:
        raise ValueError("manifest ends early") from e
    return own


_GROUP = "array<struct<group: string, offset: bigint>>"
_NODES = "array<struct<entry_number: bigint, file_index: int, offset: bigint>>"
_FILES = "array<struct<path: string, start_offset: bigint, end_offset: bigint, start_entry: bigint, entries: bigint, start_nanos: bigint, end_nanos: bigint>>"
SCHEMA = f"shard_id int, head bigint, write_offset bigint, offsets {_GROUP}, nodes {_NODES}, files {_FILES}, error string"


def _arrow() -> pa.Schema:
    i, s = pa.int64(), pa.string()
    return pa.schema(
        [
            ("shard_id", pa.int32()), ("head", i), ("write_offset", i),
            ("offsets", pa.list_(pa.struct([("group", s), ("offset", i)]))),
            ("nodes", pa.list_(pa.struct([("entry_number", i), ("file_index", pa.int32()), ("offset", i)]))),
            ("files", pa.list_(pa.struct([("path", s), *((n, i) for n in ("start_offset", "end_offset", "start_entry", "entries", "start_nanos", "end_nanos"))]))),
            ("error", s),
        ]
    )


def _row(shard: int, content: bytes) -> dict:
    try:
        m = decode(content)
    except ValueError as e:
        return {"shard_id": shard, "error": str(e)}
    kinds = _arrow()
    named = lambda column, rows: [dict(zip([f.name for f in kinds.field(column).type.value_type], r, strict=True)) for r in rows]
    return {"shard_id": shard, "head": m.head, "write_offset": m.write_offset, "offsets": named("offsets", m.offsets.items()), "nodes": named("nodes", m.nodes), "files": named("files", m.files), "error": None}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each manifest below folder; one that can't be read has its error and nulls."""

    def rows(batches):
        for b in batches:
            out = [_row(int(p.rpartition("shard-")[2].partition("/")[0]), c) for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(out, _arrow())

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "index.bin").load(folder)
    return files.select("path", "content").mapInArrow(rows, SCHEMA)


def write(manifests: DataFrame, folder: str) -> DataFrame:
    """Writes manifests (columns as ``read`` gives them) as shard-S/index.bin; returns shard_id and bytes of each. A file is replaced as a whole."""

    def rows(batches):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            done = []
            for r in b.to_pylist():
                own = Manifest(r["head"], r["write_offset"], {o["group"]: o["offset"] for o in r["offsets"] or ()}, [tuple(n.values()) for n in r["nodes"] or ()], [tuple(f.values()) for f in r["files"] or ()])
                data, at = encode(own), f"{base}/shard-{r['shard_id']:04d}"
                store.create_dir(at, recursive=True)
                name = f"{at}/.{uuid.uuid4().hex}"
                with store.open_output_stream(name) as f:
                    f.write(data)
                store.move(name, f"{at}/index.bin")
                done.append((r["shard_id"], len(data)))
            yield pa.record_batch([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64())], names=["shard_id", "bytes"])

    return manifests.select("shard_id", "head", "write_offset", "offsets", "nodes", "files").mapInArrow(rows, "shard_id int, bytes long")


def assembled(heads: DataFrame, files: DataFrame, offsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Manifests from the tables that queries work on, a row for each shard of heads (shard_id, head).

    files: shard_id, path, start_offset, end_offset, start_entry, entries, start_nanos, end_nanos, in the order of their paths.
    """
    lists = lambda df, order, columns, name: df.groupBy("shard_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__by"), F.struct(*columns).alias("row")))), lambda x: x["row"]).alias(name))
    own = lists(files, "path", [F.col("path"), *(F.col(c).cast("long").alias(c) for c in ("start_offset", "end_offset", "start_entry", "entries", "start_nanos", "end_nanos"))], "files")
    groups = lists(offsets, "group", [F.col("group"), F.col("offset").cast("long").alias("offset")], "offsets")
    thin = lists(nodes, "entry_number", [F.col("entry_number").cast("long").alias("entry_number"), F.col("file_index").cast("int").alias("file_index"), F.col("offset").cast("long").alias("offset")], "nodes")
    out = heads.select("shard_id", F.col("head").cast("long").alias("head")).join(own, "shard_id", "left").join(groups, "shard_id", "left").join(thin, "shard_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    last = F.coalesce(F.element_at("files", -1)["end_offset"], F.lit(0).cast("long"))
    return out.select(F.col("shard_id").cast("int").alias("shard_id"), "head", last.alias("write_offset"), empty("offsets", _GROUP), empty("nodes", _NODES), empty("files", _FILES))
