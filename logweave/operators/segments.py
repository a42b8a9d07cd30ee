"""Segments: the ordered fold that cuts a shard into files, byte offsets, manifests, sparse indexes and look-ups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SEGMENT, INTERVAL = 4096, 100
#: Numbers of a shard that one task looks up.
SPAN = 1 << 20


def _fold_batches(limit: int, batch: str):
    """As ``_fold``, where a segment is closed after a whole batch of entries only."""

    def fold(batches):
        last, segment, at = None, 0, 0
        for b in batches:
            shards, own = b["shard_id"].to_numpy(), b[batch].to_numpy()
            sizes = np.asarray(b["stored_size"].to_numpy())
            number, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            edges = np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (own[1:] != own[:-1]))) if len(b) else np.zeros(0, np.int64)
            for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(b)], strict=True):
                now = (shards[begin], own[begin])
                if last is None or now[0] != last[0]:
                    segment, at = 0, 0
                elif now != last and at >= limit:
                    segment, at = segment + 1, 0
                total = at + np.cumsum(sizes[begin:end])
                number[begin:end], offset[begin:end] = segment, total - sizes[begin:end]
                last, at = now, int(total[-1])
            yield pa.record_batch([*b.columns, pa.array(number), pa.array(offset)], names=[*b.schema.names, "segment_id", "offset_in_segment"])

    return fold


def _fold(limit: int):
    """After each entry, a segment that has reached the limit is closed. Rows come by shard and entry."""

    def fold(batches):
        shard, segment, at = None, 0, 0
        for b in batches:
            shards, sizes = np.asarray(b["shard_id"].to_numpy()), np.asarray(b["stored_size"].to_numpy())
            number, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            begin = 0
            while begin < len(b):
                if shards[begin] != shard:
                    shard, segment, at = shards[begin], 0, 0
                end = int(np.searchsorted(shards[begin:], shard, "right")) + begin
                total = at + np.cumsum(sizes[begin:end])
                stop = begin + min(int(np.searchsorted(total, limit)) + 1, end - begin)
                number[begin:stop] = segment
                offset[begin:stop] = total[: stop - begin] - sizes[begin:stop]
                at = int(total[stop - begin - 1])
                if at >= limit:
                    segment, at = segment + 1, 0
                begin = stop
            yield pa.record_batch([*b.columns, pa.array(number), pa.array(offset)], names=[*b.schema.names, "segment_id", "offset_in_segment"])

    return fold


def assign_segments(log: DataFrame, limit: int = MAX_SEGMENT, columns: tuple[str, ...] = ("shard_id", "entry_number", "ts", "stored_size"), batch: str | None = None) -> DataFrame:
    """The log's columns with segment_id and offset_in_segment. A batch of entries (a column whose value changes with each
    append) lies whole in a segment, however large it is; without one each entry is its own.

    A running sum with a reset is a fold in order, so a shard is one task's; it goes through as a stream of batches of
    narrow rows, sorted by Spark with spilling, and the task keeps three numbers.
    """
    rows = log.select(*columns, *([batch] if batch and batch not in columns else []))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", segment_id long, offset_in_segment long"
    return rows.repartition("shard_id").sortWithinPartitions("shard_id", "entry_number").mapInArrow(_fold_batches(limit, batch) if batch else _fold(limit), schema)


def manifest(assigned: DataFrame) -> DataFrame:
    """A row for each segment: first entry, entries, bytes, times, cumulative offsets, whether it is the shard's current one."""
    files = assigned.groupBy("shard_id", "segment_id").agg(
        F.min("entry_number").alias("start_entry"), F.count(F.lit(1)).alias("entries"), F.sum("stored_size").alias("bytes"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time")
    )
    w = Window.partitionBy("shard_id").orderBy("segment_id")
    end = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("end_offset", end).withColumn("start_offset", F.col("end_offset") - F.col("bytes")).withColumn("is_current", F.lead("segment_id").over(w).isNull())


def _last_below(wanted: DataFrame, known: DataFrame, at: str, value: Column, span: int = SPAN) -> DataFrame:
    """wanted with ``found``: the value of the known row of its shard with the greatest ``at`` that is not above its entry_number.

    Both are dealt by shard and range of ``span`` numbers, and sorted together there; a range begins with what the ranges
    before it end with, which are as many rows as there are ranges. So a shard may hold any share of the rows, and no row
    meets more than its neighbours.
    """
    kinds = [F.col(c) for c in wanted.columns]
    block = lambda c: F.expr(f"{c} div {span}")
    nodes = known.select("shard_id", F.col(at).cast("long").alias("__at"), value.alias("__value")).withColumn("__block", block("__at"))
    tails = nodes.groupBy("shard_id", "__block").agg(F.max_by("__value", "__at").alias("__tail"))
    rows = wanted.select("shard_id", F.struct(*kinds).alias("__row"), F.col("entry_number").cast("long").alias("__at")).withColumn("__block", block("__at"))
    both = nodes.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)).unionByName(rows.withColumn("__value", F.lit(None).cast(nodes.schema["__value"].dataType)))
    w = Window.partitionBy("shard_id", "__block").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last("__value", ignorenulls=True).over(w)).where(F.col("__row").isNotNull())
    blocks = rows.select("shard_id", "__block").distinct()
    ends = blocks.withColumn("__tail", F.lit(None).cast(nodes.schema["__value"].dataType)).withColumn("__ask", F.lit(True)).unionByName(tails.withColumn("__ask", F.lit(False)))
    before = Window.partitionBy("shard_id").orderBy("__block").rangeBetween(Window.unboundedPreceding, -1)
    firsts = ends.withColumn("__before", F.last("__tail", ignorenulls=True).over(before)).where("__ask").select("shard_id", "__block", "__before")
    joined = near.join(firsts, ["shard_id", "__block"], "left")
    return joined.select("__row.*", F.coalesce("__near", "__before").alias("found"))


def locate(wanted: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment that holds each wanted (shard_id, entry_number); entries that none holds give no row."""
    found = _last_below(wanted, segments, "start_entry", F.struct("segment_id", "start_entry", "entries"))
    inside = found.where("entry_number < found.start_entry + found.entries")
    return inside.select(*wanted.columns, "found.segment_id", "found.start_entry")


def sparse_index(assigned: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """shard_id, entry_number, segment_id, offset_in_segment of every interval-th entry."""
    return assigned.where(F.col("entry_number") % interval == 0).select("shard_id", "entry_number", "segment_id", "offset_in_segment")


def as_of(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """The index node at or below each wanted (shard_id, entry_number), wherever nodes are; none below gives no row."""
    found = _last_below(wanted, index, "entry_number", F.struct(F.col("entry_number").alias("node_entry"), "segment_id", "offset_in_segment"))
    return found.where("found is not null").select(*wanted.columns, "found.node_entry", "found.segment_id", "found.offset_in_segment")


def _halving(most: int):
    """Nodes come by shard and number; what a shard keeps is at most 2 * most numbers."""

    def halve(batches):
        shard, kept = None, []

        def out():
            return pa.record_batch([pa.array([shard] * len(kept), pa.int32()), pa.array(kept, pa.int64())], names=["shard_id", "entry_number"])

        for b in batches:
            for s, n in zip(b["shard_id"].to_pylist(), b["entry_number"].to_pylist(), strict=True):
                if s != shard:
                    if kept:
                        yield out()
                    shard, kept = s, []
                kept.append(n)
                if len(kept) >= 2 * most:
                    kept = kept[:: len(kept) // most]
        if kept:
            yield out()

    return halve


def prune_index(index: DataFrame, most: int) -> DataFrame:
    """What is left of a shard's nodes when each time they reach 2 * most only every second one stays.

    Each halving that happens keeps the even places and goes on adding at the end: a fold in order over a shard's nodes,
    through which they go as a stream; the task keeps 2 * most of them.
    """
    nodes = index.select(F.col("shard_id").cast("int").alias("shard_id"), F.col("entry_number").cast("long").alias("entry_number"))
    return nodes.repartition("shard_id").sortWithinPartitions("shard_id", "entry_number").mapInArrow(_halving(most), "shard_id int, entry_number long")
