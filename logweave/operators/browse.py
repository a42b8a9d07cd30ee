"""Reads that leave offsets alone, and reads from an offset. Heads and offsets have a row for each shard and group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shards whose ranges become literals of a filter, which prunes folders and row groups; more are joined.
LITERAL = 256


def between(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """The entries of ranges (shard_id, low, high), a row for each shard: low <= entry_number < high."""
    rows = ranges.where("low < high").select("shard_id", "low", "high").limit(LITERAL + 1).collect()
    if len(rows) > LITERAL:
        return log.join(ranges, "shard_id").where("entry_number >= low and entry_number < high").drop("low", "high")
    each = [(F.col("shard_id") == r.shard_id) & (F.col("entry_number") >= r.low) & (F.col("entry_number") < r.high) for r in rows]
    while len(each) > 1:  # a balanced tree
        each = [reduce(lambda a, b: a | b, each[i : i + 2]) for i in range(0, len(each), 2)]
    return log.where(each[0]) if each else log.where(F.lit(False))


def discover(pattern: str, existing: DataFrame, consumer: int = 0, consumers: int = 1) -> DataFrame:
    """shard_id, ascending, of the shards that exist and are this consumer's share of a pattern that ends with ``:*``."""
    consumers = max(consumers, 1)
    if not 0 <= consumer < consumers:
        raise ValueError(f"consumer {consumer} is not one of {consumers}")
    if not pattern.endswith(":*"):
        raise ValueError(f"a pattern ends with :*, unlike {pattern}")
    return existing.select("shard_id").distinct().where(F.pmod("shard_id", F.lit(consumers)) == consumer).orderBy("shard_id")


def highest_read(read: DataFrame) -> DataFrame:
    """group, shard_id, highest: the greatest entry that each group has read."""
    return read.groupBy("group", "shard_id").agg(F.max("entry_number").alias("highest"))


def list_recent(log: DataFrame, heads: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` durable entries of each shard, in ascending order; none for a limit of 0 or less."""
    lowest = F.greatest(F.col("durable_entry") - max(limit, 0), F.lit(0))
    return between(log, heads.select("shard_id", lowest.alias("low"), F.col("durable_entry").alias("high")))


def scan(log: DataFrame, heads: DataFrame, stop_after: int | None = None) -> DataFrame:
    """All durable entries; with stop_after the first ones of each shard only."""
    high = F.col("durable_entry") if stop_after is None else F.least("durable_entry", F.lit(stop_after).cast("long"))
    return between(log, heads.select("shard_id", F.lit(0).cast("long").alias("low"), high.alias("high")))


def scan_each(log: DataFrame, heads: DataFrame, shard: int, callback, batch: int = 10_000) -> int:
    """Calls back with each durable entry of a shard in order until it gives False; how many it was called with.

    Entries are fetched in ranges of ``batch`` numbers, so an early end reads no further ones.
    """
    high = heads.where(F.col("shard_id") == shard).agg(F.max("durable_entry")).first()[0] or 0
    calls = 0
    for low in range(0, high, batch):
        part = log.where((F.col("shard_id") == shard) & (F.col("entry_number") >= low) & (F.col("entry_number") < min(low + batch, high)))
        for row in part.orderBy("entry_number").toLocalIterator():
            calls += 1
            if callback(row) is False:
                return calls
    return calls


def point_lookup(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries with the wanted (shard_id, entry_number); missing ones give no row.

    A few are looked up by literals, which skip folders and row groups; more by a join.
    """
    few = wanted.select("shard_id", "entry_number").limit(LITERAL + 1).collect()
    if len(few) > LITERAL or wanted.columns != ["shard_id", "entry_number"] or len(set(few)) < len(few):
        return log.join(wanted, ["shard_id", "entry_number"])
    by_shard: dict[int, list[int]] = {}
    for r in few:
        by_shard.setdefault(r.shard_id, []).append(r.entry_number)
    each = [(F.col("shard_id") == s) & F.col("entry_number").isin(n) for s, n in by_shard.items()]
    return log.where(reduce(lambda a, b: a | b, each)) if each else log.where(F.lit(False))


def from_offsets(log: DataFrame, heads: DataFrame, offsets: DataFrame, group: str, per_shard: int | None = None, earliest: DataFrame | None = None) -> DataFrame:
    """What a group would read next: from its offset (0 if it has none), raised to the earliest retained entry."""
    own = offsets.where(F.col("group") == group).select("shard_id", F.col("offset").alias("__offset"))
    ends = heads.select("shard_id", "durable_entry").join(own, "shard_id", "left")
    start = F.coalesce("__offset", F.lit(0))
    if earliest is not None:
        ends = ends.join(earliest.select("shard_id", "first_entry"), "shard_id", "left")
        start = F.greatest(start, F.coalesce("first_entry", F.lit(0)))
    end = F.col("durable_entry") if per_shard is None else F.least("durable_entry", start + per_shard)
    return between(log, ends.select("shard_id", start.alias("low"), end.alias("high")))


def quota(ranges: DataFrame, count: int) -> DataFrame:
    """ranges (shard_id, low, high) cut so that they hold at most ``count`` entries, shards ascending, each drained before the next."""
    waiting = F.greatest(F.col("high") - F.col("low"), F.lit(0))
    before = Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    left = F.greatest(F.lit(count) - F.coalesce(F.sum(waiting).over(before), F.lit(0)), F.lit(0))
    return ranges.select("shard_id", "low", (F.col("low") + F.least(waiting, left)).alias("high"))


def read(log: DataFrame, heads: DataFrame, offsets: DataFrame, group: str, count: int) -> DataFrame:
    """At most ``count`` entries over all shards, shards ascending, each drained before the next.

    Numbers have no gaps, so the shards' quotas follow from heads and offsets; only rows that are read are touched.
    """
    own = offsets.where(F.col("group") == group).select("shard_id", F.col("offset").alias("__offset"))
    ends = heads.select("shard_id", "durable_entry").join(own, "shard_id", "left").withColumn("__start", F.coalesce("__offset", F.lit(0)))
    return between(log, quota(ends.select("shard_id", F.col("__start").alias("low"), F.col("durable_entry").alias("high")), count))
