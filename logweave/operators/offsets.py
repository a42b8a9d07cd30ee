"""Consumer groups: cumulative acknowledgement, ranges, resets, lag, duplicates.

Tables: heads (shard_id, next_entry, durable_entry), offsets (group, shard_id, offset), acks (group, shard_id,
entry_number, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import routing


def ack(acks: DataFrame, heads: DataFrame, offsets: DataFrame) -> DataFrame:
    """group, shard_id, offset, acked: per shard the offset rises to the greatest id + 1, at most the durable head."""
    new = acks.groupBy("group", "shard_id").agg((F.max("entry_number") + 1).alias("__to"), F.count(F.lit(1)).alias("acked"))
    capped = new.join(heads.select("shard_id", "durable_entry"), "shard_id").withColumn("__to", F.least("__to", "durable_entry"))
    joined = capped.join(offsets, ["group", "shard_id"], "full")
    return joined.select("group", "shard_id", F.greatest("offset", "__to").alias("offset"), F.coalesce("acked", F.lit(0)).alias("acked"))


def ack_range(ranges: DataFrame, reads: DataFrame, offsets: DataFrame) -> DataFrame:
    """ranges (group, shard_id, from_entry, to_entry) with accepted, reason and the new offset.

    Refused: a range that ends before it starts, or beyond the highest entry read, where anything has been read (reads:
    group, shard_id, highest). Accepted ones set the offset to to_entry + 1, also backwards.
    """
    joined = ranges.join(reads, ["group", "shard_id"], "left").join(offsets, ["group", "shard_id"], "left")
    reason = F.when(F.col("from_entry") > F.col("to_entry"), "empty range").when(F.col("to_entry") > F.col("highest"), "beyond what was read")
    return joined.select("group", "shard_id", "from_entry", "to_entry", reason.isNull().alias("accepted"), reason.alias("reason"), F.when(reason.isNull(), F.col("to_entry") + 1).otherwise(F.coalesce("offset", F.lit(0))).alias("offset"))


def reset(resets: DataFrame, heads: DataFrame) -> DataFrame:
    """resets (group, shard_id, to) as offsets: from the durable head for negative numbers, not below 0, with no upper cap."""
    at = F.when(F.col("to") < 0, F.greatest(F.col("durable_entry") + F.col("to"), F.lit(0))).otherwise(F.col("to"))
    return resets.join(heads.select("shard_id", "durable_entry"), "shard_id").select("group", "shard_id", at.alias("offset"))


def upsert(offsets: DataFrame, new: DataFrame) -> DataFrame:
    """offsets, with those of new in the place of theirs."""
    return new.select("group", "shard_id", "offset").unionByName(offsets.join(new, ["group", "shard_id"], "left_anti").select("group", "shard_id", "offset"))


def merge_legacy(old: DataFrame, new: DataFrame) -> DataFrame:
    """The offsets of both stores; where both have one, the new store's."""
    return upsert(old, new)


def slots(offsets: DataFrame) -> DataFrame:
    """group, shard_id, offset with the group's name as it is stored and the slot where the search for it begins."""
    return offsets.select("group", "shard_id", "offset", routing.slot_name(F.col("group")).alias("stored_name"), routing.slot(F.col("group")).alias("slot"))


def lag(heads: DataFrame, offsets: DataFrame, groups: list[str]) -> DataFrame:
    """group, shard_id, durable_entry, offset, lag for each of the groups' names and each shard; a missing offset is 0."""
    every = heads.select("shard_id", "durable_entry", F.explode(F.array(*map(F.lit, groups))).alias("group"))
    at = F.coalesce("offset", F.lit(0))
    return every.join(offsets, ["group", "shard_id"], "left").select("group", "shard_id", "durable_entry", at.alias("offset"), (F.col("durable_entry") - at).alias("lag"))


def ack_gaps(acks: DataFrame) -> DataFrame:
    """Acks whose entry is not the one after the ack before it (by seq)."""
    w = Window.partitionBy("group", "shard_id").orderBy("seq")
    before = F.lag("entry_number").over(w)
    return acks.withColumn("previous", before).where("entry_number > coalesce(previous, -1) + 1")


def progress(acks: DataFrame) -> DataFrame:
    """acks with the offset after each of them: a running maximum."""
    w = Window.partitionBy("group", "shard_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return acks.withColumn("offset", F.max(F.col("entry_number") + 1).over(w))


def filter_duplicates(messages: DataFrame, processed: DataFrame) -> DataFrame:
    return messages.join(processed.select("shard_id", "entry_number").distinct(), ["shard_id", "entry_number"], "left_anti")


def evict(processed: DataFrame, offsets: DataFrame, group: str, margin: int = 100) -> DataFrame:
    """What stays of a group's processed ids: those at or above its offset less the margin."""
    own = offsets.where(F.col("group") == group).select("shard_id", "offset")
    return processed.join(own, "shard_id", "left").where(F.col("entry_number") >= F.coalesce("offset", F.lit(0)) - margin).drop("offset")
