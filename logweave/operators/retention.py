"""Retention planning over segments: which ones go, by age, size and consumers' progress.

Segments are manifests' rows (one for each file), not log rows. Each rule adds a boolean; the current segment never goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _age_s(now) -> Column:
    return F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("end_time").cast("timestamp"))


def by_age(segments: DataFrame, now, max_age_s: int, force_after_s: int = 0) -> DataFrame:
    """segments with ``old`` (older than max_age_s) and ``forced`` (past force_after_s, for it and all later ones of its shard)."""
    past = (_age_s(now) > force_after_s) & ~F.col("is_current") if force_after_s else F.lit(False)
    w = Window.partitionBy("shard_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0)
    old = (_age_s(now) > max_age_s) & ~F.col("is_current") if max_age_s else F.lit(False)
    return segments.withColumn("forced", F.max(past).over(w)).withColumn("old", (old | past))


def protect(segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """segments with ``protected``: its last entry has not been passed by the slowest group; without groups none is."""
    least = offsets.groupBy("shard_id").agg(F.min("offset").alias("__least"))
    last = F.col("start_entry") + F.col("entries") - 1
    return segments.join(least, "shard_id", "left").withColumn("protected", F.coalesce(last >= F.col("__least"), F.lit(False))).drop("__least")


def guard_readers(segments: DataFrame, candidate: str, active_readers: int) -> DataFrame:
    """segments with ``goes``: while there are readers, a shard's first and last file stay."""
    ends = F.lit(False)
    if active_readers > 0:
        w = Window.partitionBy("shard_id")
        ends = F.col("segment_id").isin(F.min("segment_id").over(w), F.max("segment_id").over(w))
    return segments.withColumn("goes", F.col(candidate) & ~ends)


def keep_least(segments: DataFrame, candidate: str, least: int) -> DataFrame:
    """segments with ``goes``: of a shard's candidates, oldest first, as many as leave ``least`` files besides the current one."""
    rank = F.sum(F.col(candidate).cast("int")).over(Window.partitionBy("shard_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0))
    others = F.sum((~F.col("is_current")).cast("int")).over(Window.partitionBy("shard_id"))
    return segments.withColumn("goes", F.col(candidate) & (rank <= F.greatest(others - least, F.lit(0))))


def by_shard_size(segments: DataFrame, most: int, least: int = 0, gone: str | None = None) -> DataFrame:
    """segments with ``goes``: oldest first by end time while the shard is larger than ``most`` bytes and ``least`` files, the
    current one among them, are left.

    gone: a boolean column of files that go already. They leave the order and the count; the size to bring down is still that
    of all files, theirs included, as one pass measures it at its begin.
    """
    before_it = F.col(gone) if gone else F.lit(False)
    files = segments.withColumn("__gone", before_it).withColumn("__size", F.when(F.col("is_current") | F.col("__gone"), 0).otherwise(F.col("bytes")))
    w = Window.partitionBy("shard_id").orderBy("end_time", "segment_id")
    before = F.coalesce(F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("shard_id")
    place = F.sum((~F.col("__gone")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = F.sum((~F.col("__gone")).cast("int")).over(whole)
    goes = ~F.col("is_current") & ~F.col("__gone") & (F.sum("bytes").over(whole) - before > most) & (place <= kept - least)
    return files.withColumn("goes", goes).drop("__size", "__gone")


def by_total_size(segments: DataFrame, most: int) -> DataFrame:
    """segments with ``goes``: oldest first over all shards while all files together are larger than ``most`` bytes.

    The order over all files is a running sum in two steps: by second of the end time, then within it, so no task sees
    all files; only the sums of the seconds meet.
    """
    second = F.unix_timestamp(F.col("end_time").cast("timestamp"))
    files = segments.withColumn("__second", second).withColumn("__size", F.when(F.col("is_current"), 0).otherwise(F.col("bytes")))
    sums = files.groupBy("__second").agg(F.sum("__size").alias("__sum"), F.sum("bytes").alias("__bytes"))
    by_second = Window.orderBy("__second")
    earlier = sums.select(
        "__second",
        F.coalesce(F.sum("__sum").over(by_second.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"),
        F.sum("__bytes").over(by_second.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    within = Window.partitionBy("__second").orderBy("end_time", "shard_id", "segment_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("__within", F.coalesce(F.sum("__size").over(within), F.lit(0))).join(earlier, "__second")
    goes = ~F.col("is_current") & (F.col("__total") - F.col("__earlier") - F.col("__within") > most)
    return placed.withColumn("goes", goes).drop("__second", "__size", "__within", "__earlier", "__total")


@dataclass(frozen=True)
class Rules:
    """Limits of a pass; 0 switches one off. Times in seconds, sizes in bytes."""

    max_age_s: int = 0
    force_after_s: int = 0
    protect_unconsumed: bool = True
    min_files: int = 0
    max_shard_size: int = 0
    max_total_size: int = 0


def plan(segments: DataFrame, offsets: DataFrame, now, rules: Rules, active_readers: int = 0) -> DataFrame:
    """One retention pass: segments with ``reason`` (age, shard size, total size; null: the file stays) and ``goes``.

    In each shard first by age: old and forced files, but with readers not the first and the last; protected ones not before
    the first forced file of the shard; and never more than leave ``min_files`` besides the current one. Then by the shard's
    size what is left, and then, over all shards, by the size of what is left there. The current file never goes.
    """
    own = by_age(segments, now, rules.max_age_s, rules.force_after_s)
    own = guard_readers(own, "old", active_readers).withColumnRenamed("goes", "__free")
    own = protect(own, offsets) if rules.protect_unconsumed else own.withColumn("protected", F.lit(False))
    own = own.withColumn("__free", F.col("__free") & (~F.col("protected") | F.col("forced")))
    own = keep_least(own, "__free", rules.min_files).withColumnRenamed("goes", "__aged")
    own = by_shard_size(own, rules.max_shard_size, rules.min_files, "__aged").withColumnRenamed("goes", "__sized") if rules.max_shard_size else own.withColumn("__sized", F.lit(False))
    if rules.max_total_size:
        left = by_total_size(own.where("not (__aged or __sized)").select("shard_id", "segment_id", "bytes", "end_time", "is_current"), rules.max_total_size)
        own = own.join(left.where("goes").select("shard_id", "segment_id", F.lit(True).alias("__total")), ["shard_id", "segment_id"], "left")
    else:
        own = own.withColumn("__total", F.lit(None).cast("boolean"))
    reason = F.when(F.col("__aged"), "age").when(F.col("__sized"), "shard size").when(F.col("__total"), "total size")
    return own.withColumn("reason", reason).withColumn("goes", reason.isNotNull()).drop("__free", "__aged", "__sized", "__total", "old")


def metrics(planned: DataFrame) -> DataFrame:
    """Per shard what a pass does: files and entries that go, bytes reclaimed, candidates that a group protected, oldest time left."""
    goes = F.col("goes")
    return planned.groupBy("shard_id").agg(
        F.count_if(goes).alias("files_deleted"), F.coalesce(F.sum(F.when(goes, F.col("entries"))), F.lit(0)).alias("entries_deleted"), F.coalesce(F.sum(F.when(goes, F.col("bytes"))), F.lit(0)).alias("bytes_reclaimed"),
        F.min(F.when(~goes, F.col("start_time"))).alias("oldest_entry"),
    )


def prune_nodes(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The sparse index after files have gone: of their shards only the nodes below the first entry that went."""
    first = gone.groupBy("shard_id").agg(F.min("start_entry").alias("__first"))
    return index.join(first, "shard_id", "left").where("__first is null or entry_number < __first").drop("__first")


def apply(segments: DataFrame, gone: DataFrame) -> DataFrame:
    """The manifest without the segments that go."""
    return segments.join(gone.select("shard_id", "segment_id"), ["shard_id", "segment_id"], "left_anti")
