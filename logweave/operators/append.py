"""Appending: gap-free numbers within each shard, sizes, compression classes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER, MIN_COMPRESS = 12, 4096
#: Records of one shard that are numbered by one task.
CHUNK = 1 << 20


def number_entries(df: DataFrame, seq: str = "event_id", shard: str = "shard_id", base: DataFrame | None = None) -> DataFrame:
    """df with entry_number: 0, 1, ... in the order of seq within each shard, from base (shard, next_entry) on where given.

    A shard may hold any share of the rows: it is numbered in chunks of its sequence, each by a task of its own, and the
    chunks' counts, one row each, give every chunk its first number. Every row gets a number: a null seq or shard is an error,
    as a record without a place can't be appended; of equal seqs the order is that of the other columns' hash.
    """
    lost = F.col(seq).isNull() | F.col(shard).isNull()
    place = F.when(lost, F.raise_error(F.lit(f"a record without {seq} or {shard}")).cast("long")).otherwise(F.col(seq).cast("long"))
    rows = df.withColumn("__seq", place).withColumn("__chunk", F.expr(f"__seq div {CHUNK} - cast(__seq < 0 and __seq % {CHUNK} <> 0 as bigint)"))
    counts = rows.groupBy(shard, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    tie = F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t))
    local = F.row_number().over(Window.partitionBy(shard, "__chunk").orderBy("__seq", tie)) - 1
    out = rows.withColumn("__local", local).join(first, [shard, "__chunk"])
    number = F.col("__first") + F.col("__local")
    if base is not None:
        out = out.join(base.select(shard, F.col("next_entry").alias("__next")), shard, "left")
        number = number + F.coalesce("__next", F.lit(0))
    return out.withColumn("entry_number", number.cast("long")).drop("__seq", "__chunk", "__local", "__first", "__next")


def _marks(every_s: float, every_entries: int):
    """Appends come by shard and seq; what a task keeps are the last checkpoint's time and the entries since."""

    def mark(batches):
        shard, since, entries = None, 0.0, 0
        for b in batches:
            out = []
            for s, at, n in zip(b["shard_id"].to_pylist(), b["at_s"].to_pylist(), b["entries"].to_pylist(), strict=True):
                if s != shard:
                    shard, since, entries = s, at, 0
                entries += n
                due = at - since > every_s or entries >= every_entries
                if due:
                    since, entries = at, 0
                out.append((due, entries))
            yield pa.record_batch([*b.columns, pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.int64())], names=[*b.schema.names, "checkpoint", "unsaved"])

    return mark


def checkpoints(appends: DataFrame, every_s: float, every_entries: int) -> DataFrame:
    """appends (shard_id, seq, at_s, entries) with ``checkpoint``: whether the manifest is saved after it, and the entries that are unsaved then.

    It is saved when more than every_s seconds have gone by since it last was (or since the shard's first append), or when so
    many entries have come since. A fold in order, as segments are cut.
    """
    rows = appends.select("shard_id", F.col("seq").cast("long").alias("seq"), F.col("at_s").cast("double").alias("at_s"), F.col("entries").cast("long").alias("entries"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", checkpoint boolean, unsaved long"
    return rows.repartition("shard_id").sortWithinPartitions("shard_id", "seq").mapInArrow(_marks(every_s, every_entries), schema)


def write_requests(log: DataFrame, least: int = MIN_COMPRESS) -> DataFrame:
    """What each append writes: log (shard_id, batch_id, entry_number, payload) -> entries, bytes, first and last number, compressed and skipped entries."""
    size = F.octet_length("payload")
    return log.groupBy("shard_id", "batch_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(stored_size(F.col("payload"))).alias("bytes"), F.min("entry_number").alias("first_entry"), F.max("entry_number").alias("last_entry"),
        F.count_if(size >= least).alias("compressed"), F.count_if(size < least).alias("skipped"),
    )


def stored_size(payload: Column) -> Column:
    return (F.lit(HEADER) + F.octet_length(payload)).cast("long")


def compress_class(payload: Column, least: int = MIN_COMPRESS) -> Column:
    return F.when(F.octet_length(payload) >= least, "compressed").otherwise("skipped")


def heads(log: DataFrame, unsynced: int = 0) -> DataFrame:
    """shard_id, next_entry (assigned) and durable_entry (what consumers may read; unsynced entries are not)."""
    n = F.max("entry_number") + 1
    return log.groupBy("shard_id").agg(n.alias("next_entry"), F.greatest(n - unsynced, F.lit(0)).alias("durable_entry"))
