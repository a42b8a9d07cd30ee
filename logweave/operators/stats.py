"""Statistics of shards, clients and groups; health rules. "Now" and elapsed times are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 512
#: Fixed values of the health rules.
MOST_ERROR_RATE, MOST_LAG, IDLE_S, RECENT_ERROR_S = 1.0, 100_000, 300, 60


def shard_stats(segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per shard: retained entries, bytes, oldest and newest time, files, and its groups' offsets as a map."""
    files = segments.groupBy("shard_id").agg(
        F.sum("entries").alias("total_entries"), F.sum("bytes").alias("total_bytes"), F.min("start_time").alias("oldest"), F.max("end_time").alias("newest"), F.count(F.lit(1)).alias("files")
    )
    groups = offsets.groupBy("shard_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "offset")))).alias("consumer_offsets"))
    return files.join(groups, "shard_id", "left")


def client_stats(heads: DataFrame, segments: DataFrame, lags: DataFrame) -> DataFrame:
    """One row: assigned entries (also those of deleted files), bytes, files, greatest lag, lag sum, groups that lag."""
    own = heads.agg(F.sum("durable_entry").alias("total_entries"), F.count(F.lit(1)).alias("active_shards"))
    files = segments.agg(F.sum("bytes").alias("total_bytes"), F.count(F.lit(1)).alias("total_files"))
    behind = lags.agg(F.max("lag").alias("max_lag"), F.sum(F.greatest("lag", F.lit(0))).alias("lag_sum"), F.count_distinct(F.when(F.col("lag") > 0, F.col("group"))).alias("lagging_groups"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(own).join(one(files), "__one").join(one(behind), "__one").drop("__one")


def retention_stats(segments: DataFrame) -> DataFrame:
    """Per shard, and in a row with a null shard_id for all: bytes, files, oldest and newest time."""
    return segments.rollup("shard_id").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"), F.min("start_time").alias("oldest"), F.max("end_time").alias("newest"))


def diagnostics(metrics: DataFrame, lags: DataFrame) -> DataFrame:
    """metrics (shard_id, write_rate, error_rate, idle_s, error_age_s, rotate_failures) with reasons and is_healthy."""
    worst = lags.groupBy("shard_id").agg(F.max("lag").alias("max_lag"))
    reasons = F.array_compact(
        F.array(
            F.when((F.col("idle_s") > IDLE_S) & (F.col("write_rate") > 0), "no recent writes"),
            F.when(F.col("error_rate") > MOST_ERROR_RATE, "high error rate"),
            F.when(F.col("error_age_s") < RECENT_ERROR_S, "recent errors"),
            F.when(F.col("rotate_failures") > 0, "file rotation failures"),
            F.when(F.col("max_lag") > MOST_LAG, "consumer lag too high"),
        )
    )
    joined = metrics.join(worst, "shard_id", "left").withColumn("reasons", reasons)
    return joined.withColumn("is_healthy", F.size("reasons") == 0)


def unhealthy(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.where(~F.col("is_healthy"))


def last_batch_compression(sizes: DataFrame) -> DataFrame:
    """As ``compression``, of each shard's last batch alone. sizes: shard_id, batch_id, original, stored."""
    last = sizes.groupBy("shard_id", "batch_id").agg(F.sum("original").alias("original"), F.sum("stored").alias("stored")).groupBy("shard_id").agg(F.max_by(F.struct("original", "stored"), "batch_id").alias("b"))
    return compression(last.select("shard_id", "b.original", "b.stored"))


def health(errors: DataFrame, now) -> DataFrame:
    """One row: error count, age of the last one and the status. errors: (ts)."""
    out = errors.agg(F.count(F.lit(1)).alias("error_count"), F.max("ts").alias("last_error"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_error").cast("timestamp"))
    return out.withColumn("healthy", F.coalesce(age >= RECENT_ERROR_S, F.lit(True))).withColumn("status", F.when(F.col("healthy"), "healthy").otherwise("degraded"))


def compression(sizes: DataFrame) -> DataFrame:
    """Per shard, from original and stored payload sizes: saved basis points, written + saved over written, stored over original."""
    out = sizes.groupBy("shard_id").agg(F.sum("original").alias("original"), F.sum("stored").alias("stored"))
    over = lambda a, b, default: F.coalesce(F.try_divide(a, b), F.lit(default))
    return out.select(
        "shard_id", "original", "stored",
        F.floor(over((F.col("original") - F.col("stored")) * 10000, F.col("original"), 0.0)).cast("long").alias("saved_bp"),
        F.round(over(F.col("original"), F.col("stored"), 1.0), 6).alias("ratio"),
        F.round(over(F.col("stored"), F.col("original"), 1.0), 6).alias("stored_share"),
    )


def error_rates(counts: DataFrame) -> DataFrame:
    """counts (shard_id, errors, writes) with error_rate, 0 without writes."""
    return counts.withColumn("error_rate", F.round(F.coalesce(F.try_divide("errors", "writes"), F.lit(0.0)), 6))


def batch_metrics(batches: DataFrame) -> DataFrame:
    """batches (shard_id, batch_id, latency) -> entries, batches, last batch's size, least, greatest and mean latency (whole)."""
    each = batches.groupBy("shard_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("latency").alias("low"), F.max("latency").alias("high"), F.sum("latency").alias("total"))
    return each.groupBy("shard_id").agg(
        F.sum("n").alias("writes"), F.count(F.lit(1)).alias("batches"), F.max_by("n", "batch_id").alias("last_batch"),
        F.min("low").alias("min_latency"), F.max("high").alias("max_latency"), F.floor(F.sum("total") / F.sum("n")).cast("long").alias("avg_latency"),
    )


def slot_stats(offsets: DataFrame) -> DataFrame:
    return offsets.groupBy("shard_id").agg(F.count_distinct("group").alias("used")).withColumn("total", F.lit(SLOTS))


def group_stats(heads: DataFrame, segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per shard: head, files, and its groups in the order of their names, each with offset and lag."""
    files = segments.groupBy("shard_id").agg(F.count(F.lit(1)).alias("files"))
    own = offsets.join(heads.select("shard_id", "durable_entry"), "shard_id").withColumn("lag", F.col("durable_entry") - F.col("offset"))
    groups = own.groupBy("shard_id").agg(F.array_sort(F.collect_list(F.struct("group", "offset", "lag"))).alias("groups"))
    return heads.select("shard_id", "durable_entry").join(files, "shard_id", "left").join(groups, "shard_id", "left")


def client_rates(counters: DataFrame) -> DataFrame:
    """Rates of a client, from one row or more of counters since its start (uptime_s: the greatest counts).

    counters: bytes_written, writes, reads, write_errors, read_errors, compression_saves, latency_sum, latency_count, uptime_s.
    """
    total = counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes_written", "writes", "reads", "write_errors", "read_errors", "compression_saves", "latency_sum", "latency_count")), F.max("uptime_s").alias("uptime_s"))
    per_s = lambda c: F.round(F.coalesce(F.try_divide(c, F.col("uptime_s")), F.lit(0.0)), 6)
    return total.select(
        "bytes_written", "writes", "reads", (F.col("write_errors") + F.col("read_errors")).alias("errors"),
        per_s(F.col("bytes_written") / (1 << 20)).alias("write_mib_s"), per_s(F.col("writes")).alias("write_rate"), per_s(F.col("reads")).alias("read_rate"),
        per_s(F.col("write_errors") + F.col("read_errors")).alias("error_rate"),
        F.round(F.coalesce(F.try_divide(F.col("bytes_written") + F.col("compression_saves"), F.col("bytes_written")), F.lit(1.0)), 6).alias("compression_ratio"),
        F.coalesce(F.floor(F.try_divide("latency_sum", "latency_count")).cast("long"), F.lit(0)).alias("avg_latency"),
    )


def consumer_lags(lags: DataFrame) -> DataFrame:
    """Per group the sum of its lags over the shards where it lags; groups that lag nowhere have no row."""
    return lags.where("lag > 0").groupBy("group").agg(F.sum("lag").alias("lag"), F.max("lag").alias("max_lag"))


def shard_details(heads: DataFrame, segments: DataFrame, offsets: DataFrame, nodes: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Per shard: entries, write offset, files, groups, index nodes, and the details of files and groups as arrays; with states, those columns too."""
    files = segments.groupBy("shard_id").agg(
        F.max("end_offset").alias("bytes"), F.count(F.lit(1)).alias("files"),
        F.array_sort(F.collect_list(F.struct("segment_id", F.col("bytes").alias("size"), "entries", "start_entry", F.col("start_time").alias("created"), F.col("end_time").alias("modified")))).alias("file_details"),
    )
    own = offsets.join(heads.select("shard_id", "durable_entry"), "shard_id")
    groups = own.groupBy("shard_id").agg(F.count(F.lit(1)).alias("consumer_groups"), F.array_sort(F.collect_list(F.struct("group", "offset", (F.col("durable_entry") - F.col("offset")).alias("lag")))).alias("consumer_details"))
    index = nodes.groupBy("shard_id").agg(F.count(F.lit(1)).alias("index_nodes"))
    out = heads.select("shard_id", F.col("durable_entry").alias("entries")).join(files, "shard_id", "left").join(groups, "shard_id", "left").join(index, "shard_id", "left")
    out = out.fillna(0, ["bytes", "files", "consumer_groups", "index_nodes"])
    return out if states is None else out.join(states, "shard_id", "left")


def of_shard(details: DataFrame, shard: int):
    """The one row of a shard; a shard that isn't there is an error."""
    row = details.where(F.col("shard_id") == shard).first()
    if row is None:
        raise KeyError(f"shard {shard} not found")
    return row


def retention_report(segments: DataFrame, lags: DataFrame) -> DataFrame:
    """Per shard: size in bytes and GiB, files, times, and the groups that lag with their lags, as a map."""
    files = segments.groupBy("shard_id").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"), F.min("start_time").alias("oldest"), F.max("end_time").alias("newest"))
    behind = lags.where("lag > 0").groupBy("shard_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "lag")))).alias("consumer_lag"))
    return files.join(behind, "shard_id", "left").withColumn("gib", F.round(F.col("bytes") / (1 << 30), 9))
