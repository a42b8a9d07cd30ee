"""One query for each operator of the log, over the ``events`` table as its log.

Key: the user; 16 shards; order: event_id; payload: event type and properties; segments close at 4096 bytes.
Groups: fast (0.9 of a shard's entries), slow (0.25), new (no offset).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import routing
from logweave.operators import append, browse, offsets, recovery, retention, segments, stats
from logweave.plans import store
from logweave.plans.store import SHARDS

GROUPS, INTERVAL = ["fast", "slow", "new"], 100
Query = Callable[[SparkSession, str], DataFrame]


def log(spark: SparkSession, d: str) -> DataFrame:
    return store.table(spark, d, "entries").select("event_id", "ts", "user_id", "event_type", "value", "payload", "stored_size", "entry_number", "shard_id")


def heads(spark, d):
    return store.table(spark, d, "heads")


def group_offsets(spark, d):
    at = lambda name, share: F.struct(F.lit(name).alias("group"), F.floor(F.col("durable_entry") * share).cast("long").alias("offset"))
    return heads(spark, d).select("shard_id", F.explode(F.array(at("fast", 0.9), at("slow", 0.25))).alias("o")).select("o.group", "shard_id", "o.offset")


def acks(spark, d):
    """Clicks acknowledge their entry for the group of their user's parity, in the order of the events."""
    rows = log(spark, d).where("event_type = 'click'")
    return rows.select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("group"), "shard_id", "entry_number", F.col("event_id").alias("seq"))


def assigned(spark, d):
    return store.table(spark, d, "entries").select("shard_id", "entry_number", "ts", "stored_size", "segment_id", "offset_in_segment")


def files(spark, d):
    return store.table(spark, d, "manifest")


def now(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").agg(F.max("ts").cast("string")).first()[0]


def route_shard(spark, d):
    return store.routed(spark, d).select("event_id", routing.fnv1a(F.col("user_id").cast("string")).alias("hash"), "shard_id")


def stream_name(spark, d):
    return log(spark, d).select("event_id", routing.stream_name("events:v1", F.col("shard_id")).alias("stream"))


def parse_stream(spark, d):
    name = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("a:v1:shard:"), F.col("shard_id"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("bad:"), F.col("shard_id"))).otherwise(routing.stream_name("e", F.col("shard_id")))
    return log(spark, d).select("event_id", routing.parse_stream(name).alias("shard"))


def owned_shards(spark, d):
    return heads(spark, d).select("shard_id").where(routing.owns(F.col("shard_id"), 1, 3))


def route_owned(spark, d):
    return log(spark, d).select("event_id", routing.pick_owned_shard(F.col("user_id").cast("string"), SHARDS, 1, 3).alias("shard"))


def append_ids(spark, d):
    return append.number_entries(store.routed(spark, d).select("event_id", "shard_id")).select("event_id", "shard_id", "entry_number", routing.message_id(F.col("shard_id"), F.col("entry_number")).alias("message_id"))


def message_id_roundtrip(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("12x-7")).otherwise(routing.message_id(F.col("shard_id"), F.col("entry_number")))
    return log(spark, d).withColumn("id", routing.parse_message_id(text)).select("event_id", F.col("id.shard_id").alias("shard"), F.col("id.entry_number").alias("entry"))


def shard_len(spark, d):
    return heads(spark, d).select("shard_id", F.col("next_entry").alias("n"))


def durable_heads(spark, d):
    return append.heads(log(spark, d), unsynced=5)


def list_recent(spark, d):
    return browse.list_recent(log(spark, d), heads(spark, d), 10).select("shard_id", "entry_number", "event_id", "payload")


def scan_all(spark, d):
    return browse.scan(log(spark, d), durable_heads(spark, d)).select("shard_id", "entry_number", "event_id")


def scan_limit(spark, d):
    return browse.scan(log(spark, d), heads(spark, d), 10).select("shard_id", "entry_number", "event_id")


def point_lookup(spark, d):
    rows = log(spark, d)
    wanted = heads(spark, d).select("shard_id", F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("next_entry") / 2).cast("long"), F.col("next_entry"))).alias("entry_number"))
    return browse.point_lookup(rows, wanted).select("shard_id", "entry_number", "event_id", "payload")


def read_batch(spark, d):
    return browse.from_offsets(log(spark, d), heads(spark, d), group_offsets(spark, d), "fast", 20).select("shard_id", "entry_number", "event_id")


def read_from_offset(spark, d):
    rows = log(spark, d)
    first = heads(spark, d).select("shard_id", F.floor(F.col("next_entry") / 2).cast("long").alias("first_entry"))
    return browse.from_offsets(rows, heads(spark, d), group_offsets(spark, d), "slow", earliest=first).select("shard_id", "entry_number", "event_id")


def read_quota(spark, d):
    return browse.read(log(spark, d), heads(spark, d), group_offsets(spark, d), "fast", 100).select("shard_id", "entry_number", "event_id")


def discover_assign(spark, d):
    return log(spark, d).select("shard_id").distinct().withColumn("consumer", F.pmod("shard_id", F.lit(3)))


def assignment_coverage(spark, d):
    rows = log(spark, d).withColumn("consumer", F.pmod("shard_id", F.lit(2)))
    return rows.groupBy("consumer").agg(F.count_distinct("shard_id").alias("shards"), F.count(F.lit(1)).alias("messages"))


def ack_cumulative(spark, d):
    return offsets.ack(acks(spark, d), heads(spark, d), group_offsets(spark, d))


def _ranges(spark, d):
    own = group_offsets(spark, d)
    reads = own.where("group = 'fast'").select("group", "shard_id", (F.col("offset") - 1).alias("highest"))
    pick = F.col("shard_id") % 3
    ranges = own.select("group", "shard_id", F.when(pick == 0, 5).otherwise(0).cast("long").alias("from_entry"), F.when(pick == 0, 4).when(pick == 1, F.col("offset")).otherwise(F.floor(F.col("offset") / 2)).cast("long").alias("to_entry"))
    return ranges, reads, own


def ack_range(spark, d):
    return offsets.ack_range(*_ranges(spark, d))


def reset_offset_neg(spark, d):
    at = heads(spark, d)
    wanted = at.select(F.lit("fast").alias("group"), "shard_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (-10, -(10**9), 7, 10**9)))).alias("to"))
    return offsets.reset(wanted, at)


def offset_upsert(spark, d):
    own = group_offsets(spark, d)
    return offsets.upsert(own, own.where("group = 'slow' and shard_id < 8").withColumn("offset", F.col("offset") + 1))


def ack_gap(spark, d):
    return offsets.ack_gaps(acks(spark, d)).select("group", "shard_id", "entry_number", "previous")


def offset_progress(spark, d):
    return offsets.progress(acks(spark, d)).select("group", "shard_id", "seq", "offset")


def consumer_lag(spark, d):
    return offsets.lag(heads(spark, d), group_offsets(spark, d), GROUPS)


def lag_summary(spark, d):
    return consumer_lag(spark, d).groupBy("group").agg(F.sum("lag").alias("lag"), F.max("lag").alias("max_lag"))


def dedup_filter(spark, d):
    rows = log(spark, d).select("shard_id", "entry_number", "event_id")
    processed = log(spark, d).where("event_type = 'view'").select("shard_id", "entry_number")
    return offsets.filter_duplicates(rows, processed)


def dedup_evict(spark, d):
    rows = log(spark, d).select("shard_id", "entry_number")
    return offsets.evict(rows, group_offsets(spark, d), "fast")


def segment_assign(spark, d):
    return segments.assign_segments(log(spark, d)).select("shard_id", "entry_number", "segment_id")


def segment_assign_batches(spark, d):
    """Batches of 64 events lie whole in a segment."""
    rows = log(spark, d).withColumn("batch_id", F.expr("event_id div 64"))
    return segments.assign_segments(rows, batch="batch_id").select("shard_id", "entry_number", "segment_id", "offset_in_segment")


def byte_offsets(spark, d):
    return assigned(spark, d).select("shard_id", "entry_number", "offset_in_segment")


def segment_manifest(spark, d):
    return segments.manifest(assigned(spark, d))


def locate_entry(spark, d):
    return segments.locate(log(spark, d).select("shard_id", "entry_number"), files(spark, d))


def sparse_index(spark, d):
    return segments.sparse_index(assigned(spark, d), INTERVAL)


def asof_position(spark, d):
    own = assigned(spark, d)
    return segments.as_of(own.select("shard_id", "entry_number"), segments.sparse_index(own, INTERVAL))


def asof_pruned(spark, d):
    """The same in an index that has been thinned by halvings."""
    own = assigned(spark, d)
    nodes = segments.sparse_index(own, 10)
    thin = nodes.join(segments.prune_index(nodes, 5), ["shard_id", "entry_number"])
    return segments.as_of(own.select("shard_id", "entry_number"), thin)


def index_prune(spark, d):
    return segments.prune_index(segments.sparse_index(assigned(spark, d), 10), 5)


def compress_class(spark, d):
    kind = append.compress_class(F.col("payload"), 40)
    return log(spark, d).groupBy("shard_id", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))


def compress_ratio(spark, d):
    n = F.octet_length("payload").cast("long")
    return stats.compression(log(spark, d).select("shard_id", n.alias("original"), F.when(n >= 40, F.floor(n / 2)).otherwise(n).cast("long").alias("stored")))


def shard_stats(spark, d):
    out = stats.shard_stats(files(spark, d), group_offsets(spark, d))
    at = lambda g: F.element_at("consumer_offsets", g).alias(g)
    return out.select("shard_id", "total_entries", "total_bytes", "oldest", "newest", "files", at("fast"), at("slow"))


def client_stats(spark, d):
    return stats.client_stats(heads(spark, d), files(spark, d), consumer_lag(spark, d))


def retention_stats(spark, d):
    return stats.retention_stats(files(spark, d))


def _diagnosed(spark, d):
    rows, last = log(spark, d), now(spark, d)
    age = lambda c: F.unix_timestamp(F.lit(last).cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))
    error = F.col("event_type") == "error"
    metrics = rows.groupBy("shard_id").agg(
        F.lit(1.0).alias("write_rate"), (F.count(F.when(F.col("value") > 90, 1)) / 100.0).alias("error_rate"), age(F.max("ts")).alias("idle_s"),
        age(F.max(F.when(error, F.col("ts")))).alias("error_age_s"), (F.col("shard_id") % 4).alias("rotate_failures"),
    )
    return stats.diagnostics(metrics, consumer_lag(spark, d))


def shard_diagnostics(spark, d):
    return _diagnosed(spark, d).select("shard_id", F.array_join("reasons", "; ").alias("reasons"), "is_healthy")


def unhealthy_shards(spark, d):
    return stats.unhealthy(_diagnosed(spark, d)).select("shard_id")


def health(spark, d):
    return stats.health(log(spark, d).where("event_type = 'error'"), now(spark, d)).select("error_count", "healthy", "status")


def error_rate(spark, d):
    counts = log(spark, d).groupBy("shard_id").agg(F.count(F.when(F.col("value") > 90, 1)).alias("errors"), F.count(F.lit(1)).alias("writes"))
    return stats.error_rates(counts)


def batch_metrics(spark, d):
    return stats.batch_metrics(log(spark, d).select("shard_id", F.floor(F.col("event_id") / 64).alias("batch_id"), F.length("payload").cast("long").alias("latency")))


def group_stats(spark, d):
    rows = stats.group_stats(heads(spark, d), files(spark, d), group_offsets(spark, d)).withColumn("g", F.explode("groups"))
    return rows.select("shard_id", "durable_entry", "files", F.col("g.group").alias("group"), F.col("g.offset").alias("offset"), F.col("g.lag").alias("lag"))


def all_streams(spark, d):
    return spark.range(SHARDS).select(routing.stream_name("events:v1", F.col("id")).alias("stream"))


def slot_stats(spark, d):
    return stats.slot_stats(group_offsets(spark, d))


def retain_age(spark, d):
    return retention.by_age(files(spark, d), now(spark, d), 10 * 86400, 20 * 86400).select("shard_id", "segment_id", "old", "forced")


def retain_protect(spark, d):
    return retention.protect(files(spark, d), group_offsets(spark, d)).select("shard_id", "segment_id", "protected")


def retain_reader_guard(spark, d):
    return retention.guard_readers(retention.by_age(files(spark, d), now(spark, d), 10 * 86400), "old", 1).select("shard_id", "segment_id", "goes")


def retain_min_files(spark, d):
    old = retention.by_age(files(spark, d), now(spark, d), 10 * 86400)
    return retention.keep_least(old, "old", 2).select("shard_id", "segment_id", "goes")


def retain_shard_size(spark, d):
    return retention.by_shard_size(files(spark, d), 10_000, 1).select("shard_id", "segment_id", "goes")


_RULES = retention.Rules(max_age_s=10 * 86400, force_after_s=20 * 86400, min_files=2, max_shard_size=20_000, max_total_size=200_000)


def retain_pass(spark, d):
    return retention.plan(files(spark, d), group_offsets(spark, d), now(spark, d), _RULES, 1).select("shard_id", "segment_id", "reason", "goes")


def retain_metrics(spark, d):
    return retention.metrics(retention.plan(files(spark, d), group_offsets(spark, d), now(spark, d), _RULES, 1))


def retain_global_size(spark, d):
    return retention.by_total_size(files(spark, d), 200_000).select("shard_id", "segment_id", "goes")


def retain_apply(spark, d):
    own = files(spark, d)
    return retention.apply(own, retention.by_shard_size(own, 10_000, 1).where("goes")).select("shard_id", "segment_id", "start_entry", "entries")


def rebuild_index(spark, d):
    own = files(spark, d).select("shard_id", F.format_string("log-%016d.seg", "segment_id").alias("path"), "entries", "bytes")
    return recovery.rebuild(own)


def _state(spark, d):
    pick = F.col("shard_id") % 4
    return heads(spark, d).select("shard_id", F.when(pick == 0, 0).when(pick == 1, 999).otherwise(1).alias("version"), F.when(pick == 2, F.lit(1 << 41)).otherwise(F.col("next_entry") * 50).alias("write_offset"), (F.col("next_entry") - 1).alias("last_entry"))


def state_validate(spark, d):
    return recovery.validate(_state(spark, d))


def rebuild_needed(spark, d):
    own = heads(spark, d).withColumn("durable_entry", F.when(F.col("shard_id") % 3 == 0, 0).otherwise(F.col("durable_entry")))
    return recovery.needs_rebuild(own, _state(spark, d))


def _streamed(spark, d):
    """The log as a stream: written to the shared folder and read from there."""
    folder = store.shared_dir(spark, "stream")
    rows = log(spark, d).select("shard_id", "entry_number", "event_id", "ts")
    rows.write.parquet(f"{folder}/log")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/log"), folder


def stream_process(spark, d):
    from logweave.streaming import process as loop

    stream, folder = _streamed(spark, d)
    done = loop.process(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), folder, loop.Options(group="g"))
    done.awaitTermination()
    return loop.offsets(spark, folder)


def stream_dedup(spark, d):
    from logweave.streaming import process as loop

    stream, folder = _streamed(spark, d)
    twice = stream.unionByName(stream)
    query = loop.distinct(twice).writeStream.option("checkpointLocation", f"{folder}/dedup").trigger(availableNow=True).format("parquet").start(f"{folder}/distinct")
    query.awaitTermination()
    return spark.read.schema("shard_id int, entry_number long, event_id long, ts timestamp_ntz").parquet(f"{folder}/distinct").select("shard_id", "entry_number", "event_id")


def _event_log(spark, d):
    """The events appended to a log of their own."""
    from logweave.log import EventLog

    own = EventLog(spark, store.shared_dir(spark, "event-log"), SHARDS)
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", F.concat_ws(":", "event_type", "props").alias("payload"))
    own.append(rows, "user_id", "payload", "event_id", F.col("ts"))
    return own


def _consumed(spark, own, folder, run, stop=False, batch=0):
    """Runs the group's loop; each call's entries go to a folder, and with ``stop`` the first call ends it."""
    from logweave.streaming import process as loop

    def handler(df, n):
        df.select("shard_id", "entry_number").write.mode("overwrite").parquet(f"{folder}/run={run}/call={n}")
        if stop:
            raise loop.StopProcessing

    own.consume("g", handler, loop.Options(batch_size=batch)).awaitTermination()


def _delivered(spark, folder):
    return spark.read.schema("shard_id int, entry_number long, run int, call int").parquet(folder)


def process_resume(spark, d):
    """A loop that ends after its first 300 entries, and one that goes on from there."""
    own, folder = _event_log(spark, d), store.shared_dir(spark, "delivered")
    _consumed(spark, own, folder, 1, True, 300)
    _consumed(spark, own, folder, 2)
    return _delivered(spark, folder).select("shard_id", "entry_number", "run")


def process_reset(spark, d):
    """What comes again after the group was set back by ten entries in each shard."""
    own, folder = _event_log(spark, d), store.shared_dir(spark, "delivered")
    _consumed(spark, own, folder, 1)
    own.reset(own.heads().select(F.lit("g").alias("group"), "shard_id", F.lit(-10).cast("long").alias("to")))
    _consumed(spark, own, folder, 2)
    return _delivered(spark, folder).where("run = 2").select("shard_id", "entry_number")


def process_lag(spark, d):
    own, folder = _event_log(spark, d), store.shared_dir(spark, "delivered")
    _consumed(spark, own, folder, 1)
    return own.lag(["g", "other"])


def _binary(spark, d):
    """The log as segment files."""
    from logweave.sources import binary_log

    folder = store.shared_dir(spark, "segments")
    rows = log(spark, d).select("shard_id", "entry_number", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_nanos"), F.col("payload").cast("binary").alias("data"))
    binary_log.write_segments(rows, folder, compress_from=None).write.format("noop").mode("overwrite").save()
    return folder


def _file(path):
    return F.regexp_extract(path, r"(log-\d+\.seg)$", 1)


def binary_scan(spark, d):
    from logweave.sources import binary_log

    rows = binary_log.scan(spark, _binary(spark, d))
    return rows.select("shard_id", _file("path").alias("file"), "entry_in_file", "offset_in_segment", "ts_nanos", F.col("data").cast("string").alias("payload"), "stored_bytes")


def binary_read_at(spark, d):
    """The entry in the middle of each file, by its place."""
    from logweave.sources import binary_log

    folder = _binary(spark, d)
    places = binary_log.scan(spark, folder).groupBy("path").agg(F.array_sort(F.collect_list("offset_in_segment")).alias("all"))
    middle = places.select("path", F.get("all", F.floor(F.size("all") / 2).cast("int")).alias("offset_in_segment"))
    return binary_log.read_at(spark, folder, middle).select("shard_id", _file("path").alias("file"), "offset_in_segment", F.col("data").cast("string").alias("payload"))


def binary_rebuild(spark, d):
    from logweave.sources import binary_log

    files_ = binary_log.data_files(binary_log.scan(spark, _binary(spark, d)))
    return recovery.rebuild(files_).select("shard_id", _file("path").alias("path"), "entries", "bytes", "start_entry", "start_offset", "end_offset", "is_current")


def _manifest_files(spark, d):
    nanos = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) * 1000).alias(c.replace("time", "nanos"))
    return files(spark, d).select("shard_id", F.format_string("log-%016d.seg", "segment_id").alias("path"), "start_offset", "end_offset", "start_entry", "entries", nanos("start_time"), nanos("end_time"))


def manifest_roundtrip(spark, d):
    """Manifests written in their binary form and read back: each file with its shard's head, groups and nodes."""
    from logweave.sources import manifest

    folder = store.shared_dir(spark, "manifests")
    nodes = segments.sparse_index(assigned(spark, d), INTERVAL).select("shard_id", "entry_number", F.col("segment_id").alias("file_index"), F.col("offset_in_segment").alias("offset"))
    whole = manifest.assembled(heads(spark, d).select("shard_id", F.col("durable_entry").alias("head")), _manifest_files(spark, d), group_offsets(spark, d), nodes)
    manifest.write(whole, folder).write.format("noop").mode("overwrite").save()
    back = manifest.read(spark, folder)
    return back.select("shard_id", "head", "write_offset", F.aggregate("offsets", F.lit(0).cast("long"), lambda a, o: a + o["offset"]).alias("offsets"), F.size("nodes").alias("nodes"), F.explode("files").alias("f")).select("shard_id", "head", "write_offset", "offsets", "nodes", "f.*")


def recover_manifest(spark, d):
    """Last files that are gone, too short or too long, by the shard's number."""
    own = _manifest_files(spark, d)
    kind = F.col("shard_id") % 4
    size = F.col("end_offset") - F.col("start_offset")
    last = own.groupBy("shard_id").agg(F.max("path").alias("path"))
    found = own.join(last, ["shard_id", "path"]).where(kind != 0).select("shard_id", "path", F.when(kind == 1, F.floor(size / 2)).when(kind == 2, size + 100).otherwise(size).alias("size"), F.when(kind == 1, F.floor(F.col("entries") / 2)).when(kind == 2, F.col("entries") + 3).otherwise(F.col("entries")).alias("scanned"))
    at = heads(spark, d).select("shard_id", F.col("durable_entry").alias("head")).join(own.groupBy("shard_id").agg(F.max("end_offset").alias("write_offset")), "shard_id")
    return recovery.recover(own, at, found)


def recover_choose(spark, d):
    pick = F.col("shard_id") % 6
    shards = heads(spark, d).select(
        "shard_id", (pick > 1).alias("has_manifest"), F.when(pick == 2, "manifest too small").alias("error"), F.when(pick == 3, 0).otherwise(2).alias("manifest_files"),
        F.when(pick.isin(0, 4), 0).otherwise(2).alias("data_files"), F.when(pick == 0, -1).otherwise(7).alias("last_entry"),
    )
    return recovery.choose(shards).select("shard_id", "action")


def state_sync(spark, d):
    at = heads(spark, d).select("shard_id", F.col("durable_entry").alias("head"), (F.col("durable_entry") * 50).alias("write_offset"))
    return recovery.sync(_state(spark, d), at)


def _appends(spark, d):
    """Batches of 64 events: what each appends to a shard."""
    return log(spark, d).withColumn("batch_id", F.expr("event_id div 64"))


def checkpoint_marks(spark, d):
    rows = _appends(spark, d).groupBy("shard_id", F.col("batch_id").alias("seq")).agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at_s"), F.count(F.lit(1)).alias("entries"))
    return append.checkpoints(rows, 86400.0, 20).select("shard_id", "seq", "checkpoint", "unsaved")


def write_requests(spark, d):
    return append.write_requests(_appends(spark, d), 40)


def client_rates(spark, d):
    error = F.count_if(F.col("event_type") == "error")
    n = F.octet_length("payload")
    counters = log(spark, d).groupBy("shard_id").agg(
        F.sum(n).alias("bytes_written"), F.count(F.lit(1)).alias("writes"), F.count_if(F.col("event_type") == "view").alias("reads"), error.alias("write_errors"), F.lit(1).cast("long").alias("read_errors"),
        F.sum(F.when(n >= 40, n - F.floor(n / 2)).otherwise(0)).alias("compression_saves"), F.sum(F.length("payload")).alias("latency_sum"), F.count(F.lit(1)).alias("latency_count"), F.lit(3600).alias("uptime_s"),
    )
    return stats.client_rates(counters)


def consumer_lags(spark, d):
    return stats.consumer_lags(consumer_lag(spark, d))


def shard_details(spark, d):
    nodes = segments.sparse_index(assigned(spark, d), INTERVAL)
    out = stats.shard_details(heads(spark, d), files(spark, d), group_offsets(spark, d), nodes)
    lag = F.aggregate("consumer_details", F.lit(0).cast("long"), lambda a, g: a + g["lag"])
    return out.select("shard_id", F.col("entries").alias("head"), F.col("bytes").alias("write_offset"), "files", "consumer_groups", "index_nodes", lag.alias("lags"), F.explode("file_details").alias("f")).select("shard_id", "head", "write_offset", "files", "consumer_groups", "index_nodes", "lags", "f.*")


def retention_report(spark, d):
    out = stats.retention_report(files(spark, d), consumer_lag(spark, d))
    return out.select("shard_id", "bytes", "files", "oldest", "newest", "gib", F.element_at("consumer_lag", "fast").alias("fast"), F.element_at("consumer_lag", "new").alias("new"))


def last_batch_compression(spark, d):
    n = F.octet_length("payload").cast("long")
    return stats.last_batch_compression(_appends(spark, d).select("shard_id", "batch_id", n.alias("original"), F.when(n >= 40, F.floor(n / 2)).otherwise(n).cast("long").alias("stored")))


def offset_migrate(spark, d):
    """An older table has all groups at 7, and one more."""
    new = group_offsets(spark, d)
    old = heads(spark, d).select(F.explode(F.array(F.lit("fast"), F.lit("older"))).alias("group"), "shard_id", F.lit(7).cast("long").alias("offset"))
    return offsets.merge_legacy(old, new)


def group_slots(spark, d):
    long = group_offsets(spark, d).withColumn("group", F.concat("group", F.repeat(F.lit("x"), F.col("shard_id") * 8)))
    return offsets.slots(long).select("group", "shard_id", "stored_name", "slot")


def highest_read(spark, d):
    return browse.highest_read(acks(spark, d))


def pick_stream(spark, d):
    return store.routed(spark, d).select("event_id", routing.pick_stream("events:v1", F.col("user_id"), 0).alias("stream"))


def discover_shards(spark, d):
    return browse.discover("events:v1:shard:*", heads(spark, d), 1, 3)


#: Beyond the log's own operators.
def tumbling_counts(spark, d):
    return log(spark, d).groupBy("shard_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("shard_id", F.col("w.start").alias("start"), "n")


def sliding_counts(spark, d):
    return log(spark, d).groupBy("shard_id", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("shard_id", F.col("w.start").alias("start"), "n")


def session_counts(spark, d):
    return log(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start")).select("user_id", "start", "n")


_QUERIES: list[Query] = [
    route_shard, stream_name, parse_stream, owned_shards, route_owned, append_ids, message_id_roundtrip, shard_len, durable_heads, list_recent, scan_all, scan_limit, point_lookup,
    read_batch, read_from_offset, read_quota, discover_assign, assignment_coverage, ack_cumulative, ack_range, reset_offset_neg, offset_upsert, ack_gap, offset_progress,
    consumer_lag, lag_summary, dedup_filter, dedup_evict, segment_assign, segment_assign_batches, byte_offsets, segment_manifest, locate_entry, sparse_index, asof_position, asof_pruned, index_prune,
    compress_class, compress_ratio, shard_stats, client_stats, retention_stats, shard_diagnostics, unhealthy_shards, health, error_rate, batch_metrics, group_stats, all_streams, slot_stats,
    retain_age, retain_protect, retain_reader_guard, retain_min_files, retain_shard_size, retain_pass, retain_metrics, retain_global_size, retain_apply, rebuild_index, state_validate, rebuild_needed,
    stream_process, stream_dedup, process_resume, process_reset, process_lag, binary_scan, binary_read_at, binary_rebuild, manifest_roundtrip, recover_manifest, recover_choose, state_sync,
    checkpoint_marks, write_requests, client_rates, consumer_lags, shard_details, retention_report, last_batch_compression, offset_migrate, group_slots, highest_read, pick_stream, discover_shards, tumbling_counts, sliding_counts, session_counts,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}
