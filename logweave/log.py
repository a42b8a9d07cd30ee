"""A log as tables in one folder, with the operators as methods.

    entries/batch=K/shard_id=S   rows of the K-th append: entry_number, ts, key, payload
    heads/batch=K                next_entry of the shards that this append touched; its presence commits the append
    offsets/version=K            all groups' offsets after the K-th change
    metrics/batch=K              what the K-th append wrote, observed while it did

Entries are written before heads, and reads end at the heads, so a half-done append is invisible; done again it has the same
number and overwrites itself. One process appends at a time; a log shared by several gives each its own shards and folder.
Heads and offsets have a row for each shard and group; entries are never collected. ``compacted`` makes one append of many.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.functions import routing
from logweave.logs import logger
from logweave.operators import append, browse, offsets
from logweave.streaming import process as loop

ENTRIES = "entry_number long, ts timestamp, key string, payload string, batch int, shard_id int"
HEADS = "shard_id int, next_entry long, batch int"
OFFSETS = "`group` string, shard_id int, offset long, version int"
METRICS = "entries long, bytes long, compressed long, skipped long, seconds double, batch int"


class EventLog:
    def __init__(self, spark: SparkSession, folder: str, shards: int = routing.DEFAULT_SHARDS, process: int = 0, processes: int = 1):
        self.spark, self.folder, self.shards, self.process, self.processes = spark, folder.rstrip("/"), shards or routing.DEFAULT_SHARDS, process, processes
        for table, part, schema in (("entries", "batch", ENTRIES), ("heads", "batch", HEADS), ("offsets", "version", OFFSETS), ("metrics", "batch", METRICS)):
            spark.createDataFrame([], schema).drop(part).write.mode("ignore").parquet(f"{self.folder}/{table}/{part}=0", partitionBy="shard_id" if table == "entries" else None)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _last(self, name: str, schema: str, part: str) -> int:
        return self._table(name, schema).agg(F.max(part)).first()[0] or 0

    def streams(self, prefix: str) -> DataFrame:
        return self.spark.range(self.shards).select(routing.stream_name(prefix, F.col("id")).alias("stream"))

    def append(self, rows: DataFrame, key: str, payload: str, seq: str, ts: Column | None = None) -> DataFrame:
        """Rows are routed by key (null: as the empty one) and numbered in the order of seq, an integer. Returns message ids by seq.

        A row without a seq is an error, so no row is lost.
        """
        number = self._last("heads", HEADS, "batch") + 1
        shard = routing.pick_owned_shard(F.col(key), self.shards, self.process, self.processes) if self.processes > 1 else routing.pick_shard(F.col(key), self.shards)
        routed = rows.select(F.col(seq).alias("seq"), (F.current_timestamp() if ts is None else ts).cast("timestamp").alias("ts"), F.col(key).cast("string").alias("key"), F.col(payload).cast("string").alias("payload"), shard.alias("shard_id"))
        seen, began, size = Observation(), time.monotonic(), F.octet_length("payload")
        routed = append.number_entries(routed, "seq", base=self.heads()).observe(
            seen, F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(append.stored_size(F.coalesce("payload", F.lit("")))), F.lit(0)).alias("bytes"),
            F.coalesce(F.sum((size >= append.MIN_COMPRESS).cast("long")), F.lit(0)).alias("compressed"),
        )
        routed.write.mode("overwrite").partitionBy("shard_id").parquet(f"{self.folder}/entries/batch={number}")
        got = seen.get
        row = [(got["entries"], got["bytes"], got["compressed"], got["entries"] - got["compressed"], time.monotonic() - began)]
        self.spark.createDataFrame(row, METRICS.rpartition(",")[0]).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/metrics/batch={number}")
        written = self.spark.read.schema("seq long, entry_number long, shard_id int").parquet(f"{self.folder}/entries/batch={number}")
        written.groupBy("shard_id").agg((F.max("entry_number") + 1).alias("next_entry")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/heads/batch={number}")
        logger().debug("append %d: %s entries in %.3f s", number, got["entries"], row[0][4])
        return written.select("seq", routing.message_id(F.col("shard_id"), F.col("entry_number")).alias("message_id"))

    def heads(self) -> DataFrame:
        """shard_id, next_entry, durable_entry of every shard with an entry; what is written is durable."""
        rows = self._table("heads", HEADS).groupBy("shard_id").agg(F.max("next_entry").alias("next_entry"))
        return rows.withColumn("durable_entry", F.col("next_entry"))

    def length(self, shard: int) -> int:
        """A shard without an entry is an error: reads never create one."""
        n = self.heads().where(F.col("shard_id") == shard).agg(F.max("next_entry")).first()[0]
        if n is None:
            raise KeyError(f"shard {shard} not found")
        return n

    def discover(self, pattern: str, consumer: int = 0, consumers: int = 1) -> list[int]:
        return [r.shard_id for r in browse.discover(pattern, self.heads(), consumer, consumers).collect()]

    def metrics(self) -> DataFrame:
        return self._table("metrics", METRICS).where("batch > 0")

    def entries(self) -> DataFrame:
        return self._table("entries", ENTRIES)

    def list_recent(self, limit: int) -> DataFrame:
        return browse.list_recent(self.entries(), self.heads(), limit)

    def scan(self, stop_after: int | None = None) -> DataFrame:
        return browse.scan(self.entries(), self.heads(), stop_after)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        return browse.point_lookup(self.scan(), wanted)

    def scan_each(self, shard: int, callback: Callable, batch: int = 10_000) -> int:
        """Calls back with each entry of a shard in order, until it gives False."""
        self.length(shard)
        return browse.scan_each(self.entries(), self.heads(), shard, callback, batch)

    def read(self, group: str, count: int) -> DataFrame:
        return browse.read(self.entries(), self.heads(), self.offsets(), group, count)

    def stream(self) -> DataFrame:
        """Entries as files of them come, for ``streaming.process``; at least once, as a repeated append comes again, and also
        those of an append that isn't committed yet. ``consume`` ends at the heads."""
        return self.spark.readStream.schema(ENTRIES).parquet(f"{self.folder}/entries")

    def offsets(self) -> DataFrame:
        last = self._last("offsets", OFFSETS, "version")
        return self._table("offsets", OFFSETS).where((F.col("version") == last) & F.col("group").isNotNull()).drop("version")

    def _set(self, new: DataFrame) -> None:
        number = self._last("offsets", OFFSETS, "version") + 1
        mark = self.spark.createDataFrame([(None, None, None)], "`group` string, shard_id int, offset long")  # a version may hold no offset at all
        new.select("group", "shard_id", "offset").unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/offsets/version={number}")

    def ack(self, acks: DataFrame) -> None:
        """acks (group, shard_id, entry_number): cumulative, never backwards, at most to the head."""
        self._set(offsets.ack(acks, self.heads(), self.offsets()))

    def ack_range(self, ranges: DataFrame, read: DataFrame) -> DataFrame:
        """ranges (group, shard_id, from_entry, to_entry); read: what has been read (group, shard_id, entry_number). What was accepted, and why not."""
        done = offsets.ack_range(ranges, browse.highest_read(read), self.offsets())
        rows = self.spark.createDataFrame(done.collect(), done.schema)  # a row for each range; the table it was computed from changes now
        self._set(offsets.upsert(self.offsets(), rows.where("accepted").groupBy("group", "shard_id").agg(F.max("offset").alias("offset"))))
        return rows

    def consume(self, group: str, handler: Callable[[DataFrame, int], None], options: loop.Options | None = None, once: bool = True) -> StreamingQuery:
        """The consume loop: from the group's offsets up to the heads, and on as appends commit. With ``once`` it ends there.

        The stream is the table of heads, which each commit adds to; a batch's entries are the ranges between offsets and heads,
        so shards that appear later come too. Offsets are the log's own: ``lag``, ``ack`` and ``reset`` see them, and a new loop
        goes on where they stand. They move after the handler has returned: delivery is at least once.
        """
        own = loop.replace(options or loop.Options(), group=group)
        name, ended, calls = f"consume-{uuid.uuid4().hex}", [], [0]

        def ranges() -> DataFrame:
            at = self.offsets().where(F.col("group") == group).select("shard_id", F.col("offset").alias("low"))
            mine = self.heads().where(routing.owns(F.col("shard_id"), own.consumer, own.consumers))
            if own.shards:
                mine = mine.where(F.col("shard_id").isin(*own.shards))
            every = mine.join(at, "shard_id", "left").select("shard_id", F.coalesce("low", F.lit(0)).cast("long").alias("low"), F.col("durable_entry").alias("high"))
            return browse.quota(every, own.batch_size) if own.batch_size else every

        def batch(df: DataFrame, number: int) -> None:
            while not ended:
                began = time.monotonic()
                wanted = [(r.shard_id, r.low, r.high) for r in ranges().where("low < high").collect()]  # a row for each shard
                if not wanted:
                    return
                calls[0] += 1
                todo = self.spark.createDataFrame(wanted, "shard_id int, low long, high long")
                if loop.attempts(handler, browse.between(self.entries(), todo), calls[0], own):
                    ended.append(True)
                if own.auto_ack:
                    done = todo.select(F.lit(group).alias("group"), "shard_id", (F.col("high") - 1).alias("entry_number"))
                    self.ack(done)
                if own.on_batch:
                    own.on_batch(sum(high - low for _, low, high in wanted), time.monotonic() - began)
                if not own.auto_ack:
                    return  # the handler's acks decide what comes next
            loop.stop_later(self.spark, name)

        commits = self.spark.readStream.schema(HEADS).parquet(f"{self.folder}/heads")
        writer = commits.writeStream.queryName(name).option("checkpointLocation", f"{self.folder}/loops/{name}").foreachBatch(batch)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(int(own.poll_s * 1000), 1)} milliseconds")).start()

    def compacted(self, folder: str) -> EventLog:
        """The same log in another folder: all committed entries as one append, heads and offsets as they are."""
        new = EventLog(self.spark, folder, self.shards, self.process, self.processes)
        self.scan().drop("batch").repartition("shard_id").sortWithinPartitions("shard_id", "entry_number").write.mode("overwrite").partitionBy("shard_id").parquet(f"{new.folder}/entries/batch=1")
        new._set(self.offsets())
        self.heads().select("shard_id", "next_entry").coalesce(1).write.mode("overwrite").parquet(f"{new.folder}/heads/batch=1")
        return new

    def reset(self, resets: DataFrame) -> None:
        """resets (group, shard_id, to): absolute, or from the head for negative numbers."""
        self._set(offsets.upsert(self.offsets(), offsets.reset(resets, self.heads())))

    def forget(self, group: str) -> None:
        self._set(self.offsets().where(F.col("group") != group))

    def lag(self, groups: list[str]) -> DataFrame:
        return offsets.lag(self.heads(), self.offsets(), groups)
