"""The consume loop as a Structured Streaming query: batches, retries, acknowledgement, duplicates.

A batch is acknowledged after its handler has returned, so delivery is at least once; offsets are a table of (group,
shard_id, offset) that a batch writes under its own number, so a repeated batch writes the same.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.functions.routing import owns
from logweave.logs import logger


class StopProcessing(Exception):
    """Raised by a handler: the batch counts as done, is acknowledged, and the loop ends without another call."""


@dataclass(frozen=True)
class Options:
    group: str = "default"
    max_retries: int = 3
    retry_delay_s: float = 1.0
    auto_ack: bool = True
    consumer: int = 0
    consumers: int = 1
    shards: tuple[int, ...] = ()
    on_error: Callable[[Exception, int], None] | None = None
    on_batch: Callable[[int, float], None] | None = None
    #: Entries of a call at most, over all shards; 0: all that are there. For the log's own loop, as its poll interval.
    batch_size: int = 0
    poll_s: float = 0.1


def attempts(handler: Callable[[DataFrame, int], None], df: DataFrame, number: int, options: Options) -> bool:
    """Calls the handler until it returns, up to max_retries times more; whether it wants to stop. The last failure is raised."""
    for attempt in range(options.max_retries + 1):
        try:
            handler(df, number)
            return False
        except StopProcessing:
            return True
        except Exception as e:
            logger().warning("batch %d of group %s failed (attempt %d): %s", number, options.group, attempt, e)
            if options.on_error:
                options.on_error(e, attempt)
            if attempt == options.max_retries:
                raise
            time.sleep(options.retry_delay_s * (attempt + 1))
    return False


def stop_later(spark, name: str) -> None:
    """Ends the active query of that name; a batch can't wait for its own end, so another thread does."""
    threading.Thread(target=lambda: [q.stop() for q in spark.streams.active if q.name == name], daemon=True).start()


def process(stream: DataFrame, handler: Callable[[DataFrame, int], None], folder: str, options: Options = Options(), once: bool = True) -> StreamingQuery:
    """Starts the loop over a stream with shard_id and entry_number. The handler gets each batch and its number.

    A handler that fails is called again up to max_retries times, after retry_delay_s times the number of the attempt; then
    the query fails and, started again, gives the same batch. With ``once`` it ends when the input is used up. A stream of a
    log that goes on from its group's offset is ``EventLog.consume``.
    """
    mine = stream.where(owns(F.col("shard_id"), options.consumer, options.consumers))
    if options.shards:
        mine = mine.where(F.col("shard_id").isin(*options.shards))

    name, ended = f"process-{uuid.uuid4().hex}", threading.Event()

    def batch(df: DataFrame, number: int) -> None:
        if ended.is_set():
            raise StopProcessing("ended")  # what comes after the end isn't done, and comes again when the loop is started anew
        began = time.monotonic()
        df.persist()
        try:
            stop = attempts(handler, df, number, options)
            if options.auto_ack:
                acked = df.groupBy("shard_id").agg((F.max("entry_number") + 1).alias("offset")).withColumn("group", F.lit(options.group))
                acked.write.mode("overwrite").parquet(f"{folder}/offsets/batch={number}")
            if options.on_batch:
                options.on_batch(df.count(), time.monotonic() - began)
            if stop:
                ended.set()
                stop_later(df.sparkSession, name)
        finally:
            df.unpersist()

    writer = mine.writeStream.queryName(name).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="100 milliseconds")).start()


def offsets(spark, folder: str) -> DataFrame:
    """The group's offsets after all acknowledged batches."""
    rows = spark.read.schema("shard_id int, offset long, group string, batch long").parquet(f"{folder}/offsets")
    return rows.groupBy("group", "shard_id").agg(F.max("offset").alias("offset"))


def distinct(stream: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each (shard_id, entry_number) once; with an event time, state goes once the watermark has passed."""
    keys = ["shard_id", "entry_number"]
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys) if event_time else stream.dropDuplicates(keys)
