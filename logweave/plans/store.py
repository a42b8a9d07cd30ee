"""The synthetic events as a log on disk: built once for a session and a table, read by every query.

The folder has what a log keeps: entries by shard, sorted by number, with their segment and place in it; heads; the manifest.
Tail and point reads then skip shards and row groups, and heads and manifests are tables of some rows.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import routing
from logweave.operators import append, segments

SHARDS = 16
_OWN = "/tmp/checkpoints/logweave-log"
_built: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the one that all executors share; without one, on one machine, a local folder that goes at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    name = f"{what}-{uuid.uuid4().hex}"
    if base:
        return f"{base.rstrip('/')}/logweave/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    atexit.register(shutil.rmtree, f"{_OWN}/{name}", ignore_errors=True)
    return f"file://{_OWN}/{name}"


def routed(spark: SparkSession, d: str) -> DataFrame:
    """The events as records to append: key, shard, payload, size."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    payload = F.concat_ws(":", "event_type", "props")
    return events.select("event_id", "ts", "user_id", "event_type", "value", routing.pick_shard(F.col("user_id").cast("string"), SHARDS).alias("shard_id"), payload.alias("payload"), append.stored_size(payload).alias("stored_size"))


def _build(spark: SparkSession, d: str) -> str:
    folder = shared_dir(spark, "log")
    numbered = append.number_entries(routed(spark, d))
    columns = tuple(c for c in numbered.columns)
    whole = segments.assign_segments(numbered, columns=columns)
    whole.write.partitionBy("shard_id").parquet(f"{folder}/entries")
    entries = spark.read.schema(whole.schema).parquet(f"{folder}/entries")
    segments.manifest(entries).coalesce(1).write.parquet(f"{folder}/manifest")
    append.heads(entries).coalesce(1).write.parquet(f"{folder}/heads")
    return folder


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        _built[key] = _build(spark, d)
    return spark.read.parquet(f"{_built[key]}/{name}")
