"""The log's tables through their methods, and settings."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from logweave.config import MIB, Settings, checked, for_shards, open_files, preset
from logweave.log import EventLog
from logweave.streaming import process as loop


def test_append_read_ack_reset(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}", shards=4)
    with pytest.raises(KeyError):
        log.length(0)
    assert log.scan().collect() == [] and log.read("g", 5).collect() == []
    rows = lambda a, b: spark.createDataFrame([(i, f"user{i % 5}", f"p{i}") for i in range(a, b)], "seq long, key string, payload string")
    first = {r.seq: r.message_id for r in log.append(rows(0, 40), "key", "payload", "seq").collect()}
    second = {r.seq: r.message_id for r in log.append(rows(40, 60), "key", "payload", "seq").collect()}
    ids = first | second
    assert len(set(ids.values())) == 60
    heads = {r.shard_id: r.next_entry for r in log.heads().collect()}
    assert sum(heads.values()) == 60 and all(log.length(s) == n for s, n in heads.items())
    got = {f"{r.shard_id}-{r.entry_number}": r.payload for r in log.scan().collect()}
    assert got == {m: f"p{seq}" for seq, m in ids.items()}
    assert log.list_recent(2).count() == 2 * len(heads) and log.list_recent(0).count() == 0
    assert log.read("g", 7).count() == 7

    s = min(heads)
    ack = lambda entry: log.ack(spark.createDataFrame([("g", s, entry)], "`group` string, shard_id int, entry_number long"))
    at = lambda: {(r.group, r.shard_id): r.offset for r in log.offsets().collect()}
    ack(3)
    assert at() == {("g", s): 4}
    ack(1)
    assert at() == {("g", s): 4}
    ack(10**6)
    assert at() == {("g", s): heads[s]}
    log.reset(spark.createDataFrame([("g", s, -2)], "`group` string, shard_id int, to long"))
    assert at() == {("g", s): heads[s] - 2}
    assert {r.shard_id: r.lag for r in log.lag(["g"]).collect()}[s] == 2
    log.forget("g")
    assert at() == {}


def test_half_done_append_is_invisible_and_repeats(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}", shards=2)
    rows = spark.createDataFrame([(i, f"k{i}", "x") for i in range(10)], "seq long, key string, payload string")
    log.append(rows, "key", "payload", "seq").collect()
    import shutil

    shutil.rmtree(tmp_path / "heads" / "batch=1")
    assert log.scan().count() == 0
    log.append(rows, "key", "payload", "seq").collect()
    assert log.scan().count() == 10


def test_stream_of_the_log(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log", shards=4)
    rows = spark.createDataFrame([(i, f"k{i}", "x") for i in range(30)], "seq long, key string, payload string")
    log.append(rows, "key", "payload", "seq").collect()
    seen = []
    loop.process(log.stream(), lambda df, n: seen.append(df.count()), f"{tmp_path}/loop").awaitTermination()
    assert sum(seen) == 30


def _log(spark, tmp_path, n=40, shards=4, keys=lambda i: f"user{i % 5}"):
    log = EventLog(spark, f"file://{tmp_path}/log", shards=shards)
    log.append(spark.createDataFrame([(i, keys(i), f"p{i}") for i in range(n)], "seq long, key string, payload string"), "key", "payload", "seq")
    return log


def test_null_keys_are_routed_and_null_sequences_refused(spark, tmp_path):
    log = _log(spark, tmp_path, 10, keys=lambda i: None if i < 3 else f"k{i}")
    rows = log.scan().collect()
    assert sorted(r.payload for r in rows) == sorted(f"p{i}" for i in range(10))
    assert len({r.shard_id for r in rows if r.key is None}) == 1
    none = spark.createDataFrame([(None, "a", "x"), (1, "b", "y")], "seq long, key string, payload string")
    with pytest.raises(Exception, match="without seq"):
        log.append(none, "key", "payload", "seq")
    assert log.scan().count() == 10


def test_consume_goes_on_from_the_groups_offset(spark, tmp_path):
    log, seen = _log(spark, tmp_path), []
    handler = lambda df, n: seen.append(sorted(r.payload for r in df.collect()))
    lag = lambda: sum(r.lag for r in log.lag(["g"]).collect())
    log.consume("g", handler).awaitTermination()
    assert sum(map(len, seen)) == 40 and lag() == 0
    log.consume("g", handler).awaitTermination()
    assert sum(map(len, seen)) == 40
    log.append(spark.createDataFrame([(i, f"user{i}", f"p{i}") for i in range(40, 50)], "seq long, key string, payload string"), "key", "payload", "seq")
    assert lag() == 10
    log.consume("other", lambda df, n: None).awaitTermination()
    assert lag() == 10
    log.consume("g", handler, loop.Options(batch_size=3)).awaitTermination()
    assert [len(x) for x in seen[1:]] == [3, 3, 3, 1] and sorted(p for x in seen for p in x) == sorted(f"p{i}" for i in range(50))
    log.reset(log.heads().select(F.lit("g").alias("group"), "shard_id", F.lit(0).cast("long").alias("to")))
    seen.clear()
    log.consume("g", handler).awaitTermination()
    assert sum(map(len, seen)) == 50


def test_stop_processing_ends_both_loops(spark, tmp_path):
    log, calls = _log(spark, tmp_path), []

    def handler(df, n):
        calls.append(df.count())
        raise loop.StopProcessing

    log.consume("g", handler, loop.Options(batch_size=7)).awaitTermination()
    assert calls == [7] and sum(r.offset for r in log.offsets().collect()) == 7
    query = loop.process(spark.readStream.schema("shard_id int, entry_number long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/entries"), handler, f"{tmp_path}/loop")
    with contextlib.suppress(Exception):
        query.awaitTermination()
    assert len(calls) == 2


def test_failing_handler_leaves_the_offsets(spark, tmp_path):
    log = _log(spark, tmp_path, 5)
    with pytest.raises(Exception):
        log.consume("g", lambda df, n: 1 / 0, loop.Options(max_retries=1, retry_delay_s=0.0)).awaitTermination()
    assert log.offsets().collect() == []


def test_ranges_callbacks_discovery_metrics_and_compaction(spark, tmp_path):
    log = _log(spark, tmp_path)
    s = min(r.shard_id for r in log.heads().collect())
    n, got = log.length(s), []
    assert log.scan_each(s, lambda r: got.append(r.entry_number), 3) == n and got == list(range(n))
    assert log.scan_each(s, lambda r: r.entry_number < 1, 3) == 2
    assert log.discover("e:v1:shard:*", 0, 1) == sorted(r.shard_id for r in log.heads().collect())
    for bad in (("e:v1:shard", 0, 1), ("e:*", 2, 2)):
        with pytest.raises(ValueError):
            log.discover(*bad)
    row = log.metrics().first()
    assert row.entries == 40 and row.skipped == 40 and row.bytes == 40 * 12 + sum(len(f"p{i}") for i in range(40))
    ranges = spark.createDataFrame([("g", s, 0, 1), ("g", s + 100, 0, 5)], "group string, shard_id int, from_entry long, to_entry long")
    read = spark.createDataFrame([("g", s, 3), ("g", s + 100, 2)], "group string, shard_id int, entry_number long")
    assert sorted(r.accepted for r in log.ack_range(ranges, read).collect()) == [False, True]
    assert [(r.shard_id, r.offset) for r in log.offsets().collect()] == [(s, 2)]
    log.append(spark.createDataFrame([(i, f"u{i}", f"p{i}") for i in range(40, 60)], "seq long, key string, payload string"), "key", "payload", "seq")
    new = log.compacted(f"file://{tmp_path}/new")
    key = lambda x: sorted((r.shard_id, r.entry_number, r.payload) for r in x.scan().collect())
    assert key(new) == key(log) and [(r.shard_id, r.offset) for r in new.offsets().collect()] == [(s, 2)]
    new.append(spark.createDataFrame([(60, "u", "p60")], "seq long, key string, payload string"), "key", "payload", "seq")
    assert new.scan().count() == 61


def test_shards_default(spark, tmp_path):
    assert EventLog(spark, f"file://{tmp_path}", shards=0).streams("e").count() == 16


def test_settings():
    assert [for_shards(s, 3072).max_file_size // MIB for s in (1, 16, 256, 1024)] == [1024, 192, 12, 10]
    assert for_shards(256, 3072).checkpoint_s == 5.0 and for_shards(16, 3072).checkpoint_s == 2.0
    assert preset("high compression").min_compress_size == 512 and preset("high throughput").index_interval == 1000
    assert checked(Settings(max_file_size=0, min_compress_size=-1, flush_entries=70_000, checkpoint_entries=10)) == Settings(flush_entries=70_000, checkpoint_entries=140_000)
    assert open_files(0) == 10 and open_files(256 * MIB) == 20 and open_files(10 * MIB) == 2 * (2048 // 8)
    with pytest.raises(ValueError):
        checked(Settings(process=2, processes=2))
