"""Golden values of FIXTURES.md and invariants of the log's operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.functions import routing
from logweave.operators import append, browse, offsets, recovery, retention, segments
from logweave.sources import binary_log
from logweave.streaming import process as loop


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_routing_goldens(spark):
    keys = ["user123", "alpha", "", "1", "42", "alice", "bob", "charlie", "diana"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", routing.fnv1a(F.col("k")).alias("h"), routing.pick_shard(F.col("k"), 4).alias("s"))
    got = {r.k: (r.h, r.s) for r in df.collect()}
    assert [got[k][0] for k in keys[:5]] == [122042374, 1569418667, 2166136261, 873244444, 2279835011]
    assert [got[k][1] for k in keys[5:]] == [3, 0, 1, 0]
    shards = spark.range(1000).select(routing.pick_shard(F.concat(F.lit("user"), F.col("id")), 0).alias("s")).groupBy("s").count().collect()
    assert len(shards) >= 8 and all(62 / 3 <= r["count"] <= 62 * 3 for r in shards)


def test_owned_routing():
    assert routing.owned_ids(0, 1, 3) == [1, 4, 7, 10, 13] and len(routing.owned_ids(0, 0, 1)) == 16
    with pytest.raises(ValueError):
        routing.pick_owned_shard(F.lit("x"), 2, 5, 8)


def test_names_and_ids(spark):
    ids = ["123-456", "999999-888888", "123456", "", "abc-456", "123-def", "5--7"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ids)], "k int, t string").select("k", routing.parse_message_id(F.col("t")).alias("id"))
    got = {r.k: r.id and tuple(r.id) for r in df.collect()}
    assert [got[k] for k in range(7)] == [(123, 456), (999999, 888888), None, None, None, None, (5, -7)]
    names = ["events:v1:0042", "events:v1:255", "a:v1:shard:7", "x", "x:", "a:00A7"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(names)], "k int, t string").select("k", routing.parse_stream(F.col("t")).alias("s"))
    assert [r.s for r in sorted(df.collect())] == [42, None, 7, None, None, None]
    assert spark.range(1).select(routing.stream_name("events:v1", F.lit(255)).alias("n")).first().n == "events:v1:0255"


@pytest.fixture
def log(spark):
    rows = [(i, i % 3, f"m{i}", 12 + (i * 7) % 50, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(300)]
    return append.number_entries(spark.createDataFrame(rows, "event_id long, shard_id int, payload string, stored_size long, ts timestamp_ntz"))


def test_numbers_have_no_gaps_across_chunks_and_appends(spark, log, monkeypatch):
    monkeypatch.setattr(append, "CHUNK", 37)
    again = append.number_entries(log.drop("entry_number"))
    assert values(again, "event_id", "entry_number") == values(log, "event_id", "entry_number")
    for s in range(3):
        assert [r.entry_number for r in again.where(F.col("shard_id") == s).orderBy("event_id").collect()] == list(range(100))
    later = append.number_entries(log.drop("entry_number"), base=append.heads(log))
    assert later.agg(F.min("entry_number"), F.max("entry_number")).first()[:] == (100, 199)


def test_tail_and_scan(spark, log):
    heads = append.heads(log)
    assert values(browse.list_recent(log, heads, 10).where("shard_id = 1"), "entry_number") == sorted([(i,) for i in range(90, 100)], key=str)
    assert browse.list_recent(log, heads, 200).count() == 300 and browse.list_recent(log, heads, 0).count() == 0
    assert browse.scan(log, heads, 10).count() == 30 and browse.scan(log, append.heads(log, 5)).count() == 285
    none = spark.createDataFrame([], "group string, shard_id int, offset long")
    assert values(browse.read(log, heads, none, "g", 120), "shard_id", "entry_number") == sorted([(0, i) for i in range(100)] + [(1, i) for i in range(20)], key=str)


def test_acks(spark):
    heads = spark.createDataFrame([(0, 10, 10)], "shard_id int, next_entry long, durable_entry long")
    at = spark.createDataFrame([("g", 0, 3)], "group string, shard_id int, offset long")
    acks = spark.createDataFrame([("g", 0, 1, 1), ("g", 0, 1, 2), ("h", 0, 99, 3)], "group string, shard_id int, entry_number long, seq long")
    assert values(offsets.ack(acks, heads, at), "group", "offset", "acked") == [("g", 3, 2), ("h", 10, 1)]
    ranges = spark.createDataFrame([("g", 0, 0, 9), ("g", 0, 0, 2), ("g", 0, 3, 2), ("new", 0, 0, 50)], "group string, shard_id int, from_entry long, to_entry long")
    reads = spark.createDataFrame([("g", 0, 2)], "group string, shard_id int, highest long")
    assert values(offsets.ack_range(ranges, reads, at), "group", "to_entry", "accepted", "offset") == [("g", 2, False, 3), ("g", 2, True, 3), ("g", 9, False, 3), ("new", 50, True, 51)]
    assert values(offsets.lag(heads, at, ["g", "none"]), "group", "lag") == [("g", 7), ("none", 10)]


def test_segments_are_a_greedy_fold(log):
    got = {(r.shard_id, r.entry_number): (r.segment_id, r.offset_in_segment) for r in segments.assign_segments(log, 128).collect()}
    for s in range(3):
        segment = at = 0
        for r in log.where(F.col("shard_id") == s).orderBy("entry_number").collect():
            assert got[s, r.entry_number] == (segment, at)
            at += r.stored_size
            if at >= 128:
                segment, at = segment + 1, 0
    files = segments.manifest(segments.assign_segments(log, 128))
    assert files.where("is_current").count() == 3 and files.agg(F.sum("entries")).first()[0] == 300


def test_index_pruning_golden(spark):
    nodes = spark.range(20).select(F.lit(0).alias("shard_id"), F.col("id").alias("entry_number"))
    assert sorted(r.entry_number for r in segments.prune_index(nodes, 5).collect()) == [0, 8, 13, 16, 18]


def test_retention(spark):
    rows = [(0, k, k * 10, 10, 100, dt.datetime(2024, 1, 1 + k), dt.datetime(2024, 1, 1 + k), k == 4) for k in range(5)]
    files = spark.createDataFrame(rows, "shard_id int, segment_id long, start_entry long, entries long, bytes long, start_time timestamp_ntz, end_time timestamp_ntz, is_current boolean")
    old = retention.by_age(files, "2024-01-05 00:00:00", 86400)
    assert [r.segment_id for r in old.where("old").orderBy("segment_id").collect()] == [0, 1, 2]
    assert retention.keep_least(old, "old", 3).where("goes").count() == 1
    at = spark.createDataFrame([("g", 0, 20)], "group string, shard_id int, offset long")
    assert [r.segment_id for r in retention.protect(files, at).where("protected").orderBy("segment_id").collect()] == [2, 3, 4]
    for rule in (retention.by_shard_size(files, 250), retention.by_total_size(files, 250)):
        assert [r.segment_id for r in rule.where("goes").orderBy("segment_id").collect()] == [0, 1, 2]
    assert retention.by_total_size(files, 0).where("goes").count() == 4
    assert retention.apply(files, retention.by_shard_size(files, 250).where("goes")).count() == 2


def test_state_validity(spark):
    state = spark.createDataFrame([(0, 0, 0, 5), (1, 999, 0, 5), (2, 1, 1 << 41, 5), (3, 1, 7, -100), (4, 1, 7, 5)], "shard_id int, version int, write_offset long, last_entry long")
    assert values(recovery.validate(state), "shard_id", "valid", "last_entry_now") == [(0, False, -1), (1, False, -1), (2, False, -1), (3, False, -1), (4, True, 5)]


def test_binary_files_round_trip(spark, tmp_path):
    entries = [(i, (b"%d:" % i) + b"A" * (i * 20)) for i in range(1, 30)]
    for shard in (0, 7):
        folder = tmp_path / f"shard-{shard:04d}"
        folder.mkdir()
        (folder / f"log-{1:016d}.seg").write_bytes(binary_log.encode(entries[:20], 100))
        (folder / f"log-{2:016d}.seg").write_bytes(binary_log.encode(entries[20:]) + b"\x05\0\0\0half")
    got = binary_log.scan(spark, str(tmp_path))
    assert sorted(bytes(r.data) for r in got.where("shard_id = 7").collect()) == sorted(d for _, d in entries)
    assert sum(r.stored_bytes for r in got.collect()) == sum(f.stat().st_size for f in tmp_path.rglob("*.seg")) - 2 * 8  # the half entries
    rebuilt = recovery.rebuild(binary_log.data_files(got))
    assert values(rebuilt, "shard_id", "start_entry", "entries", "is_current") == [(0, 0, 20, False), (0, 20, 9, True), (7, 0, 20, False), (7, 20, 9, True)]


def test_consume_loop_retries_and_acknowledges(spark, log, tmp_path):
    log.select("shard_id", "entry_number").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("shard_id int, entry_number long").parquet(f"{tmp_path}/in")
    seen, errors = [], []

    def handler(df, n):
        if len(errors) < 2:
            raise RuntimeError("not yet")
        seen.extend(r.entry_number for r in df.collect())

    loop.process(stream(), handler, f"{tmp_path}/a", loop.Options("g", 2, 0.0, on_error=lambda e, k: errors.append(k), consumer=1, consumers=2)).awaitTermination()
    assert errors == [0, 1] and sorted(seen) == list(range(100))
    assert values(loop.offsets(spark, f"{tmp_path}/a"), "group", "shard_id", "offset") == [("g", 1, 100)]
    with pytest.raises(Exception):
        loop.process(stream(), lambda df, n: 1 / 0, f"{tmp_path}/b", loop.Options("g", 0)).awaitTermination()
