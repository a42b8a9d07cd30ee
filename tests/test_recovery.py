"""The binary formats, recovery, look-ups in thinned indexes, and retention passes."""

from __future__ import annotations

import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

from logweave import logs
from logweave.functions import routing
from logweave.operators import append, browse, offsets, recovery, retention, segments, stats
from logweave.sources import binary_log, manifest

FILES = "shard_id int, segment_id long, start_entry long, entries long, bytes long, start_time timestamp_ntz, end_time timestamp_ntz, is_current boolean"


def test_sparse_and_tied_sequences_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(append, "CHUNK", 1000)
    seqs = [-5, -5, 0, 7, 7, 7, 10**6, 2**53 + 1, 2**53 + 2, 2**62]
    rows = spark.createDataFrame([(s, k % 2, f"p{k}") for k, s in enumerate(seqs)], "event_id long, shard_id int, payload string").repartition(3)
    got = append.number_entries(rows).collect()
    for shard in (0, 1):
        own = sorted((r.entry_number, r.event_id) for r in got if r.shard_id == shard)
        assert [n for n, _ in own] == list(range(5)) and [s for _, s in own] == sorted(s for _, s in own)
    assert sorted(map(tuple, append.number_entries(rows.repartition(2)).collect())) == sorted(map(tuple, got))
    with pytest.raises(Exception, match="without event_id"):
        append.number_entries(rows.withColumn("event_id", F.lit(None).cast("long"))).collect()


@pytest.mark.parametrize("span", [segments.SPAN, 7])
def test_as_of_and_locate_in_a_thinned_index(spark, monkeypatch, span):
    nodes = {0: [0, 8, 13, 16, 18, 90], 1: [40], 2: []}
    index = spark.createDataFrame([(s, n, n * 10, n * 100) for s, own in nodes.items() for n in own], "shard_id int, entry_number long, segment_id long, offset_in_segment long")
    wanted = spark.createDataFrame([(s, n, f"x{n}") for s in range(4) for n in (0, 5, 8, 17, 39, 40, 99, 99)], "shard_id int, entry_number long, tag string")
    lookup = segments._last_below
    monkeypatch.setattr(segments, "_last_below", lambda *a: lookup(*a, span))
    got = sorted(tuple(r) for r in segments.as_of(wanted, index).collect())
    below = lambda s, n: max((x for x in nodes.get(s, []) if x <= n), default=None)
    want = sorted((s, n, t, b, b * 10, b * 100) for s, n, t in map(tuple, wanted.collect()) if (b := below(s, n)) is not None)
    assert got == want and len(want) == 8 + 3
    files = spark.createDataFrame([(0, 0, 0, 6), (0, 1, 6, 20), (1, 3, 39, 2)], "shard_id int, segment_id long, start_entry long, entries long")
    assert sorted(tuple(r) for r in segments.locate(wanted, files).collect()) == [(0, 0, "x0", 0, 0), (0, 5, "x5", 0, 0), (0, 8, "x8", 1, 6), (0, 17, "x17", 1, 6), (1, 39, "x39", 3, 39), (1, 40, "x40", 3, 39)]


def test_reads_of_more_shards_than_literals(spark, monkeypatch):
    log = spark.createDataFrame([(s, n) for s in range(6) for n in range(9)], "shard_id int, entry_number long")
    few = [browse.list_recent, browse.scan]
    want = [sorted(map(tuple, f(log, append.heads(log), 2).collect())) for f in few]
    wanted = log.where("entry_number in (3, 4)").unionByName(spark.createDataFrame([(0, 99)], log.schema))
    one = sorted(map(tuple, browse.point_lookup(log, wanted).collect()))
    monkeypatch.setattr(browse, "LITERAL", 2)
    assert [sorted(map(tuple, f(log, append.heads(log), 2).collect())) for f in few] == want
    assert sorted(map(tuple, browse.point_lookup(log, wanted).collect())) == one and len(one) == 12


def test_a_batch_lies_whole_in_a_segment(spark):
    log = spark.createDataFrame([(s, n, n // 3, 10) for s in range(2) for n in range(14)], "shard_id int, entry_number long, b long, stored_size long")
    got = segments.assign_segments(log, 40, ("shard_id", "entry_number", "stored_size"), "b").where("shard_id = 1").orderBy("entry_number").collect()
    assert [r.segment_id for r in got] == [0] * 6 + [1] * 6 + [2] * 2 and [r.offset_in_segment for r in got] == [0, 10, 20, 30, 40, 50] * 2 + [0, 10]


def _files(spark, n=6, size=100, day=1):
    start = dt.datetime(2024, 1, day)
    rows = [(0, k, k * 10, 10, size, start + dt.timedelta(days=k), start + dt.timedelta(days=k, hours=1), k == n - 1) for k in range(n)]
    return spark.createDataFrame(rows, FILES)


def gone(planned):
    return {r.segment_id: r.reason for r in planned.collect() if r.goes}


def test_retention_pass(spark):
    files, none = _files(spark), spark.createDataFrame([], "group string, shard_id int, offset long")
    at = lambda n: spark.createDataFrame([("g", 0, n)], "group string, shard_id int, offset long")
    run = lambda offs=none, readers=0, **rules: gone(retention.plan(files, offs, "2024-01-07 00:00:00", retention.Rules(**rules), readers))
    day = 86400
    assert run() == {}
    assert run(max_age_s=3 * day) == {0: "age", 1: "age", 2: "age"}
    assert run(max_age_s=3 * day, readers=1) == {1: "age", 2: "age"}
    assert run(at(15), max_age_s=3 * day) == {0: "age"}
    assert run(at(15), max_age_s=3 * day, protect_unconsumed=False) == {0: "age", 1: "age", 2: "age"}
    # the first forced file lifts the protection of those after it
    assert run(at(0), max_age_s=3 * day, force_after_s=5 * day) == {0: "age", 1: "age", 2: "age"}
    assert run(max_age_s=1, min_files=4) == {0: "age"}
    # what a shard's size keeps counts the current file; the size is that of all files at first
    assert run(max_shard_size=250, min_files=1) == {0: "shard size", 1: "shard size", 2: "shard size", 3: "shard size"}
    assert run(max_shard_size=1, min_files=2) == {k: "shard size" for k in range(4)}
    assert run(max_age_s=3 * day, max_shard_size=550) == {0: "age", 1: "age", 2: "age", 3: "shard size"}
    assert run(max_age_s=4 * day, max_total_size=350) == {0: "age", 1: "age", 2: "total size"}
    numbers = retention.metrics(retention.plan(files, none, "2024-01-07 00:00:00", retention.Rules(max_age_s=3 * day))).first()
    assert (numbers.files_deleted, numbers.entries_deleted, numbers.bytes_reclaimed, numbers.oldest_entry) == (3, 30, 300, dt.datetime(2024, 1, 4))
    index = spark.createDataFrame([(0, 0), (0, 20), (1, 5)], "shard_id int, entry_number long")
    assert sorted(map(tuple, retention.prune_nodes(index, files.where("segment_id = 2")).collect())) == [(0, 0), (1, 5)]


def test_one_file_in_all_may_stay(spark):
    assert sorted(gone(retention.by_shard_size(_files(spark), 1, 1).withColumn("reason", F.lit("")))) == [0, 1, 2, 3, 4]


def test_empty_damaged_and_preallocated_entries(spark, tmp_path):
    folder = tmp_path / "shard-0003"
    folder.mkdir()
    bad = binary_log.MAGIC + b"broken"
    content = binary_log.encode([(1, b"a"), (2, b""), (3, bad), (4, b"d" * 300)], 100) + bytes(64)
    (folder / f"log-{1:016d}.seg").write_bytes(content)
    rows = binary_log.scan(spark, str(tmp_path)).orderBy("entry_in_file").collect()
    assert [r.data and bytes(r.data) for r in rows] == [b"a", b"", None, b"d" * 300] and [r.ts_nanos for r in rows] == [1, 2, 3, 4]
    assert sum(r.stored_bytes for r in rows) == len(content) - 64 < 300
    assert binary_log.nth(content, 3)[2] == b"d" * 300 and binary_log.nth(content, 4) is None
    positions = spark.createDataFrame([(r.path, r.offset_in_segment) for r in rows[1::2]] + [(rows[0].path, 10**6)], "path string, offset_in_segment long")
    assert sorted(bytes(r.data) for r in binary_log.read_at(spark, str(tmp_path), positions).collect()) == [b"", b"d" * 300]
    sizes = binary_log.file_sizes(spark, str(tmp_path)).collect()
    assert [(r.shard_id, r.size) for r in sizes] == [(3, len(content))]


@pytest.mark.parametrize("least", [None, 20])
def test_written_segments_are_read_back(spark, tmp_path, least):
    log = spark.createDataFrame([(s, n, n * 7 + 1, b"%d-" % n * (n % 9)) for s in range(3) for n in range(50)], "shard_id int, entry_number long, ts_nanos long, data binary")
    written = binary_log.write_segments(log, f"file://{tmp_path}", 200, least).collect()
    back = binary_log.scan(spark, str(tmp_path))
    start = {(r.shard_id, r.path): r.start_entry for r in written}
    got = sorted((r.shard_id, start[r.shard_id, r.path.rpartition("/")[0][-10:] + "/" + r.path.rpartition("/")[2]] + r.entry_in_file, r.ts_nanos, bytes(r.data)) for r in back.collect())
    assert got == sorted((r.shard_id, r.entry_number, r.ts_nanos, bytes(r.data)) for r in log.collect())
    assert sorted((r.shard_id, r.entries, r.bytes) for r in binary_log.data_files(back).collect()) == sorted((r.shard_id, r.entries, r.bytes) for r in written)


def test_manifests_round_trip_and_errors(spark, tmp_path):
    own = manifest.Manifest(70, 900, {"g": 5, "grüppe": 70}, [(0, 0, 0), (50, 1, 30)], [("log-1", 0, 400, 0, 40, 1, 2), ("log-2", 400, 900, 40, 30, 3, 4)])
    data = manifest.encode(own)
    assert manifest.decode(data) == own and manifest.decode(manifest.encode(manifest.Manifest())) == manifest.Manifest()
    for wrong in (data[:20], b"XXXX" + data[4:], data[:4] + b"\x09" + data[5:], data[:-3]):
        with pytest.raises(ValueError):
            manifest.decode(wrong)
    rows = [(2, 70, 900, [("g", 5)], [(0, 0, 0)], [("log-1", 0, 900, 0, 70, 1, 2)])]
    df = spark.createDataFrame(rows, manifest.SCHEMA.rpartition(", error")[0])
    manifest.write(df, f"file://{tmp_path}").collect()
    (tmp_path / "shard-0009").mkdir()
    (tmp_path / "shard-0009" / "index.bin").write_bytes(data[:-1])
    back = {r.shard_id: r for r in manifest.read(spark, str(tmp_path)).collect()}
    assert tuple(back[2])[:3] == (2, 70, 900) and [tuple(f) for f in back[2].files] == [tuple(f) for f in rows[0][5]]
    assert back[9].error == "manifest ends early" and back[9].head is None


def test_recovery_of_the_last_file(spark):
    files = spark.createDataFrame([(s, f"log-{k}", 10, k * 10, k * 100, k * 100 + 100) for s in range(4) for k in range(2)], "shard_id int, path string, entries long, start_entry long, start_offset long, end_offset long")
    heads = spark.createDataFrame([(s, 20, 200) for s in range(5)], "shard_id int, head long, write_offset long")
    found = spark.createDataFrame([(1, "log-1", 40, 3), (2, "log-1", 130, 13), (3, "log-1", 100, 10), (0, "log-0", 100, 10)], "shard_id int, path string, size long, scanned long")
    got = {r.shard_id: tuple(r)[1:] for r in recovery.recover(files, heads, found).collect()}
    assert got[0] == ("gone", None, 20, 20, 100, None)
    assert got[1] == ("shorter", "log-1", 13, 13, 140, 3)
    assert got[2] == ("longer", "log-1", 20, 23, 230, 13)
    assert got[3] == ("whole", "log-1", 20, 20, 200, 10)
    assert got[4][0] == "empty"


def test_checkpoints_fold(spark):
    rows = [(0, 1, 0.0, 5), (0, 2, 1.0, 5), (0, 3, 3.5, 1), (0, 4, 4.0, 12), (1, 1, 50.0, 1), (1, 2, 51.0, 1)]
    got = append.checkpoints(spark.createDataFrame(rows, "shard_id int, seq long, at_s double, entries long"), 2.0, 12).orderBy("shard_id", "seq").collect()
    assert [(r.checkpoint, r.unsaved) for r in got] == [(False, 5), (False, 10), (True, 0), (True, 0), (False, 1), (False, 2)]


def test_shard_details_of_a_missing_shard(spark):
    files = segments.manifest(spark.createDataFrame([(0, 0, 0, 10, dt.datetime(2024, 1, 1))], "shard_id int, entry_number long, segment_id long, stored_size long, ts timestamp_ntz"))
    heads = spark.createDataFrame([(0, 1, 1)], "shard_id int, next_entry long, durable_entry long")
    details = stats.shard_details(heads, files, spark.createDataFrame([("g", 0, 1)], "group string, shard_id int, offset long"), spark.createDataFrame([(0, 0)], "shard_id int, entry_number long"))
    row = stats.of_shard(details, 0)
    assert (row.entries, row.files, row.bytes, row.index_nodes) == (1, 1, 10, 1) and row.consumer_details[0].lag == 0
    with pytest.raises(KeyError):
        stats.of_shard(details, 999)


def test_slots_names_streams_and_logger(spark):
    rows = spark.createDataFrame([("g",), ("x" * 60,), ("a\u0000b",)], "group string").select(routing.slot_name(F.col("group")).alias("n"), routing.slot(F.lit("alpha")).alias("s")).collect()
    assert [r.n for r in rows] == ["g", "x" * 47, "a"] and rows[0].s == 1569418667 % 512
    assert routing.streams("e", 0) == [f"e:{i:04d}" for i in range(16)]
    old, new = (spark.createDataFrame(x, "group string, shard_id int, offset long") for x in ([("a", 0, 1), ("b", 0, 2)], [("b", 0, 9)]))
    assert sorted(map(tuple, offsets.merge_legacy(old, new).collect())) == [("a", 0, 1), ("b", 0, 9)]
    assert logs.set_level("warn").level == logging.WARNING and logs.set_level("none").level > logging.CRITICAL
    assert logs.set_level("error", debug=True).level == logging.DEBUG and logs.set_level().level == logging.INFO
