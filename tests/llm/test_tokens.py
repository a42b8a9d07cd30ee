from __future__ import annotations

import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logweave.llm import token_tables
from logweave.llm.packing import Places, pack, plan
from logweave.llm.token_tables import Shard, ShardWriter, id_of, key_of, look_up, read_shards, write_shards
from logweave.llm.word_tokens import WordEncoder, vocabulary
from tests.llm.fixtures import documents, texts

PATH = vocabulary("word_bpe_49k.json")
ODD = ["<|endoftext|> Hello <|endoftext|>world. it's IT'S don't!'s ≠. á. ΑΣ. ΑΣ, x y \x1c z.　q. 12,5. «né». É. …. E.g.,x.", "İstanbul. ǅ. ß. Straße, ''' .'s 're. x're.", "<|StartOfText|>. a<|endoftext|>.b The,. the,.", "\x00 a\x00. ​. a​. e.́ f,̸ ñ,. \xd7. a\xd7,"]


def ids(bodies):
    t = Tokenizer.from_file(PATH)
    return [np.asarray(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in bodies]


def test_words_by_memo_equal_whole_texts(monkeypatch):
    from logweave.llm import word_tokens

    bodies = ODD + [t or "" for t in texts()]
    for bound in (400_000, 50):
        monkeypatch.setattr(word_tokens, "BOUND", bound)
        e = WordEncoder(PATH)
        got = e.encode([x.encode() for x in bodies])
        assert [g + np.array([1], "<u4").tobytes() for g in got] == [x.tobytes() for x in ids(bodies)]


def test_shards_round_trip(spark):
    bodies = texts() + ODD
    at = [(31 * i) % 101 - 7 for i in range(len(bodies))]
    want, start = [], 0
    for i, x in sorted(zip(at, ids(bodies), strict=True), key=lambda p: p[0]):
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    manifest = write_shards(documents(spark, bodies, at), PATH, shards=3)
    got = sorted(tuple(r)[:4] for r in read_shards(manifest).collect())
    assert got == want
    assert sum(r.n_docs for r in manifest.collect()) == len(bodies)
    assert [x.tolist() for x in look_up(manifest, at[5])] == [ids(bodies)[5].tolist()]
    assert look_up(manifest, 10**6) == []


def test_shards_of_null_and_repeated_ids_and_none(spark):
    assert read_shards(write_shards(documents(spark).limit(0), PATH)).collect() == []
    manifest = write_shards(documents(spark, ["b", "a", None, "a"], [None, 2, 2, 2]), PATH)
    rows = read_shards(manifest).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 1), (False, 2), (False, 2), (True, 2)]
    assert sorted(r.start for r in rows) == [0, 2, 3, 5]
    assert len(look_up(manifest, 2)) == 3 and len(look_up(manifest, None)) == 1


def test_many_blocks(monkeypatch):
    monkeypatch.setattr(token_tables, "BLOCK", 64)
    out, rng = io.BytesIO(), random.Random(1)
    w = ShardWriter(out)
    keys = sorted([None, -(1 << 63), (1 << 63) - 1, *[rng.randrange(-9999, 9999) for _ in range(500)], *[7] * 40], key=key_of)
    for k, i in enumerate(keys):
        w.add(key_of(i), np.arange(k % 9, dtype="<u4").tobytes())
    w.finish()
    s = Shard(out)
    assert [id_of(k) for k, _ in s] == keys and len(s.index) > 20
    count = Counter(keys)
    assert all(len(s.get(i)) == count[i] for i in [*set(keys), 123456])
    data = bytearray(out.getvalue())
    data[3] ^= 1
    with pytest.raises(ValueError):
        list(Shard(io.BytesIO(bytes(data))))


@pytest.mark.parametrize("size", [16, 64])
def test_plan_uses_each_piece_once_and_wastes_little(size):
    rng = random.Random(size)
    counts = Counter(min(size, 1 + int(rng.expovariate(4 / size))) for _ in range(3000))
    patterns = plan(dict(counts), size)
    used = Counter()
    for times, pattern in patterns:
        assert times > 0 and sum(x * k for x, k in pattern) <= size
        for x, k in pattern:
            used[x] += times * k
    assert used == counts
    assert sum(t for t, _ in patterns) <= -(-sum(x * c for x, c in counts.items()) // size) + 1
    places = Places(patterns)
    cells = set()
    for x, c in counts.items():
        s, o = places.of(np.full(c, x), np.arange(c))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            for k in range(x):
                assert (a, b + k) not in cells
                cells.add((a, b + k))
    fill = Counter(a for a, _ in cells)
    assert all((a, b) in cells for a, n in fill.items() for b in range(n))


def test_pack_keeps_every_token(spark):
    bodies = texts() + ODD + ["word " * 3000]
    rows = pack(documents(spark, bodies), PATH, size=512).collect()
    want = ids(bodies)
    for i, x in enumerate(want):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(x) // 512)))
        for r in own:
            cut = x[r.start : r.start + 512]
            assert (r.start, r.length, r.ids_crc32) == (512 * r.piece, len(cut), zlib.crc32(cut.tobytes()))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert len(by) <= 1.05 * sum(map(len, want)) / 512 + 1


def test_pack_nothing_and_nulls(spark):
    assert pack(documents(spark).limit(0), PATH).collect() == []
    rows = pack(documents(spark, [None, "", None], [None, None, 4]), PATH).collect()
    assert [r.length for r in rows] == [1, 1, 1] and len({r.sequence_id for r in rows}) == 1


def test_look_up_opens_only_shards_whose_keys_range_has_the_id(spark, monkeypatch):
    bodies = texts()
    manifest = write_shards(documents(spark, [*bodies, "x", "y"], [*range(len(bodies)), 7, 7]), PATH, shards=4)
    opened = []
    monkeypatch.setattr(token_tables, "Shard", lambda f, own=token_tables.Shard: opened.append(1) or own(f))
    for i in (0, 7, len(bodies) - 1):
        opened.clear()
        assert len(token_tables.look_up(manifest, i)) == (3 if i == 7 else 1) and len(opened) <= 2
    assert token_tables.look_up(manifest, 10**9) == []


def test_long_words_are_not_remembered():
    encoder = WordEncoder(PATH)
    long = b"q" * 5000 + b"."
    assert encoder.encode([b"a b " + long, long]) == [encoder.encode([b"a b "])[0] + encoder.encode([long])[0], encoder.encode([long])[0]]
    assert max(map(len, encoder.memo)) <= 256


def test_words_are_cut_into_parts_and_each_is_asked_for_once(monkeypatch):
    encoder, asked = WordEncoder(PATH), []
    monkeypatch.setattr(encoder, "_library", lambda parts, own=encoder._library: asked.extend(parts) or own(parts))
    bodies = ["abc abc-12. ABC, (abc!!)", "\u00c0bc2\u00e0bc \u00d7\u00c0. \u00d7\u00e0. it's", "abc 21 \u00c0BC it's"]
    got = encoder.encode([x.encode() for x in bodies])
    assert [g + np.array([1], "<u4").tobytes() for g in got] == [x.tobytes() for x in ids(bodies)]
    assert sorted(p.decode() for p in asked) == sorted(["abc", "-", "1", "2", ".", ",", "(", "!!)", "\u00e0bc", "\u00d7\u00c0.", "\u00d7\u00e0.", "it's"])


@pytest.mark.parametrize("at_once", [1, 7, 40])
def test_long_texts_are_encoded_in_pieces(monkeypatch, at_once):
    from logweave.llm import word_tokens

    monkeypatch.setattr(word_tokens, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    signs = ["a", "B", "\u00e9", "\u00c9", "\u00df", "\u00f7", "\u00d7", "'", "'s", "<", "<|", "|>", "<|endoftext|>", " ", " ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "7", "\u00b2", "-", ".", ",.", "\u0301", "\u0130", "\u4e2d", "\u03a3", "\x7f", "\x00"]
    bodies = ["", " ", "\n \t", *ODD, *("".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(400))]
    got = WordEncoder(PATH).encode([x.encode() for x in bodies])
    assert [g + np.array([1], "<u4").tobytes() for g in got] == [x.tobytes() for x in ids(bodies)]


def test_pieces_ask_the_library_for_each_part_once(monkeypatch):
    from types import SimpleNamespace

    from logweave.llm import packing

    encoder, asked = WordEncoder(PATH), []
    monkeypatch.setattr(encoder, "_library", lambda parts, own=encoder._library: asked.extend(parts) or own(parts))
    monkeypatch.setattr(packing.WordEncoder, "load", lambda path: encoder)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    bodies = [f"{w}{k}-{w}, ({w})" for k in range(10) for w in ("abc", "étÉ")]
    batch = pa.record_batch([pa.array(range(20), pa.int64()), pa.array([x.encode() for x in bodies])], names=["doc_id", "body"])
    (rows,) = packing._pieces(PATH, 4096, 1)([batch])
    assert [(r["length"], r["ids_crc32"]) for r in rows.to_pylist()] == [(len(x), zlib.crc32(x.tobytes())) for x in ids(bodies)]
    assert sorted(p.decode() for p in asked) == sorted(["abc", "été", "-", ",", "(", ")", *"0123456789"])
