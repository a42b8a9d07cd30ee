from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pyarrow.compute as pc

from logweave.llm.suffix_dedup import _compare, _meet, _send, suffix_dedup
from tests.llm.fixtures import documents, texts


def brute(rows, width=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))


def test_equals_brute_force(spark):
    bodies = texts()
    assert got(suffix_dedup(documents(spark, bodies))) == brute(list(enumerate(bodies)))


def test_descending_ids_and_repeated_ids(spark):
    bodies = texts(7, 30)
    ids = [(97 * i) % 41 for i in range(len(bodies))]
    assert got(suffix_dedup(documents(spark, bodies, ids))) == brute(list(zip(ids, bodies, strict=True)))


def test_null_ids_are_the_smallest(spark):
    text = "q" * 30 + "w" * 30
    rows = {r.doc_id: r.n_removed for r in suffix_dedup(documents(spark, [text, text], [None, 3])).collect()}
    assert rows == {None: 0, 3: 60}


def test_empty_table(spark):
    assert suffix_dedup(documents(spark).limit(0)).collect() == []


def test_texts_longer_than_a_block(spark, monkeypatch):
    from logweave.llm import suffix_dedup as module

    monkeypatch.setattr(module, "BLOCK", 97)
    parse = module.Parse([t.encode() for t in texts() if t])
    windows = sorted((d, s) for d, a, b in zip(parse.doc, parse.first, parse.last, strict=True) for s in range(a, b + 1))
    every = [(d, b + k) for d, (b, n) in enumerate(zip(parse.begin, parse.size, strict=True)) for k in range(max(0, n - 49))]
    assert windows == every


def test_snippets_of_about_a_window_at_every_width(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    for width in (17, 18, 33, 50, 64):
        snippets = [letters(width + rng.randint(-3, 20)) for _ in range(25)]
        bodies = ["".join(rng.choice([letters(rng.randint(1, 40)), rng.choice(snippets)]) for _ in range(12)) for _ in range(60)]
        rows = list(enumerate(bodies))
        assert got(suffix_dedup(documents(spark, bodies), width)) == brute(rows, width)
        assert sum(x[2] for x in brute(rows, width)) > 1000


def test_strings_of_a_trigger_that_recur_send_no_text():
    # Every word stands in many documents, as any 16 bytes do in a large corpus, but hardly any 33 bytes recur.
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(3000)]
    bodies = [" ".join(rng.choices(words, k=100)).encode() for _ in range(100)]
    chunks = [pa.table([pa.array([c] * 50, pa.int32()), pa.array(range(50 * c, 50 * c + 50), pa.int64()), pa.array(bodies[50 * c : 50 * c + 50], pa.binary())], names=["chunk", "doc_id", "body"]) for c in range(2)]
    back = _meet(pa.concat_tables([_send(1, 50)(c) for c in chunks]))
    shared = pa.concat_tables([_compare(1, 50)(c, back.filter(pc.equal(back["chunk"], k))) for k, c in enumerate(chunks)])
    assert len(shared) == 2
    assert sum(len(x.as_py()) for x in shared["data"]) < 0.1 * sum(map(len, bodies))


def test_texts_without_repeats_shuffle_little_more_than_themselves(spark):
    rng = random.Random(5)
    bodies = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20000)) for _ in range(200)]
    bodies[150] = bodies[150][:5000] + bodies[20][300:600] + bodies[150][5000:]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    docs, before = documents(spark, bodies), written()
    rows = {r.doc_id: r.n_removed for r in suffix_dedup(docs, texts=False).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert rows[150] == 300
    assert sum(rows.values()) == 300
    # documents() deals them once, too
    assert written() - before < (1 + 1.2) * sum(map(len, bodies))
