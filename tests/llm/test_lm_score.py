from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logweave.llm import lm_score
from logweave.llm.lm_score import LogFrequencyFilter, build, estimate, level, lm_scores
from tests.llm.fixtures import documents, texts


def tokens(t):
    return [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((i, held(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    return out


def test_base_equals_brute_force(spark):
    bodies = texts()
    got = sorted(tuple(r)[:6] for r in lm_scores(documents(spark, bodies)).collect())
    for g, w in zip(got, brute(list(enumerate(bodies))), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_score_is_near_exact_interpolation(spark):
    bodies = texts()
    rows = list(enumerate(bodies))
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    one, two = Counter(), Counter()
    for i, t in rows:
        if i not in held:
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
    q = lambda c: float(estimate(level(np.array([c])))[0]) if c else 0.0
    mass = sum(one.values()) + len(one) + 1
    got = {r.doc_id: r.score for r in lm_scores(documents(spark, bodies)).collect()}
    close = 0
    for i, t in rows:
        w, want = tokens(t), 0.0
        for a, b in zip([None, *w], w, strict=False):
            p = (q(one[b]) + 1) / mass
            c2 = two[(a, b)] if two[(a, b)] >= lm_score.MIN_COUNT else 0
            want += math.log10(0.6 * p + 0.4 * min(q(c2), q(one[a])) / q(one[a]) if one[a] else p)
        assert got[i] >= want - 1e-6 * abs(want) - 2.0
        close += abs(got[i] - want) <= 0.05 * abs(want) + 0.01
    assert close >= 0.9 * len(rows)


def test_filter_never_reads_less_and_rarely_more():
    rng = np.random.default_rng(1)
    key, count = rng.integers(1, 1 << 62, 5000).astype(np.uint64), rng.geometric(0.2, 5000)
    f = LogFrequencyFilter([build(key, count)[0]])
    got = f.levels(key, np.zeros(5000, np.int64))
    assert (got >= level(count)).all() and (got > level(count)).mean() < 0.01
    assert (f.levels(rng.integers(1, 1 << 62, 5000).astype(np.uint64), np.zeros(5000, np.int64)) > 0).mean() < 0.01


@pytest.mark.parametrize("n", [10, 5000, 80_000])
def test_filter_keeps_its_bits_for_each_entry_at_any_size(n):
    key = np.arange(1, n + 1, dtype=np.uint64)
    data, _ = build(key, np.ones(n, np.int64))
    assert 8 * len(data) >= lm_score.BITS * n - 8
    f = LogFrequencyFilter([data])
    assert (f.levels(key, np.zeros(n, np.int64)) >= 1).all()
    assert (f.levels(key + np.uint64(1 << 40), np.zeros(n, np.int64)) > 0).mean() < 0.03 + 1 / n


def test_filter_too_large_for_a_broadcast_gives_the_same_scores(spark):
    docs = documents(spark, [*texts(), None, "", "one"])
    rows = lambda **how: sorted(tuple(r) for r in lm_scores(docs, **how).collect())
    broadcast, routed = rows(), rows(max_bytes=0)
    assert [r[:5] for r in routed] == [r[:5] for r in broadcast]
    assert np.allclose([r[5:] for r in routed], [r[5:] for r in broadcast], rtol=1e-12)


def test_empty_null_and_repeated_ids(spark):
    assert lm_scores(documents(spark).limit(0)).collect() == []
    assert lm_scores(documents(spark).limit(0), max_bytes=-1).collect() == []
    rows = lm_scores(documents(spark, [None, "", "a b", "a b"], [None, 1, 1, 1])).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3, 3]
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


def test_bigrams_that_occur_once_are_in_the_model(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    once = Counter(p for t in train for p in zip([None, *tokens(t)], tokens(t), strict=False))
    hashed = {p: lm_score.pairs(lm_score.tokens([b" ".join(w for w in p if w)])[0]) for p in once}
    cut = lm_score.cut_for(docs)
    model = lm_score.joined(lm_score.train(docs.where(~lm_score.held_out()), cut), cut)
    single = [p for p, n in once.items() if n == 1 and None not in p]
    key = np.array([hashed[p][1] for p in single], np.uint64)
    assert len(single) > 100 and (model.bigrams(key) >= 1).all()
    assert lm_score.MIN_COUNT == 1


@pytest.mark.parametrize("most", [lm_score.MAX_BYTES, 0])
def test_scores_do_not_depend_on_partitions(spark, most):
    docs = documents(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in (3, 4, 13, 90):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(tuple(r) for r in lm_scores(docs.repartition(n), max_bytes=most).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in got[1:]:
        assert [r[:5] for r in other] == [r[:5] for r in got[0]]
        assert np.allclose([r[5:] for r in other], [r[5:] for r in got[0]], rtol=1e-12)


def test_segments_follow_from_the_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SEGMENT", 1000)
    docs = documents(spark)
    assert lm_score.cut_for(docs).segments == 128 and lm_score.cut_for(docs.limit(0)).segments == lm_score.SEGMENTS
    broadcast, routed = (sorted(tuple(r) for r in lm_scores(docs, max_bytes=m).collect()) for m in (1 << 30, 0))
    assert np.allclose([r[5:] for r in routed], [r[5:] for r in broadcast], rtol=1e-12)
