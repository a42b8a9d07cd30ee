from __future__ import annotations

import random
import re

import numpy as np
import pytest

from logweave.llm import components as components_module
from logweave.llm import ngram_join
from logweave.llm.components import components, forest
from logweave.llm.ngram_join import ngram_components
from tests.llm.fixtures import documents, texts


def shingle_set(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted(map(tuple, df.collect()))


def near(seed=3, n=70):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha Beta gamma delta Übel eps zeta eta theta iota kappa la mu nu xi".split())
    base = [word() + str(rng.randrange(50)) for _ in range(90)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(["ONE", "two", word() + str(rng.randrange(90))])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 9])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    bodies = texts() + near()
    assert got(ngram_components(documents(spark, bodies))) == brute(list(enumerate(bodies)))


def test_large_classes_of_several_sizes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 12)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    whole = [t.split() for t in near(11, 60)]
    # halves and three quarters share rare n-grams with the whole texts, so all are one group of several classes
    bodies = [" ".join(w[: len(w) * (2 + k % 3) // 4]) for k, w in enumerate(whole)] + near(12, 20)
    want = brute(list(enumerate(bodies)))
    assert len({r[2] for r in want}) > 3
    assert got(ngram_components(documents(spark, bodies))) == want


def test_ids_in_any_order_and_negative(spark):
    bodies = near(9, 30) + texts(2, 20)
    ids = [-(53 * i) % 83 - 40 for i in range(len(bodies))]
    assert got(ngram_components(documents(spark, bodies, ids))) == brute(list(zip(ids, bodies, strict=True)))


def test_null_and_repeated_ids(spark):
    bodies = near(9, 20) + texts(2, 20)
    bodies += bodies[:6]
    ids = [i % 17 for i in range(len(bodies))]
    assert got(ngram_components(documents(spark, bodies, ids))) == brute(list(zip(ids, bodies, strict=True)))
    rows = ngram_components(documents(spark, ["a b c d e f", "a b c d e f", "x y", None], [None, 4, None, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 1, -1), (-1, 2, 4), (4, 2, 4)]


def test_hot_columns_come_last_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 2)
    rng = random.Random(8)
    common = "the same five words stand in every text of all"
    bodies = [f"{common} " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(k % 25)) for k in range(80)] + near(4, 40)
    docs = documents(spark, bodies)
    monkeypatch.setattr(ngram_join, "shuffle_partitions", lambda spark: 64)
    assert got(ngram_components(docs)) == brute(list(enumerate(bodies)))


def test_threshold_is_inclusive(spark):
    # 7 and 7 shingles with 6 in common: 6 / 8 = 0.75
    a, b = "a b c d e f g h i j k", "z b c d e f g h i j k"
    assert [r[2] for r in got(ngram_components(documents(spark, [a, b])))] == [0, 0]


def test_without_words_nothing_links(spark):
    assert got(ngram_components(documents(spark, [None, "", " \n", None]))) == [(i, 0, i) for i in range(4)]


def test_empty_table(spark):
    assert ngram_components(documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize("most", [components_module.EDGES, 7])
def test_components_of_a_long_chain(spark, monkeypatch, most):
    monkeypatch.setattr(components_module, "EDGES", most)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 77] + [(5, 5)], "a long, b long")
    found = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert found == {i: 0 if i <= 77 else 78 for i in range(201)}


def test_components_without_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none, "a", "b").collect() == components(spark.createDataFrame([(3, 3), (None, 1)], "a long, b long"), "a", "b").collect() == []


def test_forest_equals_plain_union_find():
    rng = random.Random(1)
    for n in (0, 1, 5, 200):
        edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(n)]
        root = {k: k for e in edges for k in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        hi, lo = forest(*(np.array([e[k] for e in edges], np.int64) for k in (0, 1)))
        assert dict(zip(hi.tolist(), lo.tolist(), strict=True)) == {k: r for k, r in root.items() if k != r}
