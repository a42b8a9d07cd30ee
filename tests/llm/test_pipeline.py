from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from logweave.llm.quality_rules import quality
from tests.llm.fixtures import documents, texts
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_ngram_join import near


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    bodies = texts() + near() + [t + " the of and" for t in near(4, 20)]
    docs = documents(spark, bodies)
    folder = tmp_path_factory.mktemp("docs")
    docs.write.parquet(f"{folder}/documents.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(folder)).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return str(folder), out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def removed(rows, width=50):
    least = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - width + 1):
            least[b[k : k + width]] = min(least.get(b[k : k + width], i), i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_each_stage_equals_brute_force(spark, stages):
    _, (docs, good, distinct, first, cut, _) = stages
    assert all(df.columns == docs.columns for df in (good, distinct, first, cut))
    assert rows(good) == sorted((r.doc_id, r.text) for r in quality(docs).where("kept").collect())
    last = {t: i for i, t in rows(good)}
    assert rows(distinct) == sorted((i, t) for t, i in last.items())
    assert rows(first) == [(i, t) for (i, t), (_, _, c) in zip(rows(distinct), components(rows(distinct)), strict=True) if i == c]
    assert rows(cut) == removed(rows(first))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    assert len(rows(good)) > len(rows(distinct)) > len(rows(first)) > 5


def test_packing_has_all_documents(stages):
    _, (*_, cut, packed) = stages
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in rows(cut)}


def test_run_gives_the_same_lengths(spark, stages):
    folder, (*_, packed) = stages
    key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(packed)
