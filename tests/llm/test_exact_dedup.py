"""Operator 7: locators, ties, clashing columns and both ways of finding hits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logweave.llm import exact_dedup
from logweave.llm.exact_dedup import dedup, exact_groups, fetch, located
from tests.llm.fixtures import documents, texts

NAMES = ["__own", "locator", "last", "group_size", "kept", "file", "row", "_metadata"]


def _docs(spark, tmp_path, how):
    docs = documents(spark, [*texts(), "tie", "tie", "tie", None, ""], [*range(len(texts())), 900, 900, 900, 901, 901])
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(k))
    docs = docs.withColumn("other", F.monotonically_increasing_id())
    if how == "rows":
        return docs
    docs.write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


@pytest.mark.parametrize("how", ["rows", "files"])
@pytest.mark.parametrize("most", [exact_dedup.BROADCAST_ROWS, 0])
def test_names_ties_and_both_joins(spark, tmp_path, monkeypatch, how, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
    docs = _docs(spark, tmp_path, how)
    kept = dedup(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted({t or "" for t in [*texts(), "tie"]})
    assert sorted(r.other for r in dedup(docs).collect()) == sorted(r.other for r in rows) or how == "rows"
    groups = exact_groups(docs).collect()
    assert len(groups) == docs.count() and sum(r.kept for r in groups) == len(rows)
    assert {r.doc_id for r in rows if (r.text or "") in ("", "tie")} == {900, 901}


def test_a_locator_fetches_its_content(spark, tmp_path):
    docs, at = located(_docs(spark, tmp_path, "files"))
    assert at == "locator_"
    want = docs.where("doc_id % 5 = 0").select(at, F.col("doc_id").alias("id"), F.col("text").alias("body"))
    found = fetch(docs, want, at).select("doc_id", "text").collect()
    assert sorted(map(str, found)) == sorted(str(r).replace("id=", "doc_id=", 1).replace("body=", "text=") for r in want.select("id", "body").collect())


def test_rows_that_files_have_once_but_docs_twice(spark, tmp_path):
    _docs(spark, tmp_path, "files")
    twice = spark.read.parquet(f"{tmp_path}/docs").select("doc_id", F.explode(F.array("text", "text")).alias("text"))
    groups = exact_groups(twice).collect()
    assert sum(r.kept for r in groups) == len({r.text_sha256 for r in groups})
