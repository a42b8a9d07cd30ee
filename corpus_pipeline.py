"""A corpus pipeline of five stages; counted as part of the library's llm subpackage.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before has kept and returns rows with the columns of
documents; the last returns packed pieces. ``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm._common import frozen
from logweave.llm.exact_dedup import dedup
from logweave.llm.ngram_join import ngram_components
from logweave.llm.packing import pack
from logweave.llm.quality_rules import quality
from logweave.llm.suffix_dedup import suffix_dedup
from logweave.llm.word_tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality(docs).where("kept").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the greatest doc_id stays."""
    return dedup(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by near-equal texts the one with the least doc_id stays."""
    first = ngram_components(docs).where("component_id = doc_id or doc_id is null").select(F.col("doc_id").alias("__first")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["__first"]), "left_semi")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that a document with a smaller doc_id has too go; n_chars follows.

    A character of which only a part would stay goes whole. All documents stay, also one of which nothing is left.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = suffix_dedup(docs, carry=others)
    now = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")} | {c: F.col(f"carried_{k}") for k, c in enumerate(others)}
    return kept.select(*(now[c].alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: where each document's pieces lie."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]
#: Tokens, byte removal and links can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
