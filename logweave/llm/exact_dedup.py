"""Operator 7: exact dedup with a streaming query's keyed state.

1. Each row leaves its digest (SHA-256 of the text), doc_id and content locator in a table in the shared folder. A locator
   is the file and the row in it where the content lies; ``fetch`` reads it from there. Docs that are no plain scan of
   Parquet files are written to the shared folder first.
2. A Structured Streaming query reads that table. Its state has a row for each digest: the greatest (doc_id, locator) and
   the number of rows. It has no watermark, so it never expires, and lies in RocksDB on the executors' disks with its log
   and snapshots in the checkpoint folder. Partial aggregation meets a hot digest before the shuffle.
3. Full bytes are checked on hits: of all texts whose digest has two rows or more, the least and the greatest must be the
   same. If they ever differ the query stops with an error instead of dropping a text. Partial aggregation keeps one text
   for each digest and task, so a text with a third of all rows isn't sent that often.

No Python runs on the executors. ``stream_state`` can also be fed by a stream that goes on: the state carries over.

Null texts count as empty, texts of any length are compared whole; a null doc_id is smaller than any other. An empty table
gives no rows. Of rows with the same text and doc_id the one with the greatest locator stays: the last file's last row.
``dedup`` keeps all columns of docs, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm._common import frozen, shared_dir

#: A state has a store for each shuffle partition: they take the disk that they fill, not some MB each in advance.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests that go to the executors whole; with more the hits are found by a join.
BROADCAST_ROWS = 200_000


def digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def stream_state(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream (digest, doc_id, locator) until its input is used up and returns the state: digest, last, group_size.

    folder: where its checkpoint and its updates go. A later call with the same folder goes on from there. A locator may
    have any type with an order.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    schema = f"digest string, last struct<doc_id: bigint, locator: {dict(stream.dtypes)['locator']}>, group_size bigint"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/updates/batch=-1")
    try:
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("last"), F.count(F.lit(1)).alias("group_size"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/updates/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    updates = spark.read.schema(schema).parquet(f"{folder}/updates")
    # the last update of a digest has all its rows, the greatest and the most
    return updates.groupBy("digest").agg(F.max("last").alias("last"), F.max("group_size").alias("group_size"))


def _scan_of_files(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of a file."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return node.nodeName() == "LogicalRelation"


def _where(docs: DataFrame) -> Column:
    at = docs.metadataColumn("_metadata")
    return F.struct(at["file_path"].alias("file"), at["row_index"].alias("row"))


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a further column that has each row's content locator, and that column's name."""
    name = "locator"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    if _scan_of_files(docs):
        try:
            return docs.select("*", _where(docs).alias(name)), name
        except AnalysisException:  # a format without row numbers
            pass
    stored = frozen(docs, "located")
    return stored.select("*", _where(stored).alias(name)), name


def fetch(located_docs: DataFrame, locators: DataFrame, name: str = "locator") -> DataFrame:
    """The rows of a ``located`` table whose locators are asked for (a column of the same name)."""
    # locators grow with the documents, so they are never sent whole to all executors
    return located_docs.join(locators.select(name).distinct().hint("merge"), name, "left_semi")


def _staged(docs: DataFrame, at: str, key: str, text: str) -> tuple[DataFrame, str]:
    """(doc_id, digest, locator) of each row, and where it has been written."""
    folder = shared_dir(docs.sparkSession, "digests")
    staged = docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(at).alias("locator"))
    staged.write.parquet(folder)
    return docs.sparkSession.read.schema(staged.schema).parquet(folder), folder


def _groups(docs: DataFrame, staged: DataFrame, folder: str, text: str) -> DataFrame:
    """digest, last, group_size, from the state of a stream over staged; checked against the texts."""
    spark = docs.sparkSession
    stream = spark.readStream.schema(staged.schema).parquet(folder)
    state = frozen(stream_state(stream, shared_dir(spark, "dedup-state")), "groups")
    hits = state.where("group_size > 1").select("digest")
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(digest(text).alias("digest"), body.alias("body")).join(hits, "digest", "left_semi")
    checked = texts.groupBy("digest").agg((F.min("body") == F.max("body")).alias("same"))
    sure = F.coalesce(F.col("same"), F.col("group_size") == 1)
    whole = F.when(sure, F.col("group_size")).otherwise(F.raise_error(F.concat(F.lit("different texts with digest "), F.col("digest"))).cast("long"))
    return state.join(checked, "digest", "left").select("digest", "last", whole.alias("group_size"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    docs, at = located(docs)
    staged, folder = _staged(docs, at, key, text)
    joined = staged.join(_groups(docs, staged, folder, text), "digest")
    kept = (F.col("last.locator") == F.col("locator")).alias("kept")
    return joined.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", kept, F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    whole, at = located(docs)
    staged, folder = _staged(whole, at, key, text)
    # group_size is written too: the check of the full bytes is part of it and runs only where it is asked for
    groups = frozen(_groups(whole, staged, folder, text).select(F.col("last.locator").alias(at), "group_size"), "kept")
    return fetch(whole, groups, at).select(*docs.columns)
