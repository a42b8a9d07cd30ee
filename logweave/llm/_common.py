"""Helpers that several operators of this subpackage share.

Nothing here keeps state on the driver: tables that have to be frozen go to the
folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to a Python worker: a task holds a few MB of text at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_MASK = 0xFFFFFFFFFFFFFFFF
_OWN = "/tmp/checkpoints/logweave"


def session(spark: SparkSession | None = None) -> SparkSession:
    """The session, with Arrow batches small enough for long texts. Smaller settings stay; greater ones are lowered for good, as plans read them when they run."""
    spark = spark or SparkSession.getActiveSession()
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
    return spark


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI below the one that all executors share.

    Where ``spark.checkpoint.dir`` is unset and all runs on one machine (tests), a local one is used and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    name = f"{what}-{uuid.uuid4().hex}"
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{_OWN}/{name}"
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        return f"file://{path}"
    return f"{base.rstrip('/')}/logweave/{name}"


def frozen(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._frozen_at = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the table of a ``frozen`` df, once nothing that is still to run reads it."""
    spark, path = df.sparkSession, df._frozen_at
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunked(docs: DataFrame, chunks: int, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, doc_id, body) and the columns to carry along, as carried_0, ...: documents dealt by their id's and text's hash, so that a chunk is the same however often it is computed and many rows of one id (or none) don't meet in one."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
        *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)),
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output's."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of byte words, computed once for each; emptied when it has grown to its bound. Long words are not kept."""

    BOUND, LONGEST = 250_000, 256

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def cuts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin, and its length."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def ids_of(column) -> np.ndarray:
    """doc_ids of an Arrow column as int64; null, which is smaller than any id, as the least integer."""
    return np.asarray(column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), np.int64)
