"""Connected components of an edge table: union-find within partitions, stars between them.

A task can replace its edges by a ``forest`` that connects the same nodes: at most one edge for each node, straight to the
least one that it knows. That takes no shuffle and does most of the work; who makes edges in Python does it there, so that no
task needs a second worker for it. Up to ``EDGES`` edges are one task's, and its forest is the answer. With more, rounds of
large and small stars move every edge to the least neighbour (two group-bys and two joins; their number grows with the
logarithm of the components' size), each followed by forests within partitions, until so few are left or none changes.

A hub, which has a third of all rows as neighbours, is met by partial aggregation and by joins that adaptive execution may
split; the joins are merge joins, so that nothing is broadcast. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm._common import forget, frozen

#: Edges (16 bytes each) that one task unites.
EDGES = 1 << 20
_DDL = "hi long, lo long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that isn't the least of its component, and that least one."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        # hook the greater root of each edge below the least that it meets, then shorten all paths to their end
        p, q = root[x], root[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _forests(batches):
    """The forest of a partition; what is held is never more than the nodes so far and ``EDGES`` further edges."""
    hi, lo, new, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        a, b = (np.asarray(batch[k].to_numpy(zero_copy_only=False), np.int64) for k in ("hi", "lo"))
        new.append((a, b))
        n += len(a)
        if n >= max(EDGES, len(hi)):
            hi, lo = forest(*(np.concatenate(c) for c in zip((hi, lo), *new, strict=True)))
            new, n = [], 0
    hi, lo = forest(*(np.concatenate(c) for c in zip((hi, lo), *new, strict=True)))
    for i in range(0, len(hi), 1 << 16):
        yield pa.record_batch([pa.array(hi[i : i + (1 << 16)]), pa.array(lo[i : i + (1 << 16)])], names=["hi", "lo"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    return both.join(least.hint("merge"), "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least.hint("merge"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.withColumnRenamed("m", "lo")).distinct()


def components(edges: DataFrame, a: str, b: str, what: str = "components") -> DataFrame:
    """(node, root): each node that has an edge, roots included, with the least node that it is connected with.

    edges: two long columns; loops and repeated edges are allowed, rows with a null are not edges. Without edges, no rows.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    now = frozen(pairs, what)
    mark = lambda df: df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first()
    seen = mark(now)
    while seen[0] > EDGES:
        new = frozen(_small(_large(now)).mapInArrow(_forests, _DDL), what)
        forget(now)
        now = new
        if (new := mark(now)) == seen:
            break
        seen = new
    if seen[0] <= EDGES:
        one = frozen(now.coalesce(1).mapInArrow(_forests, _DDL), what)
        forget(now)
        now = one
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
