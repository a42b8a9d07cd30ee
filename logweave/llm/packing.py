"""Operator 8: best-fit packing by exact-complement hashing.

Packing works on how many pieces there are of each length, at most ``size`` numbers, whatever the corpus. The longest
length opens a sequence; its gap is looked up among the lengths, the sums of two and the sums of three that are still
available, and a combination that fills it exactly is taken; without one the longest length that fits goes in and the
rest of the gap is looked up again. The resulting pattern is used as often as the counts allow, so each step uses up a
length (or all but a few of it), and the plan has a number of steps that depends on ``size`` alone.

Pieces get their places without meeting: each task numbers its pieces of a length, the tasks' counts give each task the
first number of its own, and number and length say which sequence and place it is in the plan.

Null texts count as empty and have the end id alone. Rows with equal or null ids are packed one by one. Other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm._common import frozen, session
from logweave.llm.word_tokens import WordEncoder

SIZE, END_ID = 4096, 1


class Lengths:
    """Available pieces by length, with an index of the sums of two."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.n = np.zeros(size + 1, np.int64)
        for k, c in counts.items():
            self.n[k] = c
        self.two = np.zeros(size + 1, np.int64)
        have = np.flatnonzero(self.n)
        for a in have.tolist():
            b = have[(have > a) & (have <= size - a)]
            self.two[a + b] += 1
            if self.n[a] > 1 and 2 * a <= size:
                self.two[2 * a] += 1

    def take(self, length: int, count: int) -> None:
        was, now = int(self.n[length]), int(self.n[length]) - count
        self.n[length] = now
        if was > 1 >= now and 2 * length <= self.size:
            self.two[2 * length] -= 1
        if not now:
            b = np.flatnonzero(self.n[: self.size - length + 1])
            self.two[length + b] -= 1

    def left(self, length: int, used: Counter) -> int:
        return int(self.n[length]) - used[length]

    def pair(self, total: int, used: Counter, most: int) -> list[int]:
        """Two available lengths, the longer at most ``most``, with this sum; the longest first."""
        if total < 2 or not self.two[total]:
            return []
        a = np.arange((total + 1) // 2, min(most, total - 1) + 1)
        for x in a[(self.n[a] > 0) & (self.n[total - a] > 0)][::-1].tolist():
            y = total - x
            if self.left(x, used) > (x == y) and self.left(y, used) > 0:
                return [x, y]
        return []

    def exact(self, gap: int, used: Counter) -> list[int]:
        """One, two or three available lengths that fill the gap."""
        if self.left(gap, used) > 0:
            return [gap]
        if found := self.pair(gap, used, gap):
            return found
        a = np.arange(gap - 1)
        for x in a[(self.n[a] > 0) & (self.two[gap - a] > 0)][::-1].tolist():
            if self.left(x, used) > 0 and (found := self.pair(gap - x, used + Counter([x]), x)):
                return [x, *found]
        return []

    def fit(self, gap: int, used: Counter) -> int:
        """The longest available length up to gap, or 0."""
        for x in np.flatnonzero(self.n[: gap + 1])[::-1].tolist():
            if self.left(x, used) > 0:
                return x
        return 0


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (times, [(length, how many in a row), ...]) that use up all counts."""
    have, out = Lengths(counts, size), []
    while True:
        open_ = np.flatnonzero(have.n)
        if not len(open_):
            return out
        used, gap = Counter([int(open_[-1])]), size - int(open_[-1])
        while gap:
            if found := have.exact(gap, used):
                used.update(found)
                break
            if not (x := have.fit(gap, used)):
                break
            k = min(gap // x, have.left(x, used)) if 4 * x <= gap and not gap % x else 1
            used[x] += k
            gap -= k * x
        times = min(int(have.n[x]) // k for x, k in used.items())
        for x, k in used.items():
            have.take(x, times * k)
        out.append((times, sorted(used.items(), reverse=True)))


class Places:
    """The plan by length and number: sequence and offset of the piece with that number among those of its length."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        seen, rows, sequence = Counter(), [], 0
        for times, pattern in patterns:
            offset = 0
            for length, k in pattern:
                rows.append((length, seen[length], sequence, offset, k))
                seen[length] += times * k
                offset += length * k
            sequence += times
        self.sequences = sequence
        self.length, self.number, self.sequence, self.offset, self.k = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        self.first = {int(x): int(i) for x, i in zip(*np.unique(self.length, return_index=True), strict=True)}
        self.end = {x: int(np.searchsorted(self.length, x, "right")) for x in self.first}

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.empty(len(length), np.int64)
        for x in np.unique(length).tolist():
            own = length == x
            a, b = self.first[x], self.end[x]
            row[own] = a + np.searchsorted(self.number[a:b], number[own], "right") - 1
        within = number - self.number[row]
        return self.sequence[row] + within // self.k[row], self.offset[row] + within % self.k[row] * length


def _pieces(path: str, size: int, end_id: int):
    def pieces(batches):
        encoder, end, seen, part = WordEncoder.load(path), np.array([end_id], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoder.encode(b["body"].to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    return pieces


def _place(places: Places):
    def place(batches):
        for b in batches:
            sequence, offset = places.of(np.asarray(b["length"].to_numpy()), np.asarray(b["number"].to_numpy()))
            yield pa.record_batch([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. path: the tokenizer's file."""
    session(docs.sparkSession)
    bodies = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    pieces = frozen(bodies.mapInArrow(_pieces(path, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    places = Places(plan(totals, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["part", "length"]).withColumn("number", F.col("base") + F.col("number"))
    return numbered.mapInArrow(_place(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
