"""Operator 4: language-model scores from a log-frequency Bloom filter.

The model is a word bigram model, interpolated with add-one unigrams. Its counts c are kept as quantised levels
1 + floor(log c / log ``LEVEL``): a filter holds the n-gram with each number from 1 up to its level, and a reader asks for
1, 2, ... until the answer is no. Every unigram and every bigram of the training texts is in it (a caller may ask for a
``min_count``), with ``BITS`` bits for each entry at any size of the input (about 0.6 % false answers).

The filter is cut into segments by n-gram: one for each ``SEGMENT`` bytes of training text, so what it answers follows from
the texts alone and not from how Spark deals them out. Executors build it in slices, which are runs of segments, as a table
in the shared folder. A filter of at most ``max_bytes`` goes to the workers as a broadcast. A larger one stays where it is:
each chunk of documents sends its distinct n-grams to their slices, which probe for them and send the levels back. Both ways
ask the same bits, so they give the same scores. Bigrams are known by their segment and 32 further bits.

Exact counts for the base score are not looked up in the filter. Each chunk of documents sends its distinct words (64-bit
hashes, with their training counts) to slices by word, which add them up and send them back, so neither a common word nor
the vocabulary's size meets one task. Among V words two share a hash with a chance of V * V / 2**65.

Null texts count as empty: their only token is the end. A null doc_id counts as the empty text, whose remainder is 0.
Rows with equal ids are scored one by one; other columns are not read, whatever their names. Long texts are scored whole.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm._common import WordHashes, chunked, cuts, frozen, mix, session, shuffle_partitions

FOLDS, HELD_OUT = 7, 2
LEVEL, BITS, PROBES = 2.0, 12, 4
#: Bytes of training text for each segment of the filter, and the least number of segments.
SEGMENT, SEGMENTS = 1 << 20, 64
MAX_BYTES, MIN_COUNT, WEIGHT = 128 << 20, 1, 0.4
FLUSH = 2_000_000
_HASHES = WordHashes()
END = np.uint64(0x5851F42D4C957F2D)
_LOW = np.uint64(0xFFFFFFFF)
_STEP, _PAIR, _RANK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def tokens(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed by END; how many each text has."""
    split = [b.lower().split() for b in bodies]
    size = np.fromiter(map(len, split), np.int64, len(split)) + 1
    out = np.full(int(size.sum()), END)
    body = np.ones(len(out), bool)
    body[np.cumsum(size) - 1] = False
    out[body] = _HASHES.of([w for s in split for w in s])
    return out, size


def pairs(h: np.ndarray) -> np.ndarray:
    """32-bit keys in 64 bits of each token after the one before it; a text begins after an END."""
    before = np.concatenate(([END], h[:-1])) if len(h) else h
    return mix(before * _STEP + h)


def level(count: np.ndarray) -> np.ndarray:
    # the small addend keeps exact powers from falling below their own level
    return 1 + np.floor(np.log(count.astype(np.float64)) / np.log(LEVEL) + 1e-9).astype(np.int64)


def estimate(levels: np.ndarray) -> np.ndarray:
    """The count in the middle of a level; 0 for level 0 and 1 for level 1."""
    return np.where(levels > 1, (LEVEL ** (levels - 1.0) + LEVEL**levels) / 2, levels.astype(np.float64))


def _seeds(key: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(key + np.uint64(rank * int(_RANK) % (1 << 64)))
    return x & _LOW, (x >> np.uint64(32)) | np.uint64(1)


def _place(low: np.ndarray, high: np.ndarray, probe: int, bits: np.ndarray) -> np.ndarray:
    """One of a key's places among so many bits (fewer than 2**32)."""
    return (((low + np.uint64(probe) * high) & _LOW) * bits) >> np.uint64(32)


def build(key: np.ndarray, count: np.ndarray, segment: np.ndarray | int = 0, segments: int = 1) -> tuple[bytes, np.ndarray]:
    """The bytes of so many segments one after the other, and the size of each."""
    top = level(count) if len(count) else np.zeros(0, np.int64)
    at = np.broadcast_to(np.asarray(segment, np.int64), key.shape)
    size = np.maximum(64, np.bincount(at, weights=top, minlength=segments).astype(np.int64) * BITS) // 8
    begin = 8 * (np.cumsum(size) - size)
    out = np.zeros(8 * int(size.sum()), bool)
    rank = 1
    while len(key):
        seeds, bits, base = _seeds(key, rank), (8 * size[at]).astype(np.uint64), begin[at]
        for probe in range(PROBES):
            out[base + _place(*seeds, probe, bits).astype(np.int64)] = True
        rank += 1
        ok = top >= rank
        key, top, at = key[ok], top[ok], at[ok]
    return np.packbits(out, bitorder="little").tobytes(), size


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    """By the upper bits, so that sorted keys are sorted by segment."""
    return ((key >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _first(part: np.ndarray | int, segments: int, slices: int):
    """A slice's first segment; a segment s is in slice s * slices // segments."""
    return -(-part * segments // slices)


def _split(bits: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    return [bits[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_EMPTY = build(np.zeros(0, np.uint64), np.zeros(0, np.int64))[0]


class LogFrequencyFilter:
    """The joined segments. ``levels`` probes a key's segment for rank 1, 2, ... until the first no."""

    def __init__(self, parts: list[bytes]):
        self.segments = len(parts)
        self.bits = np.fromiter((8 * len(p) for p in parts), np.uint64, len(parts))
        self.begin = (np.cumsum(self.bits) - self.bits).astype(np.uint64)
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def levels(self, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Keys in the order of their segments are read from nearby memory."""
        out = np.zeros(len(key), np.int64)
        alive = np.arange(len(key))
        rank = 1
        while len(alive):
            low, high = _seeds(key[alive], rank)
            bits, begin = self.bits[part[alive]], self.begin[part[alive]]
            for probe in range(PROBES):
                place = begin + _place(low, high, probe, bits)
                ok = (self.data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
                if not ok.all():
                    alive, low, high, bits, begin = alive[ok], low[ok], high[ok], bits[ok], begin[ok]
            out[alive] = rank
            rank += 1
        return out

    def words(self, h: np.ndarray) -> np.ndarray:
        """Levels of words; their hashes choose the segment."""
        return self.levels(h, segment_of(h, self.segments))

    def bigrams(self, key: np.ndarray) -> np.ndarray:
        return self.levels((key & _LOW) ^ _PAIR, segment_of(key, self.segments))


def _counted(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sum of each one's weights."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    at = cuts(x)
    if not len(x):
        return x, np.zeros(0, np.int64)
    return x[at[:-1]], np.add.reduceat(weight[order], at[:-1])


class Cut:
    """How n-grams are dealt: the filter's segments, and the slices that each have a run of them."""

    def __init__(self, segments: int, slices: int):
        self.segments, self.slices = segments, min(slices, segments)

    def first(self, part):
        return _first(part, self.segments, self.slices)

    def edges(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segments of sorted keys, and where each slice begins and ends among them."""
        at = segment_of(key, self.segments)
        return at, np.searchsorted(at, self.first(np.arange(self.slices + 1)))

    def counts(self, part: int, at: np.ndarray) -> bytes:
        """How many of a slice's keys each of its segments has."""
        low, high = self.first(part), self.first(part + 1)
        return np.bincount(at - low, minlength=high - low).astype(np.uint32).tobytes()


def _grams(cut: Cut):
    schema = pa.schema([("slice", pa.int32()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_segments", pa.binary()), ("pair_counts", pa.binary())])

    def flush(held: list[np.ndarray]):
        h = np.concatenate(held)
        w, wc = np.unique(h, return_counts=True)
        p, pc = np.unique(pairs(h), return_counts=True)
        wc, pc = wc.astype(np.uint32), pc.astype(np.uint32)
        (_, wa), (ps, pb) = cut.edges(w), cut.edges(p)
        p = (p & _LOW).astype(np.uint32)
        for s in range(0, cut.slices, 32):
            some = range(s, min(s + 32, cut.slices))
            rows = [(k, w[wa[k] : wa[k + 1]].tobytes(), wc[wa[k] : wa[k + 1]].tobytes(), p[pb[k] : pb[k + 1]].tobytes(), cut.counts(k, ps[pb[k] : pb[k + 1]]), pc[pb[k] : pb[k + 1]].tobytes()) for k in some]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def grams(batches):
        held, n = [], 0
        for b in batches:
            if len(b):
                held.append(tokens(b["body"].to_pylist())[0])
                n += len(held[-1])
            if n >= FLUSH:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return grams


def _slice(min_count: int, cut: Cut):
    def one(table: pa.Table) -> pa.Table:
        part = table["slice"][0].as_py()
        low, n = cut.first(part), cut.first(part + 1) - cut.first(part)

        def read(column: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(d, kind) for d in table[column].to_pylist()])

        w, wc = _counted(read("words", np.uint64), read("word_counts", np.uint32).astype(np.int64))
        at = np.concatenate([np.repeat(np.arange(n, dtype=np.uint64), np.frombuffer(d, np.uint32)) for d in table["pair_segments"].to_pylist()])
        p, pc = _counted(at << np.uint64(32) | read("pairs", np.uint32), read("pair_counts", np.uint32).astype(np.int64))
        ok = pc >= min_count
        p, pc = p[ok], pc[ok]
        segment = np.concatenate((segment_of(w, cut.segments) - low, (p >> np.uint64(32)).astype(np.int64)))
        bits, sizes = build(np.concatenate((w, (p & _LOW) ^ _PAIR)), np.concatenate((wc, pc)), segment, n)
        return pa.table([table["slice"][:1], pa.array([int(wc.sum())], pa.int64()), pa.array([len(w)], pa.int64()), pa.array([bits], pa.binary()), pa.array([sizes.tobytes()], pa.binary())], names=["slice", "n", "v", "bits", "sizes"])

    return one


def cut_for(docs: DataFrame, text: str = "text") -> Cut:
    """As many segments as the texts ask for: a power of two, so that it moves in steps."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
    return Cut(max(SEGMENTS, 1 << (max(size // SEGMENT, 1) - 1).bit_length()), shuffle_partitions(docs.sparkSession))


def train(docs: DataFrame, cut: Cut, min_count: int = MIN_COUNT, text: str = "text") -> DataFrame:
    """The filter of all rows of docs, as a table in the shared folder: slice, n (tokens), v (distinct ones), bits and the sizes of its segments."""
    session(docs.sparkSession)
    bodies = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    grams = bodies.mapInArrow(_grams(cut), "slice int, words binary, word_counts binary, pairs binary, pair_segments binary, pair_counts binary")
    return frozen(grams.groupBy("slice").applyInArrow(_slice(min_count, cut), "slice int, n long, v long, bits binary, sizes binary"), "lm-filter")


def joined(filter: DataFrame, cut: Cut) -> LogFrequencyFilter:
    """The whole filter in one process; for filters of a checked size."""
    parts = {r.slice: _split(bytes(r.bits), bytes(r.sizes)) for r in filter.select("slice", "bits", "sizes").toLocalIterator()}
    return LogFrequencyFilter([x for k in range(cut.slices) for x in parts.get(k) or [_EMPTY] * int(cut.first(k + 1) - cut.first(k))])


def _chunk(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, tokens of each text, distinct ones in order, each token's place among them."""
    h, size = tokens(table["body"].to_pylist())
    return h, size, *np.unique(h, return_inverse=True)


def _words(cut: Cut, routed: bool):
    schema = pa.schema([("slice", pa.int32()), ("chunk", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("pairs", pa.binary()), ("pair_segments", pa.binary())])

    def words(table: pa.Table) -> pa.Table:
        h, size, u, at = _chunk(table)
        learns = ~np.asarray(table["held_out"].to_numpy(zero_copy_only=False), bool)
        count = np.bincount(at[np.repeat(learns, size)], minlength=len(u)).astype(np.uint32)
        p = np.unique(pairs(h)) if routed else np.zeros(0, np.uint64)
        (_, edge), (pair_at, pair_edge) = cut.edges(u), cut.edges(p)
        p = (p & _LOW).astype(np.uint32)
        c = table["chunk"][0].as_py()
        some = np.flatnonzero((np.diff(edge) > 0) | (np.diff(pair_edge) > 0)).tolist()
        rows = []
        for k in some:
            i, j = pair_edge[k], pair_edge[k + 1]
            rows.append((k, c, u[edge[k] : edge[k + 1]].tobytes(), count[edge[k] : edge[k + 1]].tobytes(), p[i:j].tobytes(), cut.counts(k, pair_at[i:j]) if routed else b""))
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return words


_ANSWERS = pa.schema([("chunk", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary()), ("word_levels", pa.binary()), ("pair_levels", pa.binary())])


def _answered(table: pa.Table, cut: Cut, filter: pa.Table | None) -> pa.Table:
    """Training counts of one slice's words, for each chunk that asks; with the slice's filter, levels of words and pairs."""
    if not len(table):
        return _ANSWERS.empty_table()
    words = [np.frombuffer(d, np.uint64) for d in table["words"].to_pylist()]
    counts = [np.frombuffer(d, np.uint32) for d in table["counts"].to_pylist()]
    u, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    said = [total[at[e - len(w) : e]].tobytes() for e, w in zip(ends, words, strict=True)]
    word_levels = pair_levels = [b""] * len(words)
    if filter is not None:
        part = table["slice"][0].as_py()
        low, n = int(cut.first(part)), int(cut.first(part + 1) - cut.first(part))
        own = LogFrequencyFilter(_split(filter["bits"][0].as_py(), filter["sizes"][0].as_py()) if len(filter) else [_EMPTY] * n)
        top = own.levels(u, segment_of(u, cut.segments) - low).astype(np.uint8)
        word_levels = [top[at[e - len(w) : e]].tobytes() for e, w in zip(ends, words, strict=True)]
        asked = zip(table["pairs"].to_pylist(), table["pair_segments"].to_pylist(), strict=True)
        pair_levels = [own.levels(np.frombuffer(d, np.uint32).astype(np.uint64) ^ _PAIR, np.repeat(np.arange(n), np.frombuffer(c, np.uint32))).astype(np.uint8).tobytes() for d, c in asked]
    return pa.table([table["chunk"].combine_chunks(), table["slice"].combine_chunks(), pa.array(said, pa.binary()), pa.array(word_levels, pa.binary()), pa.array(pair_levels, pa.binary())], schema=_ANSWERS)


def _totals(cut: Cut):
    return lambda table: _answered(table, cut, None)


def _routed_totals(cut: Cut):
    return lambda table, filter: _answered(table, cut, filter)


def _scores(n_train: int, v_train: int, model, weight: float):
    """model: the filter's broadcast, or None where the slices have answered."""

    def scores(table: pa.Table, totals: pa.Table) -> pa.Table:
        h, size, u, at = _chunk(table)
        said = totals.sort_by("slice")

        def answers(column: str, kind) -> np.ndarray:
            """Of all slices, in the order of the sorted keys."""
            return np.frombuffer(b"".join(said[column].to_pylist()), kind).astype(np.int64)

        c = answers("counts", np.int64)
        p, place = np.unique(pairs(h), return_inverse=True)
        if model is not None:
            one_level, two_level = model.value.words(u), model.value.bigrams(p)[place]
        else:
            one_level, two_level = answers("word_levels", np.uint8), answers("pair_levels", np.uint8)[place]
        first = np.cumsum(size) - size
        sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        mass = n_train + v_train + 1
        base = sums(np.log10(c + 1.0)[at]) - size * np.log10(mass)
        c1 = estimate(one_level)
        one = (c1 + 1) / mass
        # the token before each one; END before a text's first, as every text ends in END
        before = c1[np.concatenate((np.searchsorted(u, [END]), at[:-1]))] if len(at) else np.zeros(0)
        two = np.minimum(estimate(two_level), before) / np.maximum(before, 1)
        p = np.where(before > 0, (1 - weight) * one[at] + weight * two, one[at])
        out = [table["doc_id"], table["held_out"], pa.array(size), pa.array(sums((c[at] > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(len(size), n_train, np.int64)), pa.array(base), pa.array(sums(np.log10(p)))]
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return scores


def lm_scores(docs: DataFrame, max_bytes: int = MAX_BYTES, min_count: int = MIN_COUNT, weight: float = WEIGHT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = session(docs.sparkSession)
    cut = cut_for(docs, text)
    known = train(docs.where(~held_out(key)), cut, min_count, text)
    size = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("bytes")).first()
    routed = size.bytes > max_bytes
    parts = chunked(docs, 4 * shuffle_partitions(spark), key, text).withColumn("held_out", held_out("doc_id"))
    words = parts.groupBy("chunk").applyInArrow(_words(cut, routed), "slice int, chunk int, words binary, counts binary, pairs binary, pair_segments binary").groupBy("slice")
    answers = "chunk int, slice int, counts binary, word_levels binary, pair_levels binary"
    if routed:
        totals = words.cogroup(known.select("slice", "bits", "sizes").groupBy("slice")).applyInArrow(_routed_totals(cut), answers)
        model = None
    else:
        totals = words.applyInArrow(_totals(cut), answers)
        model = spark.sparkContext.broadcast(joined(known, cut))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_scores(size.n, size.v, model, weight), out)
