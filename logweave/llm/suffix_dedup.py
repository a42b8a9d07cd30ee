"""Operator 6: suffix-array dedup by prefix-free parsing.

A byte goes if a ``width``-byte string that covers it also starts in a document with a smaller doc_id.

1. *Parse.* A rolling hash of 16 bytes runs over each text; in every window of ``width`` bytes its least value is the
   trigger. Consecutive windows with the same trigger form a phrase: the text from the first window's start to the last
   one's end. Phrases depend on the text alone, and each window lies in exactly one phrase, so the overlap of neighbours
   (width - 1 bytes) takes the place of a suffix array of the parse: no match has to look further than its phrase.
2. *Dictionary.* Equal phrases become one entry with the least doc_id; later copies go as a whole. Long repeats thus cost
   one entry for each phrase, however many copies there are.
3. *Suffix array.* Entries that share a window have the trigger at the same place in it, and so agree on the trigger with
   half of the window's other bytes, either before or after it (its *sides*). First, a chunk sends its distinct sides alone,
   as sorted numbers of ``NAME`` bits, and hears which of them another chunk has. Only entries with a side that another
   document seems to have are sent as such, with their ids; and of these, only different ones that do agree on a side, in
   different documents, send their bytes. They are gathered by trigger, their suffixes of ``width`` bytes sorted, and the
   least doc_id of each run of equal suffixes decides, byte for byte.

The trigger alone would not do in step 3: in a large corpus nearly every string of 16 bytes stands in some other document
too, and all bytes would be sent; strings of 33 (at 50 bytes' width) seldom recur by chance.

Phrases are 64 bits and one or two sides of 32 bits: two different phrases are taken for equal with a chance of about
2**-96 for each pair; the suffixes in step 3 are compared as bytes.

All data that meet in a task are one chunk of documents or one slice of triggers; there are four chunks and one slice for
every shuffle partition. What a chunk sends for a phrase it sends once, so no common passage heats a slice. All that is
shuffled stays on disk until the end, so texts go to their chunks compressed and most phrases send a name of a few bytes.

Null texts count as empty, null ids as smaller than all others; rows with equal ids never remove each other's bytes.
Texts shorter than ``width`` are kept as they are. Other columns are not read, but for those to carry along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm._common import chunked, cuts, ids_of, mix, session, shuffle_partitions

WIDTH, GRAM = 50, 16
#: Bits of a side's name. Two sides of a slice share one by chance now and then (a slice of 10 MB of Parquet has some 2**21); that only sends an entry too many.
NAME = 28
#: Windows that are parsed at a time; the arrays of a step stay in the processor's cache.
BLOCK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOW = np.uint64(0xFFFFFFFF)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


class Parse:
    """Phrases of a list of texts: doc, start of the first and last window, trigger's place, trigger's and phrase's hash,
    which sides it has (bit 0: the trigger and what stands before it, bit 1: what stands after it) and their hashes."""

    def __init__(self, texts: list[bytes], width: int = WIDTH):
        self.width = width
        #: Bytes of the sides: a window has at least so many before its trigger, or else so many after it.
        self.before = (width - GRAM + 1) // 2
        self.after = width - GRAM - self.before + 1
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate(([0], np.cumsum(self.size)))[:-1].astype(np.int64)
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        parts = [self._block(a, min(a + BLOCK, len(self.buf) - width + 1)) for a in range(0, len(self.buf) - width + 1, BLOCK)]
        empty = np.zeros(0, np.int64)
        self.doc, self.first, self.last, self.at, self.trigger, self.phrase, self.sides, self.left, self.right = (
            (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty.astype(t) for t in (*[np.int64] * 4, np.uint64, np.uint64, np.uint8, np.uint32, np.uint32))
        )

    def _block(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        width, n = self.width, b - a
        c = _BYTES[self.buf[a : b + width - 1]]
        h, step = c, 1
        while step < GRAM:
            h = h[:-step] * _power(step) + h[step:]
            step *= 2
        key = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        span, m, have = width - GRAM + 1, key, 1
        while 2 * have <= span:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        m = np.minimum(m[:n], m[span - have : span - have + n])
        at = (m & _LOW).astype(np.int64)
        # A phrase ends where the trigger moves, a text begins or a text has no further whole window.
        lo, hi = np.searchsorted(self.begin, (a, b))
        near = slice(max(lo - 1, 0), hi)
        edges = np.concatenate((self.begin[near], self.begin[near] + np.maximum(self.size[near] - width + 1, 0))) - a
        first = np.unique(np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, edges[(edges > 0) & (edges < n)])))
        last = np.append(first[1:], n) - 1
        doc = np.searchsorted(self.begin, first + a, "right") - 1
        ok = first + a + width <= self.begin[doc] + self.size[doc]
        doc, first, last = doc[ok], first[ok], last[ok]
        at = at[first]

        def whole(i: np.ndarray) -> np.ndarray:
            out, left = np.zeros(len(i), np.uint64), width
            while left >= GRAM:
                out, i, left = out * _power(GRAM) + h[i], i + GRAM, left - GRAM
            for _ in range(left):
                out, i = out * _BASE + c[i], i + 1
            return out

        shape = ((last - first) * 64 + (at - first)).astype(np.uint64)
        phrase = mix(mix(whole(first)) * np.uint64(3) + whole(last) + shape * np.uint64(0xC2B2AE3D27D4EB4F))

        def side(has: np.ndarray, *grams: np.ndarray) -> np.ndarray:
            out = np.zeros(len(has), np.uint64)
            for i in grams:
                out[has] = mix(out[has] * np.uint64(3) + h[i[has]])
            return (out >> np.uint64(32)).astype(np.uint32)

        # The grams overlap and cover the side; windows that it belongs to lie within the phrase, so they do too.
        left, right = first <= at - self.before, last > at - self.before
        sides = left.astype(np.uint8) | right.astype(np.uint8) << 1
        left = side(left, at - self.before, at + min(GRAM - self.before, 0), at)
        right = side(right, at, at + min(GRAM, self.after), at + self.after)
        return doc, first + a, last + a, at + a, mix(h[at]), phrase, sides, left, right


class Entries:
    """A chunk's own dictionary: phrases that are equal, with the least doc_id, in the order in which slices get them."""

    def __init__(self, parse: Parse, ids: np.ndarray, slices: int):
        self.table, rank = np.unique(ids, return_inverse=True)
        rank = rank[parse.doc]
        key = parse.phrase ^ (parse.trigger * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        at = cuts(key[order])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.rank = np.minimum.reduceat(rank[order], at[:-1]) if len(order) else rank
        self.later = rank > self.rank[self.group] if len(order) else rank > 0
        one = order[at[:-1]]
        self.trigger, self.phrase, self.one = parse.trigger[one], parse.phrase[one], one
        self.sides, self.left, self.right = parse.sides[one], parse.left[one], parse.right[one]
        self.part = part = (self.trigger % np.uint64(slices)).astype(np.int64)
        self.sent = np.lexsort((self.rank, part))
        at = cuts(part[self.sent])
        self.parts = [(int(part[self.sent[i]]), self.sent[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)] if len(part) else []


class Names:
    """The distinct names of a chunk's sides, by slice; which of them entries of different documents in the chunk share."""

    def __init__(self, own: Entries):
        left, right = np.flatnonzero(own.sides & 1), np.flatnonzero(own.sides >> 1)
        self.entry = np.concatenate((left, right))
        name = np.concatenate((own.left[left], own.right[right])) >> np.uint32(32 - NAME)
        key = own.part[self.entry] << 32 | name.astype(np.int64)
        order = np.argsort(key, kind="stable")
        at = cuts(key[order])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key, rank = key[order[at[:-1]]], own.rank[self.entry[order]]
        self.shared = np.minimum.reduceat(rank, at[:-1]) < np.maximum.reduceat(rank, at[:-1]) if len(order) else rank > 0
        self.name = (key & 0xFFFFFFFF).astype(np.uint32)
        at = cuts(key >> 32)
        self.parts = [(int(key[i] >> 32), slice(i, j)) for i, j in zip(at[:-1], at[1:], strict=True)] if len(key) else []


def _squeeze(sorted_ids: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(sorted_ids, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _expand(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel())


def _squeeze_names(names: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(names, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _expand_names(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def _pack(own: Entries, which: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct ids of entries that are in their order, and how many entries there are with a bit where the next id begins."""
    rank = own.rank[which]
    return _squeeze(own.table[np.unique(rank)]), len(rank).to_bytes(8, "little") + np.packbits(rank[1:] != rank[:-1]).tobytes()


class _Fields:
    """Reads the arrays of packed entries one after the other."""

    def __init__(self, ids: bytes, data: bytes):
        self.data, self.at = data, 8
        self.n = int.from_bytes(data[:8], "little")
        self.doc = _expand(ids)[np.cumsum(np.append(np.zeros(min(self.n, 1), np.int64), self.bits(max(self.n - 1, 0))))]

    def take(self, kind: type, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at) if n else np.zeros(0, kind)
        self.at += out.nbytes
        return out

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.take(np.uint8, -(-n // 8)), count=n).astype(np.int64)


def _table(rows: dict, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


_NAMES = pa.schema([("slice", pa.int32()), ("chunk", pa.int32()), ("names", pa.binary())])
_SEEN = pa.schema([("chunk", pa.int32()), ("slice", pa.int32()), ("seen", pa.binary())])
_SENT = pa.schema([("slice", pa.int32()), ("chunk", pa.int32()), ("sent", pa.binary()), ("ids", pa.binary()), ("data", pa.binary())])
_BACK = pa.schema([("chunk", pa.int32()), ("slice", pa.int32()), ("sent", pa.binary()), ("flags", pa.binary())])
_SHARED = pa.schema([("slice", pa.int32()), ("chunk", pa.int32()), ("sent", pa.binary()), ("flags", pa.binary()), ("ids", pa.binary()), ("data", pa.binary())])
_FATE = pa.schema([("chunk", pa.int32()), ("slice", pa.int32()), ("sent", pa.binary()), ("flags", pa.binary()), ("masks", pa.binary())])
_DDL = {
    "names": "slice int, chunk int, names binary",
    "seen": "chunk int, slice int, seen binary",
    "sent": "slice int, chunk int, sent binary, ids binary, data binary",
    "back": "chunk int, slice int, sent binary, flags binary",
    "shared": "slice int, chunk int, sent binary, flags binary, ids binary, data binary",
    "fate": "chunk int, slice int, sent binary, flags binary, masks binary",
}
#: What a slice says of a chunk's entry: no other document has one of its sides; a smaller id has it whole; windows have to be compared.
ALONE, COPY, COMPARE = 0, 1, 2


def _zip(batches):
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        k = b.schema.get_field_index("body")
        columns = b.columns
        columns[k] = pa.array([squeeze(x) for x in b.column(k).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names=["zipped" if n == "body" else n for n in b.schema.names])


def _texts(table: pa.Table) -> list[bytes]:
    if "body" in table.column_names:
        return table["body"].to_pylist()
    return list(map(zstandard.ZstdDecompressor().decompress, table["zipped"].to_pylist()))


def _chunk(table: pa.Table, slices: int, width: int) -> tuple[Parse, Entries, np.ndarray, np.ndarray]:
    """The chunk's rows come in any order; sorted by id and text they parse alike each time."""
    ids, texts = ids_of(table["doc_id"]), _texts(table)
    order = np.array(sorted(range(len(texts)), key=lambda i: (ids[i], texts[i])), np.int64)
    ids = ids[order]
    parse = Parse([texts[i] for i in order], width)
    return parse, Entries(parse, ids, slices), ids, order


def _tell(slices: int, width: int):
    def tell(table: pa.Table) -> pa.Table:
        _, own, _, _ = _chunk(table, slices, width)
        names = Names(own)
        rows: dict[str, list] = {f.name: [] for f in _NAMES}
        for part, at in names.parts:
            rows["slice"].append(part)
            rows["chunk"].append(table["chunk"][0].as_py())
            rows["names"].append(_squeeze_names(names.name[at]))
        return _table(rows, _NAMES)

    return tell


def _recur(table: pa.Table) -> pa.Table:
    """In a slice: which names another chunk has too, a bit for each."""
    names = [_expand_names(x) for x in table["names"].to_pylist()]
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    same = every[order[1:]] == every[order[:-1]]
    seen = np.empty(len(every), bool)
    seen[order] = np.append(same, False) | np.append(False, same)
    ends = np.cumsum([len(x) for x in names])
    return pa.table([table["chunk"], table["slice"], pa.array([np.packbits(seen[e - len(x) : e]).tobytes() for e, x in zip(ends, names, strict=True)], pa.binary())], schema=_SEEN)


def _of(which: np.ndarray, sent: bytes) -> np.ndarray:
    """Those of a slice's entries that have been sent."""
    return which[np.unpackbits(np.frombuffer(sent, np.uint8), count=len(which)) > 0]


def _send(slices: int, width: int):
    def send(table: pa.Table, seen: pa.Table | None = None) -> pa.Table:
        """Entries with a name that another document has; without the slices' answers, all."""
        _, own, _, _ = _chunk(table, slices, width)
        go = np.full(len(own.one), seen is None)
        if seen is not None:
            names = Names(own)
            said = dict(zip(seen["slice"].to_pylist(), seen["seen"].to_pylist(), strict=True))
            for part, at in names.parts:
                names.shared[at] |= np.unpackbits(np.frombuffer(said[part], np.uint8), count=at.stop - at.start) > 0
            go[names.entry[names.shared[names.group]]] = True
        rows: dict[str, list] = {f.name: [] for f in _SENT}
        for part, which in own.parts:
            sent = np.packbits(go[which])
            which = which[go[which]]
            if not len(which):
                continue
            ids, docs = _pack(own, which)
            left, right = own.sides[which] & 1, own.sides[which] >> 1
            rows["slice"].append(part)
            rows["chunk"].append(table["chunk"][0].as_py())
            rows["sent"].append(sent.tobytes())
            rows["ids"].append(ids)
            rows["data"].append(docs + b"".join(x.tobytes() for x in (np.packbits(left), np.packbits(right), own.phrase[which], own.left[which[left > 0]], own.right[which[right > 0]])))
        return _table(rows, _SENT)

    return send


def _meet(table: pa.Table) -> pa.Table:
    """In a slice: which of the entries sent another chunk has too, and which sides belong to different phrases of different documents."""
    phrase, sides, doc, size = [], [], [], []
    for ids, data in zip(table["ids"].to_pylist(), table["data"].to_pylist(), strict=True):
        fields = _Fields(ids, data)
        has = fields.bits(fields.n), fields.bits(fields.n)
        phrase.append(fields.take(np.uint64, fields.n))
        both = np.zeros((2, fields.n), np.int64)
        for k in range(2):
            both[k, has[k] > 0] = fields.take(np.uint32, int(has[k].sum()))
            both[k, has[k] == 0] = -1
        sides.append(both)
        doc.append(fields.doc)
        size.append(fields.n)
    p, (left, right), d = np.concatenate(phrase), np.concatenate(sides, axis=1), np.concatenate(doc)
    order = np.lexsort((d, right, left, p))
    p, left, right, d = p[order], left[order], right[order], d[order]
    new = np.append(True, (p[1:] != p[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    heads = np.flatnonzero(new)
    least = d[heads]
    # of each side: the least and the greatest id among its phrases' own least ones
    compare = np.zeros(len(heads), bool)
    for side in (left[heads], right[heads]):
        of = np.flatnonzero(side >= 0)
        of = of[np.argsort(side[of], kind="stable")]
        at = cuts(side[of])
        if len(of):
            differ = np.minimum.reduceat(least[of], at[:-1]) < np.maximum.reduceat(least[of], at[:-1])
            compare[of[np.repeat(differ, np.diff(at))]] = True
    mine = np.cumsum(new) - 1
    flag = np.where(d > least[mine], COPY, np.where(compare[mine], COMPARE, ALONE)).astype(np.uint8)
    out = np.empty(len(flag), np.uint8)
    out[order] = flag
    ends = np.cumsum(size)
    return pa.table([table["chunk"], table["slice"], table["sent"], pa.array([out[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)], pa.binary())], schema=_BACK)


def _compare(slices: int, width: int):
    def compare(table: pa.Table, back: pa.Table) -> pa.Table:
        rows: dict[str, list] = {f.name: [] for f in _SHARED}
        if not len(back):
            return _table(rows, _SHARED)
        parse, own, _, _ = _chunk(table, slices, width)
        said = {p: x for p, *x in zip(back["slice"].to_pylist(), back["sent"].to_pylist(), back["flags"].to_pylist(), strict=True)}
        data = parse.buf.tobytes()
        for part, which in own.parts:
            if part not in said:
                continue
            sent, flags = said[part]
            which = _of(which, sent)[np.frombuffer(flags, np.uint8) == COMPARE]
            ids, docs = _pack(own, which)
            one = own.one[which]
            first, last = parse.first[one], parse.last[one]
            rows["slice"].append(part)
            rows["chunk"].append(table["chunk"][0].as_py())
            rows["sent"].append(sent)
            rows["flags"].append(flags)
            rows["ids"].append(ids)
            rows["data"].append(b"".join([docs, (last - first).astype(np.uint8).tobytes(), *(data[i : j + width] for i, j in zip(first.tolist(), last.tolist(), strict=True))]))
        return _table(rows, _SHARED)

    return compare


def _suffixes(width: int):
    def suffixes(table: pa.Table) -> pa.Table:
        """Sorts the suffixes of the slice's dictionary; the least doc_id of each run of equal ones decides."""
        bodies, starts, docs, counts, at = [], [], [], [], 0
        for ids, data in zip(table["ids"].to_pylist(), table["data"].to_pylist(), strict=True):
            # which id and what run length each entry has, then their bytes
            fields = _Fields(ids, data)
            run = fields.take(np.uint8, fields.n).astype(np.int64) + 1
            begin = np.concatenate(([0], np.cumsum(run + width - 1)))
            bodies.append(data[fields.at :])
            offset = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
            starts.append(np.repeat(begin[:-1], run) + offset + at)
            docs.append(np.repeat(fields.doc, run))
            counts.append(run)
            at += len(bodies[-1])
        start, doc = np.concatenate(starts), np.concatenate(docs)
        gone = np.zeros(len(start), bool)
        if len(start):
            words = -(-width // 8)
            buf = np.frombuffer(b"".join(bodies) + bytes(8 * words), np.uint8)
            view = np.lib.stride_tricks.sliding_window_view(buf, 8)
            key = np.empty((words, len(start)), np.uint64)
            for k in range(words):
                key[k] = np.ascontiguousarray(view[start + 8 * k]).view(">u8").ravel()
            if width % 8:
                key[-1] >>= np.uint64(8 * (8 - width % 8))
            order = np.lexsort((doc, *key[::-1]))
            new = np.append(True, (key[:, order[1:]] != key[:, order[:-1]]).any(0))
            gone[order] = doc[order] > doc[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
        masks, i = [], 0
        for run in counts:
            bit = gone[i : (i := i + int(run.sum()))].astype(np.uint64) << (np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)).astype(np.uint64)
            masks.append((np.add.reduceat(bit, np.cumsum(run) - run) if len(run) else bit).astype(np.uint64).tobytes())
        return pa.table([table["chunk"], table["slice"], table["sent"], table["flags"], pa.array(masks, pa.binary())], schema=_FATE)

    return suffixes


def _decide(slices: int, width: int, texts: bool, carried: int):
    def decide(table: pa.Table, fate: pa.Table) -> pa.Table:
        parse, own, ids, order = _chunk(table, slices, width)
        whole, mask = np.zeros(len(own.one), bool), np.zeros(len(own.one), np.uint64)
        said = {p: x for p, *x in zip(fate["slice"].to_pylist(), fate["sent"].to_pylist(), fate["flags"].to_pylist(), fate["masks"].to_pylist(), strict=True)}
        for part, which in own.parts:
            if part not in said:
                continue
            sent, flags, masks = said[part]
            which, flags = _of(which, sent), np.frombuffer(flags, np.uint8)
            whole[which] = flags == COPY
            mask[which[flags == COMPARE]] = np.frombuffer(masks, np.uint64)
        n = len(parse.buf)
        edge = np.zeros(n + 1, np.int32)
        all_of = own.later | whole[own.group] if len(own.one) else own.later
        np.add.at(edge, parse.first[all_of], 1)
        np.add.at(edge, parse.last[all_of] + width, -1)
        some = np.flatnonzero(~all_of & (mask[own.group] != 0)) if len(own.one) else np.zeros(0, np.int64)
        for k in range(width - GRAM + 1):
            hit = some[(mask[own.group[some]] >> np.uint64(k)) & np.uint64(1) != 0]
            np.add.at(edge, parse.first[hit] + k, 1)
            np.add.at(edge, parse.first[hit] + k + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, spans, kept = [], [], []
        for b, size in zip(parse.begin.tolist(), parse.size.tolist(), strict=True):
            g = gone[b : b + size]
            k = int(np.count_nonzero(g))
            removed.append(k)
            spans.append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if k else 0)
            body = parse.buf[b : b + size]
            kept.append((body[~g] if k else body).tobytes())
        null = [x.as_py() for x in table["doc_id"]]
        columns = [pa.array([null[i] for i in order.tolist()], pa.int64()), pa.array(parse.size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if texts:
            columns, names = [*columns, pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())], [*names, "kept_text"]
        for k in range(carried):
            columns, names = [*columns, table[f"carried_{k}"].take(pa.array(order))], [*names, f"carried_{k}"]
        return pa.table(columns, names=names)

    return decide


def suffix_dedup(docs: DataFrame, width: int = WIDTH, texts: bool = True, carry: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``texts`` kept_text, and the columns in ``carry`` as carried_0, ...

    kept_sha256 is of all bytes that stay; from kept_text a character goes whole if only a part of it would stay.
    width is from 17 to 64 bytes. One text exchange serves all four visits to a chunk.
    """
    spark = session(docs.sparkSession)
    n = shuffle_partitions(spark)
    kinds = dict(docs.dtypes)
    parts = chunked(docs, 4 * n, key, text, carry).mapInArrow(_zip, "chunk int, doc_id long, zipped binary" + "".join(f", carried_{k} {kinds[c]}" for k, c in enumerate(carry)))
    names = parts.groupBy("chunk").applyInArrow(_tell(n, width), _DDL["names"])
    seen = names.groupBy("slice").applyInArrow(_recur, _DDL["seen"])
    sent = parts.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(_send(n, width), _DDL["sent"])
    back = sent.groupBy("slice").applyInArrow(_meet, _DDL["back"])
    shared = parts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_compare(n, width), _DDL["shared"])
    fate = shared.groupBy("slice").applyInArrow(_suffixes(width), _DDL["fate"])
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts + "".join(f", carried_{k} {kinds[c]}" for k, c in enumerate(carry))
    return parts.groupBy("chunk").cogroup(fate.groupBy("chunk")).applyInArrow(_decide(n, width, texts, len(carry)), out)
