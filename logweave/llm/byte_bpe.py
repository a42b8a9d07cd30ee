"""Operator 1: byte-level BPE encoding and decoding in linear time.

A text is cut by the vocabulary's pattern, and each piece is encoded by itself. The piece's bytes, as Latin-1 characters,
run through an Aho-Corasick automaton of all tokens, which gives the tokens that begin at each place. From the left, the
longest token that is *compatible* with the one before it is taken; where none is, the last one was wrong and is given up
for a shorter one. Every prefix of a piece has one encoding only, so a place that has been given up is never tried again
and the work grows with the piece's length.

Two neighbours are compatible if encoding their joined bytes gives the two back. That is found by undoing their merges,
latest first, and asking at each step whether a merge across the boundary would have come earlier; the answers are kept.
Tokens that merges can't reach are left out of the automaton; as a piece of their own they are still looked up whole, as
the ranks say.

Whole pieces are remembered too, up to a bound of their number, and only those of up to ``LONGEST`` bytes. A longer piece is
read in slabs of ``SLAB`` bytes: the tokens that begin in three of them at most are held at a time, and besides them some 20
bytes for each token, so a text that is one single run of letters takes a few times its own size.

Null texts count as empty: no ids, the hash of nothing. Texts of any length are encoded whole. Other columns are not read,
whatever their names, and rows with equal or null ids are encoded one by one. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from itertools import chain, filterfalse

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm._common import session

#: Pieces and pairs of tokens that a worker remembers; texts that are encoded together.
PIECES, PAIRS, AT_ONCE = 500_000, 1_000_000, 64
#: Bytes of the longest piece that is remembered, and of a slab of a long one.
LONGEST, SLAB = 256, 1 << 16
_LOADED: dict[tuple[str, str], ByteBpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merged(token, rank)
            if len(parts) <= 2 and (len(token) == 1 or len(parts) == 2):
                if len(token) > 1:
                    self.halves[rank] = (parts[0], parts[1])
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = cls(read_ranks(path), pattern)
        return _LOADED[path, pattern]

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The token's bytes after all merges of a lower rank than its own: two parts if its own merge comes next."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Walks back from both tokens to their bytes at the boundary.

        ``open_until``: the boundary's parts have been side by side until the merge with this rank; a merge across the
        boundary that ranks lower would have been made. Equal ranks: the left one of two equal merges comes first.
        """
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.halves
        open_until = len(bytes_of)
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], open_until) < open_until:
                return False
            whole_left, whole_right = halves.get(left), halves.get(right)
            if whole_left is None and whole_right is None:
                return True
            if whole_right is None or (whole_left is not None and left > right):
                open_until, left = left, whole_left[1]
            else:
                # the merge across comes before an equal one on its right
                open_until, right = right + 1, whole_right[0]

    def _begins(self, text: str, slab: int) -> list[list[tuple[int, int]]]:
        """The tokens that begin at each place of a slab of the text, the longest last."""
        n, low = len(text), slab * SLAB
        size = min(SLAB, n - low)
        out: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        if size == n:
            for end, token in self.automaton.iter(text):
                out[end + 1 - token[0]].append(token)
        else:
            for end, token in self.automaton.iter(text, low, min(low + SLAB + self.longest, n)):
                if (k := end + 1 - token[0] - low) < size:
                    out[k].append(token)
        return out

    def encode_piece(self, piece: bytes) -> list[int] | array:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, text = len(piece), piece.decode("latin-1")
        compatible, dead = self.compatible, bytearray(n + 1)
        if n <= SLAB:
            out, stack = [], []
            slab, begins = 0, self._begins(text, 0)
        else:
            out, stack = array("I"), array("q")
            slab, begins, others = -1, [], {}
        at = 0
        while at < n:
            if n > SLAB and at // SLAB != slab:
                # where a slab ends two are held, as the way back may lead into the one before
                others = {k: v for k, v in ((slab, begins), *others.items()) if abs(k - at // SLAB) <= 1}
                slab = at // SLAB
                begins = others.pop(slab, None) or self._begins(text, slab)
            choices, last = begins[at - slab * SLAB], out[-1] if out else -1
            for size, rank in reversed(choices):
                if not dead[at + size] and (last < 0 or compatible(last, rank)):
                    out.append(rank)
                    stack.append(at)
                    at += size
                    break
            else:
                dead[at] = 1
                at = stack.pop()
                out.pop()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        gc.disable()  # many small objects come and none of them in a cycle
        try:
            for k in range(0, len(texts), AT_ONCE):
                split = [self.find(t) for t in texts[k : k + AT_ONCE]]
                new = set(filterfalse(self.memo.__contains__, chain.from_iterable(split)))
                if len(self.memo) + len(new) > PIECES:
                    self.memo.clear()
                    new = set(chain.from_iterable(split))
                for p in new:
                    self.memo[p] = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
                get = self.memo.__getitem__
                out += [b"".join(map(get, s)) for s in split]
                for p in [p for p in new if len(p) > LONGEST]:
                    del self.memo[p]
        finally:
            gc.enable()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _digests(path: str, pattern: str, ids: bool):
    def digests(batches):
        bpe = ByteBpe.load(path, pattern)
        for b in batches:
            coded = bpe.encode([t or "" for t in b["text"].to_pylist()])
            columns = [b["doc_id"], pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(coded, pa.binary())], [*names, "ids"]
            yield pa.record_batch(columns, names=names)

    return digests


def byte_bpe(docs: DataFrame, path: str, pattern: str, ids: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids as little-endian 32-bit integers.

    path: a file of base64 tokens and ranks; pattern: the pieces that are encoded by themselves.
    """
    session(docs.sparkSession)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_digests(path, pattern, ids), out)
