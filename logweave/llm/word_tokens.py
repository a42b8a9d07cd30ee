"""Token ids by the tokenizers library, with a memo of parts of words.

The tokenizer drops white space and joins nothing across it, so a text's ids are its words' ids in a row. It also cuts a
word into runs of letters, single digits and runs of other signs, and joins nothing across these. Words of ASCII and
Latin-1 letters alone are cut so here, but for those with an apostrophe or "<", which open contractions and special
tokens; all other words are one part. Bytes are cut by numpy for many texts at once, Arrow numbers the distinct parts
and lines up their ids; only a part that isn't remembered goes through the library, each once. Parts of lower-case
letters are given to the library's model without its normaliser and splitter, which would leave them as they are.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Parts of a generation, of which a worker remembers two; bytes of the texts that are looked up together, if more than one.
BOUND, AT_ONCE = 300_000, 4 << 20
#: Bytes of the longest part that is remembered beyond its texts.
LONGEST = 256
#: Kinds of bytes. Those of other characters than ASCII are odd until they prove to be letters of Latin-1.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[39, 60]] = _ODD
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_BLANK = b" \t\n\r\x0b\x0c"
_WHITE = re.compile(rb"[ \t-\r]")
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LOADED: dict[str, WordEncoder] = {}


def vocabulary(name: str) -> str:
    """A public vocabulary file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        #: The greatest id, and whether an id closes a word.
        self.most = max(self.tokenizer.get_vocab().values())
        self.closes = np.zeros(self.most + 1, bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        #: Ids of parts of words.
        self.memo: dict[bytes, bytes] = {}
        #: The generation before: what is still asked for moves on into the present one.
        self.old_memo: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> WordEncoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _library(self, words: list[bytes]) -> None:
        """Learns the words' ids, as the library gives them for each word alone."""
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        groups = [plain[k : k + 512] for k in range(0, len(plain), 512)]
        for some, e in zip(groups, self.bare.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            data, edge = ids.tobytes(), [0, *(4 * np.flatnonzero(self.closes[ids]) + 4).tolist()]
            self.memo.update(zip(some, (data[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)), strict=True))
        other = [w for w in words if w not in self.memo]
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            e = self.tokenizer.encode([w.decode() for w in some], is_pretokenized=True, add_special_tokens=False)
            ids, at = np.asarray(e.ids, "<u4"), np.asarray([-1 if x is None else x for x in e.word_ids], np.int64)
            edge = np.searchsorted(at, np.arange(len(some) + 1)).tolist()
            for i, w in enumerate(some):
                self.memo[w] = ids[edge[i] : edge[i + 1]].tobytes()

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Each part's ids; the parts are distinct."""
        out = list(map(self.memo.get, parts))
        new = [p for p, ids in zip(parts, out, strict=True) if ids is None]
        if not new:
            return out
        if len(self.memo) + len(new) > BOUND:  # a new generation: the parts that were known have to move on
            self.old_memo, self.memo, new = self.memo, {}, parts
        memo, unknown, from_old = self.memo, [], self.old_memo.get
        for p in new:
            if (ids := from_old(p)) is not None:
                memo[p] = ids
            else:
                unknown.append(p)
        self._library(unknown)
        out = list(map(memo.__getitem__, parts))
        for p in unknown:
            if len(p) > LONGEST:
                del memo[p]
        return out

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        gc.disable()  # many small objects come and none of them in a cycle
        try:
            out: list[bytes] = []
            some: list[bytes] = []
            size = 0
            for b in bodies:
                if some and size + len(b) > AT_ONCE:
                    out += self._encode(some)
                    some, size = [], 0
                if len(b) > AT_ONCE:
                    out.append(b"".join(self._encode([x])[0] for x in _cut(b)))
                else:
                    some.append(b)
                    size += len(b)
            return out + self._encode(some)
        finally:
            gc.enable()

    def _encode(self, bodies: list[bytes]) -> list[bytes]:
        if not bodies:
            return []
        # The tokenizer lowers all letters, but knows its special tokens, <|...|>, only as they are.
        data, at, size = _parts([b if b"<|" in b else b.lower() for b in bodies])
        if not len(at):
            return [b""] * len(bodies)
        edge = pa.py_buffer(np.concatenate(([0], np.cumsum(size))))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, edge, pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        _, edge, values = ids.buffers()
        first = np.searchsorted(at, np.cumsum([0, *(len(b) + 1 for b in bodies)]))
        ends, values = np.frombuffer(edge, np.int64, len(size) + 1)[first].tolist(), memoryview(values)
        return [bytes(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _cut(body: bytes) -> Iterator[bytes]:
    """A long text in pieces of some AT_ONCE bytes, between words."""
    at = 0
    while m := _WHITE.search(body, at + AT_ONCE):
        yield body[at : m.start()]
        at = m.end()
    yield body[at:]


def _parts(bodies: list[bytes]) -> tuple[bytearray, np.ndarray, np.ndarray]:
    """The texts' bytes without white space, and where each part begins in the texts, with one byte between two of them, and its size."""
    data = bytearray(b" ".join(bodies) + b" ")
    raw = np.frombuffer(data, np.uint8)
    kind = np.frombuffer(data.translate(_KIND.tobytes()), np.uint8)
    lead = np.flatnonzero(raw == 0xC3)
    second = raw[lead + 1]
    lead = lead[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]  # all but the signs of times and division
    kind[lead] = kind[lead + 1] = _LETTER
    if len(odd := np.flatnonzero(kind == _ODD)):
        gap = np.concatenate(([-1], np.flatnonzero(kind == _SPACE)))
        k = np.unique(np.searchsorted(gap, odd))
        first, n = gap[k - 1] + 1, gap[k] - gap[k - 1] - 1
        kind[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)] = _ODD
    upper = lead[(raw[lead + 1] < 0x9F) & (kind[lead] == _LETTER)] + 1
    raw[upper] += 0x20
    cut = kind == _DIGIT
    cut[1:] |= kind[1:] != kind[:-1]
    cut[0] = True
    at = np.flatnonzero(cut)
    size, own = np.diff(at, append=len(raw)), kind[at] != _SPACE
    return data.translate(None, _BLANK), at[own], size[own]
