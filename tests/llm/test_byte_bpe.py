from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN

from logweave.llm.byte_bpe import ByteBpe, byte_bpe, read_ranks
from logweave.llm.word_tokens import vocabulary
from tests.llm.fixtures import documents, texts

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    return ByteBpe.load(PATH, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def ids(bpe, text):
    return np.frombuffer(bpe.encode([text])[0], "<u4").tolist()


def test_equals_the_library(both):
    bpe, own = both
    rng = random.Random(2)
    odd = ["", " " * 999, "\n" * 257 + "a", "a" * 5000, "ab" * 3000, "don't   stop\t\t", "日本語テキスト", "😀😀 é é", "\x00\x01", "<|endoftext|>", "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(4000)), "".join(rng.choice("aeiouthrn") for _ in range(20000))]
    for t in odd + [t or "" for t in texts()]:
        assert ids(bpe, t) == own.encode_ordinary(t)
        assert bpe.decode(bpe.encode([t])[0]) == t.encode()


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_any_text(both, t):
    assert ids(both[0], t) == both[1].encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.integers(0, 5))
def test_small_vocabularies_of_any_shape(data, seed):
    rng = random.Random(seed)
    ranks = {bytes([i]): i for i in range(256)}
    body = bytes(x % 3 + 97 for x in data)
    while len(ranks) < 256 + 25:
        a, b = (rng.choice([t for t in ranks if set(t) <= set(b"abc")]) for _ in range(2))
        ranks.setdefault(a + b, len(ranks))
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert list(ByteBpe(ranks, r"(?s).+").encode_piece(body)) == own.encode_ordinary(body.decode())


def test_table(spark, both):
    bodies = texts()
    rows = sorted(byte_bpe(documents(spark, bodies), PATH, PATTERN).collect())
    for r, t in zip(rows, bodies, strict=True):
        want = np.asarray(both[1].encode_ordinary(t or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), want)
    assert byte_bpe(documents(spark).limit(0), PATH, PATTERN).collect() == []


def test_long_runs_go_through_slabs(monkeypatch, both):
    from logweave.llm import byte_bpe as module

    monkeypatch.setattr(module, "SLAB", 50)
    rng = random.Random(2)
    bpe, own = both
    for alphabet in ("ab", "the", "abcdefghijklmnopqrstuvwxyz"):
        run = "".join(rng.choice(alphabet) for _ in range(3000))
        assert list(np.frombuffer(bpe.encode([run])[0], "<u4")) == own.encode_ordinary(run)
    assert max(map(len, bpe.memo), default=0) <= 256


def test_null_and_repeated_ids_and_clashing_columns(spark):
    docs = documents(spark, ["a b", "a b", None, ""], [None, 3, 3, None]).selectExpr("*", "1 as n_tokens", "'x' as ids_sha256")
    rows = byte_bpe(docs, PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (0, 2), (3, 0), (3, 2)]
    assert byte_bpe(documents(spark).limit(0), PATH, PATTERN).collect() == []
