"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, slice int, body string, digest string, words string"


def texts(seed: int = 5, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "über", "né", "a"] + ["".join(rng.choice(["th", "er", "ou", "in", "st", "ä"]) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    out: list[str | None] = [None, "", " ", "\n\n", "a", "x" * 3000, "ab" * 900 + "c", "ab" * 900 + "d", "one two", "one two", "one two three four five"]
    for _ in range(n):
        kind, body = rng.random(), prose(rng.randint(1, 160))
        if kind < 0.2:
            body = out[rng.randrange(len(out))] or ""
        elif kind < 0.4:
            words = (out[rng.randrange(len(out))] or "w").split() or ["w"]
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            body = " ".join(words)
        elif kind < 0.6:
            body = f"{body}\n{passage}\n{prose(20)}"
        out.append(body)
    out.append(prose(9000))
    return out


def documents(spark, bodies=None, ids=None):
    bodies = texts() if bodies is None else bodies
    ids = list(range(len(bodies))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, "b", "d", "w") for i, t in zip(ids, bodies, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
