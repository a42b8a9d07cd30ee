"""Operator 3: licence scans by conditional compression.

1. *Blocks.* A block is the words around cues (``CUE``), across lines and paragraphs: as many to either side as the longest
   template has, so a notice that has a cue lies whole in a block. Cues whose surroundings meet share a block, until it has
   ``MOST`` times that many words; the next block then begins before its first cue again, and what both have counts once.
2. *Ranking.* Each block is compressed by itself and with each template as a raw zstandard dictionary. The templates are
   ranked by the share of the block's bytes that they save.
3. *Wording.* They are confirmed in this order by their wording, however little they save, as a notice may be a small part of
   its block: the template's words are aligned with the block's, and it holds if no more than one word in ``WORDS_FOR_ONE``
   differs (none in a shorter one) and no number in it does. The words of a template that holds are taken out of the block,
   and the rest is ranked anew, until nothing holds. So a block has any number of licences, and the words of a licence
   within a longer one (BSD with two and three clauses) are no further licence.

Words are compared in lower case, without articles and "version"; "licence" is "license", 2.0 is 2 and v3 is 3.

Texts without a cue never leave the JVM. Null and empty texts have no block; a block's size is bounded, however long the text
is. The result has a row for each row of docs, whatever its id, also for equal rows; other columns are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm._common import session
from logweave.llm.license_texts import TEMPLATES

WORDS_FOR_ONE, MOST = 15, 4
CUE = r"(?i)licen[sc]e|spdx|copyright|hereby[\W_]+granted|permission[\W_]+is|redistribution[\W_]+and[\W_]+use|public[\W_]+domain|creative[\W_]+commons|\bcc[\W_]*(by|0)\b|\b[al]?gpl|\b[em]pl\b|gnu[\W_]+general"
_WORD = re.compile(r"\d+(?:\.\d+)+|[^\W_]+")
_NUMBER = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0+)*")
_SILENT = frozenset(("a", "an", "the", "version", "v"))
_GONE = "\n"


def _said(word: str) -> str:
    number = _NUMBER.fullmatch(word)
    return number.group(1) if number else word.replace("licence", "license")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """The text's words as they are compared, and where each begins and ends."""
    found = [(w, m.start(), m.end()) for m in _WORD.finditer(text.lower()) if (w := _said(m.group())) not in _SILENT]
    return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def blocks(text: str, reach: int) -> list[tuple[int, list[str]]]:
    """The words around the text's cues, each block with the number of its first word."""
    text = text.lower()
    words, begins, ends = words_of(text)
    spans: list[list[int]] = []
    for m in re.finditer(CUE, text):
        # the words that the cue has a part of
        a, b = max(bisect_right(ends, m.start()) - reach, 0), min(bisect_left(begins, m.end()) + reach, len(words))
        if spans and a <= spans[-1][1] and b - spans[-1][0] <= MOST * reach:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, words[a:b]) for a, b in spans if a < b]


def _costs(template: list[str], block: list[str], anywhere: bool) -> np.ndarray:
    """For each place in the block the least price of edits from the template to words that end there (and begin anywhere, or with the block)."""
    words = np.array([*block, None], dtype=object)[:-1]
    steps = np.arange(len(block) + 1)
    cost = np.zeros(len(block) + 1, np.int64) if anywhere else steps.copy()
    for w in template:
        price = len(template) + 1 if any(c.isdigit() for c in w) else 1
        new = cost + price
        new[1:] = np.minimum(new[1:], cost[:-1] + np.where(words == w, 0, price))
        cost = np.minimum.accumulate(new - steps) + steps
    return cost


def differences(template: list[str], block: list[str]) -> tuple[int, bool]:
    """The least number of word edits from the template to any run of the block's words, and whether all its numbers stay."""
    best = int(_costs(template, block, True).min())
    return best, best <= len(template)


def aligned(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """The price of the best run of the block's words, and where it begins and ends."""
    cost = _costs(template, block, True)
    end = int(cost.argmin())
    back = _costs(template[::-1], block[:end][::-1], False)
    return int(cost[end]), end - int(back.argmin()), end


class Templates:
    def __init__(self, templates=TEMPLATES):
        distinct = {(name, tuple(words_of(text)[0])): None for name, text in templates}
        self.names, self.words = [n for n, _ in distinct], [list(w) for _, w in distinct]
        #: words of the longest run that a template may hold in
        self.reach = max((len(w) + len(w) // WORDS_FOR_ONE for w in self.words), default=0)
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]

    def ranked(self, words: list[str], which=None) -> list[tuple[float, int]]:
        """The share of the block's compressed bytes that each template saves, and its number; the most first, of equal ones the longest."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        which = range(len(self.names)) if which is None else which
        return sorted(((1 - len(self.given[k].compress(data)) / alone, k) for k in which), key=lambda x: (-x[0], -len(self.words[x[1]]), x[1]))

    def possible(self, words: list[str]) -> list[int]:
        """Templates that may hold: each of their words that the block doesn't have costs one edit at least."""
        known = set(words)
        return [k for k, own in enumerate(self.words) if sum(w not in known for w in own) <= len(own) // WORDS_FOR_ONE]

    def judge(self, words: list[str]) -> tuple[tuple[tuple[str, int, int, int], ...], float]:
        """What holds: (name, differing words, first word, end) each, and the saving of the first, or the best one where none does."""
        left, found, first = list(words), [], None
        while True:
            some = set(self.possible(left))
            if first is not None and not some:
                return tuple(found), first
            ranked = self.ranked(left, None if first is None else sorted(some))
            for saving, k in ranked:
                if k in some:
                    d, a, b = aligned(self.words[k], left)
                    if d <= len(self.words[k]) // WORDS_FOR_ONE:
                        found.append((self.names[k], d, a, b))
                        left[a:b] = [_GONE] * (b - a)
                        first = saving if first is None else first
                        break
            else:
                return tuple(found), ranked[0][0] if first is None else first


@lru_cache(2)
def _loaded(templates) -> Templates:
    return Templates(templates)


@lru_cache(2_000)
def _judged(templates, block: str):
    """A block's bytes are bounded by its words, so those that are remembered are, too."""
    return _loaded(templates).judge(block.split(" "))


def notices(text: str, templates=TEMPLATES) -> tuple[int, list[tuple[str, int]], float | None]:
    """How many blocks the text has, its notices (licence and differing words), and the best saving."""
    found: dict[tuple[str, int], tuple[int, int]] = {}
    best, own = None, blocks(text, _loaded(templates).reach)
    for at, words in own:
        held, saving = _judged(templates, " ".join(words))
        best = saving if best is None else max(best, saving)
        for name, d, a, b in held:
            # of one notice that two blocks have, the part that both share names it
            same = next((k for k, (end, _) in found.items() if k[0] == name and k[1] < at + b and at + a < end), None)
            if same is None:
                found[name, at + a] = (at + b, d)
            elif d < found[same][1]:
                found[same] = (found[same][0], d)
    return len(own), sorted((name, d) for (name, _), (_, d) in found.items()), best


def _scan(templates):
    def scan(batches):
        for b in batches:
            rows = [notices(text, templates) if text else (0, [], None) for text in b["text"].to_pylist()]
            names = [",".join(sorted({n for n, _ in held})) or None for _, held, _ in rows]
            columns = [b["doc_id"], pa.array([n for n, _, _ in rows], pa.int64()), pa.array(names, pa.string()), pa.array([s for _, _, s in rows], pa.float64()), pa.array([sum(d for _, d in held) for _, held, _ in rows], pa.int64()), pa.array([len(held) for _, held, _ in rows], pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "n_blocks", "licenses", "best_saving", "n_differences", "n_notices"])

    return scan


def license_scan(docs: DataFrame, templates=TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_blocks, licenses (sorted, joined by commas; null: none), best_saving, n_differences, n_notices for each row of docs."""
    session(docs.sparkSession)
    some = F.when(F.col(text).rlike(CUE), F.col(text)).alias("text")
    return docs.select(F.col(key).cast("long").alias("doc_id"), some).mapInArrow(_scan(templates), "doc_id long, n_blocks long, licenses string, best_saving double, n_differences long, n_notices long")
