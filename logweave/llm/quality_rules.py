"""Operator 2: quality rules as one projection of Spark's own functions.

``RULES`` is a table of (name, measure, least, most). ``quality`` compiles it into one boolean; nothing leaves the JVM,
and there is no shuffle.

A word is a run of characters other than space and the bytes 9 to 13. Words in three-word windows that the text has twice
or more are found in two steps: each window becomes one number, 44 bits of its hash and 20 of its place, and the numbers are
sorted, so that windows which may be equal are neighbours; only those are then sorted as texts. (Of a text with more than
2**20 words all windows are sorted as texts.) So no two different windows count as equal.

Null texts have no words and fail the base rule. Texts of any length are judged whole, ties and repeated rows row by row; an
empty table gives no rows. All columns of docs stay; the measures are added, and a column of docs with the name of one of
them is replaced. A filter on the columns of docs reaches the scan; one on the measures runs above them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: A text that breaks one of them goes.
RULES = (
    Rule("word length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols for each word", "symbol_ratio", None, 0.25),
    Rule("repeated lines", "dup_line_ratio", None, 0.5),
    Rule("stop words", "n_stop_words", 2, None),
)
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was with be as on by are at from this have not or an "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es "
    "le la les de des et un une que pour dans qui par plus est au sur pas "
    "el los las del que en por con una se no su para como más"
).split()
#: Bits of a window's place among a text's windows.
PLACE = 20
SPACE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "n_stop_words": F.col("n_stop_words"),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the measures keep all rules."""
    measures, out = _measures(), F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (measures[r.measure] >= r.least)
        if r.most is not None:
            out = out & (measures[r.measure] <= r.most)
    return out


def _once(*columns: Column) -> Column:
    """The columns as a generator of one row: they are computed once there, however often and for whatever filter they are
    used above it, while filters on the other columns still go below it."""
    return F.inline(F.array(F.struct(*columns)))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed, kept."""
    own = [c for c in docs.columns if c not in {"n_words", *BASE, "n_lines", "n_stop_words", "base_failed", "kept"}]
    body = F.coalesce(F.col(text), F.lit(""))
    blank = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACE, body)
    # a symbol is one byte; a text without it is not copied
    symbols = reduce(lambda n, c: n + F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit(""))), SYMBOLS, F.lit(0))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.select(
        *(F.col(c).alias(f"own_{i}") for i, c in enumerate(own)),
        F.array_remove(F.split(blank, " ", -1), "").alias("words"),
        lines.alias("lines"),
        symbols.cast("long").alias("n_symbols"),
    )
    n_windows = F.greatest(F.size("words") - 2, F.lit(0))
    word = lambda i: F.get(F.col("words"), i)
    number = lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)).bitwiseAND(F.lit(-(1 << PLACE))).bitwiseOR(i.cast("long"))
    few = F.size("words") <= 1 << PLACE
    numbers = F.when(few, F.sort_array(F.transform(F.slice(F.col("words"), 1, n_windows), number)))
    kept = [F.col(f"own_{i}") for i in range(len(own))]
    two = one.select(
        *kept,
        _once(
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.col("n_symbols"),
            F.size("words").cast("long").alias("n_words"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            numbers.alias("numbers"), F.col("words").alias("words"),
        ),
    )
    counts = [F.col(c) for c in ("word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop_words")]
    hashed = lambda x: F.shiftright(x, PLACE)
    near = lambda x, i, d: hashed(x).eqNullSafe(hashed(F.get(F.col("numbers"), i + d)))
    alike = F.transform(F.filter(F.col("numbers"), lambda x, i: ((i > 0) & near(x, i, -1)) | near(x, i, 1)), lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))
    every = F.filter(F.sequence(F.lit(0), n_windows), lambda i: i < n_windows)
    window = lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i"))
    two = two.select(*kept, _once(*counts, F.sort_array(F.transform(F.coalesce(alike, every), window)).alias("sorted")))
    same = lambda x, i, d: x["w"].eqNullSafe(F.get(F.col("sorted"), i + d)["w"])
    twice = F.filter(F.col("sorted"), lambda x, i: ((i > 0) & same(x, i, -1)) | same(x, i, 1))
    three = two.select(*kept, _once(*counts, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at")))
    # a window's words up to the next window's first
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    four = three.select(*kept, _once(*counts, covered.cast("long").alias("n_repeat_words")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return four.select(
        *(F.col(f"own_{i}").alias(c) for i, c in enumerate(own)),
        "n_words", *BASE, "n_lines", "n_stop_words",
        failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"),
    )
