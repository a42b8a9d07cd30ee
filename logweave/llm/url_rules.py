"""Operator 9: URL filters by rules that are found through their rarest literal token.

Two kinds of rules: host and path prefixes (``Prefix``), where the longest that fits wins, and patterns (``Pattern``) of which
the first that is found decides on the rest. A token is a run of a-z and 0-9 in the lower-cased URL. From each rule follow
the tokens that every URL which it fits has as whole ones: a prefix's host and path without a last token that may go on, and
of a pattern those literals that its regular expression closes on both sides (``tokens_of``; for ``(ads|ad)-`` one of two).
A rule is indexed by those of its tokens that the fewest URLs have; one without any is tried on every URL.

A URL's tokens fetch its candidate rules, and only those are compared or run their regular expression. Up to ``LITERAL``
rules the index is a literal map, and judging is one projection without a shuffle. A larger set of rules is a table: the
distinct URLs that have an indexed token are joined with it by token, and the pages with the results by URL. Both ways give
the same rows, and no number of rules is too large. Counts of tokens are taken over all URLs, in one aggregation whose
result has as many rows as the rules have tokens.

A host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, its A-Z lower-cased; the path
goes on from there to ``?``, ``#`` or the end. For null, or without ``://``, both are empty and no prefix fits; patterns are
tried on the empty text for null. Of prefixes of one length that fit, the greatest text wins. Rows are judged one by one,
also equal ones, and URLs of any length as a whole; an empty table gives no rows. All columns of pages stay; those with the
names of the results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _parser

#: Rules that become literals of a projection; more are a table.
LITERAL = 500
#: Alternatives that a pattern is written out into, at most; one with more has no token.
ALTERNATIVES = 64
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Prefix:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    """A regular expression over the lower-cased URL, in the syntax that Java's and Python's have in common."""

    verdict: str
    regex: str


PREFIXES = (
    Prefix("block", "com", "/en/"),
    Prefix("allow", "example.com", "/en/7"),
    Prefix("allow", "net", "/de/"),
    Prefix("block", "example.net", "/de/8"),
    Prefix("block", "org", "/es/"),
)
PATTERNS = (
    Pattern("block", r"://([^/?#]*\.)?spam-[^/?#]*"),
    Pattern("block", r"://([^/?#]*\.)?(ads|ad)-track[^/?#]*"),
    Pattern("block", r"[?&]utm_source=feed(&|#|$)"),
)
DEFAULT = "allow"
#: In a pattern that is written out: a place where no token goes on, and one of which nothing is known.
_EDGE, _OPEN = "|", "*"


def parts(url: str = "url") -> tuple[Column, Column]:
    """host and path."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _plain(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _tokens(text: Column, known: list[str]) -> Column:
    """The text's distinct tokens that rules are indexed by."""
    return F.filter(F.array_distinct(F.split(text, "[^a-z0-9]+", -1)), lambda t: t.isin(known)) if known else F.array().cast("array<string>")


def _class(items) -> str:
    """What a character class may be: no token character, or open."""
    if items[0][0] is _c.NEGATE:
        return _OPEN
    for kind, value in items:
        low, high = (value, value) if kind is _c.LITERAL else value if kind is _c.RANGE else (0, 128)
        if high > 127 or any(chr(x).isalnum() for x in range(low, high + 1)):
            return _OPEN
    return _EDGE


def _written(parsed) -> list[str]:
    """The pattern's alternatives as texts: its literal token characters, _EDGE and _OPEN."""
    out = [""]
    for kind, value in parsed:
        if kind is _c.LITERAL:
            one = [chr(value) if _TOKEN.fullmatch(chr(value)) else _OPEN if chr(value).isalnum() else _EDGE]
        elif kind is _c.IN:
            one = [_class(value)]
        elif kind is _c.BRANCH:
            one = [x for branch in value[1] for x in _written(branch)]
        elif kind is _c.SUBPATTERN and not (value[1] or value[2]):
            one = _written(value[3])
        elif kind is _c.MAX_REPEAT and value[:2] == (0, 1):
            one = ["", *_written(value[2])]
        elif kind is _c.AT and value in (_c.AT_BEGINNING, _c.AT_BEGINNING_STRING, _c.AT_END, _c.AT_END_STRING):
            one = [_EDGE]
        else:
            one = [_OPEN]
        if len(out) * len(one) > ALTERNATIVES:
            return [_OPEN]
        out = [a + b for a in out for b in one]
    return out


def tokens_of(rule: Prefix | Pattern) -> list[frozenset[str]]:
    """For each way in which the rule may fit, the whole tokens that the URL then has; any set may be empty."""
    if isinstance(rule, Prefix):
        path = _TOKEN.findall(rule.path.lower())
        last = 1 if path and _TOKEN.fullmatch(rule.path.lower()[-1]) else 0
        return [frozenset({*_TOKEN.findall(rule.host.lower()), *path[: len(path) - last]})]
    try:
        ways = _written(_parser.parse(rule.regex))
    except (re.error, OverflowError):
        ways = [_OPEN]
    whole = re.compile(r"(?<=\|)[a-z0-9]+(?=\|)")
    return sorted({frozenset(whole.findall(w)) for w in ways}, key=sorted)


def index(pages: DataFrame, rules: tuple, url: str = "url") -> dict[str, list[int]]:
    """Numbers of the rules by token; those that every URL has to try at ""."""
    ways = [tokens_of(r) for r in rules]
    known = sorted({t for w in ways for tokens in w for t in tokens})
    seen = pages.select(F.explode(_tokens(_plain(F.col(url)), known)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    count = {r.token: r.n for r in seen.toLocalIterator()} if known else {}
    out: dict[str, list[int]] = {}
    for k, w in enumerate(ways):
        chosen = {min(tokens, key=lambda t: (count.get(t, 0), t), default="") for tokens in w}
        for token in [""] if "" in chosen else sorted(chosen):
            out.setdefault(token, []).append(k)
    return out


_RULE = "at int, host string, path string, regex string, size int, rule string, verdict string"


def _row(k: int, r: Prefix | Pattern) -> tuple:
    return (k, r.host, r.path, None, len(r.text), r.text, r.verdict) if isinstance(r, Prefix) else (k, None, None, r.regex, None, None, r.verdict)


def _fits(r: Column, text: Column) -> Column:
    """Whether a fetched rule fits the row's host and path, or is found in its text."""
    prefix = ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"])
    return F.when(r["regex"].isNull(), prefix).otherwise(F.regexp(text, r["regex"]))


def _longest(r: Column) -> Column:
    return F.when(r["regex"].isNull(), F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))


def _earliest(r: Column) -> Column:
    return F.when(r["regex"].isNotNull(), F.struct(r["at"].alias("at"), r["verdict"].alias("verdict")))


def _by_literals(named: DataFrame, rules: tuple, found: dict[str, list[int]]) -> DataFrame:
    """named with the best prefix and the first pattern, by a literal map from token to rules."""
    lit = lambda row: F.struct(*(F.lit(v).cast(kind.split()[1]).alias(kind.split()[0]) for v, kind in zip(row, _RULE.split(", "), strict=True)))
    known = sorted(t for t in found if t)
    every = F.array(*(F.lit(k) for k in found.get("", []))).cast("array<int>")
    numbers = every
    if known:
        of = F.create_map(*(x for t in known for x in (F.lit(t), F.array(*(F.lit(k) for k in found[t])))))
        numbers = F.array_distinct(F.concat(every, F.flatten(F.transform("tokens", lambda t: F.element_at(of, t)))))
    table = F.array(*(lit(_row(k, r)) for k, r in enumerate(rules)))
    fit = F.filter(F.transform(numbers, lambda k: F.get(table, k)), lambda r: _fits(r, F.col("url_text")))
    named = named.withColumn("fit", fit)
    return named.withColumn("prefix", F.array_max(F.transform("fit", _longest))).withColumn("pattern", F.array_min(F.transform("fit", _earliest)))


def _by_table(named: DataFrame, rules: tuple, found: dict[str, list[int]]) -> DataFrame:
    """The same by joins: distinct URLs with the rules' table by token, and the pages with what fits by URL."""
    spark = named.sparkSession
    rows = [(t, *_row(k, rules[k])) for t, numbers in found.items() for k in numbers]
    table = spark.createDataFrame(rows, f"token string, {_RULE}").select("token", F.struct(*(F.col(kind.split()[0]) for kind in _RULE.split(", "))).alias("r"))
    urls = named.select("url_text", "host", "path", "tokens").distinct()
    asked = urls.withColumn("token", F.explode(F.array_append("tokens", F.lit("")) if "" in found else F.col("tokens")))
    fit = asked.join(table, "token").where(_fits(F.col("r"), F.col("url_text")))
    best = fit.groupBy("url_text", "host", "path").agg(F.max(_longest(F.col("r"))).alias("prefix"), F.min(_earliest(F.col("r"))).alias("pattern"))
    return named.join(best, ["url_text", "host", "path"], "left")


def judge(pages: DataFrame, prefixes: tuple[Prefix, ...] = PREFIXES, patterns: tuple[Pattern, ...] = PATTERNS, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """pages with host, path, rule (host and path of the prefix that wins) and verdict."""
    rules = tuple(prefixes) + tuple(patterns)
    found = index(pages, rules, url)
    host, path = parts(url)
    text = _plain(F.col(url))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    named = pages.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(own)), host.alias("host"), path.alias("path"), text.alias("url_text"), _tokens(text, sorted(t for t in found if t)).alias("tokens"))
    if not rules:
        judged = named.select("*", F.lit(None).cast("struct<size: int, rule: string, verdict: string>").alias("prefix"), F.lit(None).cast("struct<at: int, verdict: string>").alias("pattern"))
    else:
        judged = (_by_literals if len(rules) <= LITERAL else _by_table)(named, rules, found)
    verdict = F.coalesce("prefix.verdict", "pattern.verdict", F.lit(default))
    return judged.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(own)), "host", "path", F.col("prefix.rule").alias("rule"), verdict.alias("verdict"))
