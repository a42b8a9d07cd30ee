"""Operators 2, 7 and 9, which run in the JVM alone."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logweave.llm import exact_dedup, url_rules
from logweave.llm.exact_dedup import dedup, exact_groups, stream_state
from logweave.llm.quality_rules import quality
from logweave.llm.url_rules import PATTERNS, Pattern, Prefix, judge, tokens_of
from tests.llm.fixtures import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if count[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_equals_brute_force(spark):
    bodies = texts() + ["a b c a b c", "x\ny\nx\n\x0b\nx y", "# * <b> 😀 é", "one two three " * 40, "\u00a0 \x1c \u2003", "l\r\nl\r\nl"]
    rows = quality(documents(spark, bodies)).collect()
    for r in rows:
        want = base(bodies[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, bodies[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert len(rows) == len(bodies) and {"lang", "words", "chunk"} <= set(rows[0].asDict())
    assert quality(documents(spark).limit(0)).collect() == []


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    least = float("-inf")
    top = {t: max(ids, key=lambda i: least if i is None else i) for t, ids in by.items()}
    return sorted(((i, top[t or ""], len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def test_exact_dedup(spark):
    bodies = texts() + ["a", None, "one two", "é", "e\u0301"]
    rows = list(enumerate(bodies)) + [(None, "a"), (None, "solo"), (3, "\n\n")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == groups(rows)
    stay = Counter(r.text_sha256 for r in got if r.kept)
    assert set(stay.values()) == {1} and len(stay) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(t or "" for t in (r.text for r in kept.collect())) == sorted({t or "" for _, t in rows})


def test_exact_dedup_of_nothing(spark):
    assert exact_groups(documents(spark).limit(0)).collect() == []
    assert dedup(documents(spark).limit(0)).collect() == []


def test_state_goes_on_with_new_rows(spark, tmp_path):
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    schema = "digest string, doc_id long, locator long"
    spark.createDataFrame([("x", 1, 1), ("y", 5, 2)], schema).coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(schema).parquet(source)
    assert {r.digest: (r.last.doc_id, r.group_size) for r in stream_state(read(), state).collect()} == {"x": (1, 1), "y": (5, 1)}
    spark.createDataFrame([("x", 7, 3), ("z", 2, 4), ("y", 3, 5)], schema).coalesce(1).write.mode("append").parquet(source)
    assert {r.digest: (r.last.doc_id, r.group_size) for r in stream_state(read(), state).collect()} == {"x": (7, 2), "y": (5, 2), "z": (2, 1)}


def test_url_rules(spark):
    want = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no-scheme/en/": ("", "", None, "allow"),
        "http://A.Example.COM/en/701?x": ("a.example.com", "/en/701", "example.com/en/7", "allow"),
        "http://a.example.com/en/801": ("a.example.com", "/en/801", "com/en/", "block"),
        "http://badexample.com/en/7": ("badexample.com", "/en/7", "com/en/", "block"),
        "http://example.com/EN/7": ("example.com", "/EN/7", None, "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "https://x.example.net/de/80#t": ("x.example.net", "/de/80", "example.net/de/8", "block"),
        "https://x.example.net/de/70": ("x.example.net", "/de/70", "net/de/", "allow"),
        "https://y.org/es/1": ("y.org", "/es/1", "org/es/", "block"),
        "https://y.org?/es/1": ("y.org", "", None, "allow"),
        "https://spam-farm.example.org/en/1": ("spam-farm.example.org", "/en/1", None, "block"),
        "https://ads-track.net/fr/1://b.com/en/": ("ads-track.net", "/fr/1://b.com/en/", None, "block"),
        "https://q.org/fr/1?a=1&utm_source=feed": ("q.org", "/fr/1", None, "block"),
        "https://q.org/fr/1?xutm_source=feeder": ("q.org", "/fr/1", None, "allow"),
        "x://h\n.com/en/\n": ("h\n.com", "/en/\n", "com/en/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "p", "v", "t") for i, u in enumerate(want)], "page_id long, url string, path string, verdict string, tokens string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in judge(pages).collect()}
    assert got == want
    assert judge(pages.limit(0)).collect() == []
    assert {r.verdict for r in judge(pages, (), (), "block").collect()} == {"block"}
    own = judge(pages, (Prefix("block", "org", "/"),), (Pattern("allow", "^https"),), "block")
    assert {r.url: r.verdict for r in own.collect()}["https://x.example.net/de/70"] == "allow"


def test_url_patterns_whose_literal_goes_on(spark):
    urls = ["https://ad-tracker.example.com/", "https://ads-tracking.net/", "https://ads-track.net/", "https://track.net/", "https://x.org/retrack"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert [r.verdict for r in judge(pages).orderBy("page_id").collect()] == ["block", "block", "block", "allow", "allow"]
    own = judge(pages, (), (Pattern("block", "rack"), Pattern("block", "ads-track")))
    assert [r.verdict for r in own.orderBy("page_id").collect()] == ["block"] * 5


def test_dedup_stops_on_a_collision_of_digests(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda text="text": F.lit("same"))
    with pytest.raises(Exception, match="different texts with digest"):
        dedup(documents(spark, ["one", "two", "one"])).collect()
    assert len(dedup(documents(spark, ["one", "one"])).collect()) == 1


def test_tokens_that_a_pattern_closes_on_both_sides():
    of = lambda regex: [set(x) for x in tokens_of(Pattern("block", regex))]
    assert [[set(x) for x in tokens_of(p)] for p in PATTERNS] == [[{"spam"}], [{"ad"}, {"ads"}], [{"feed", "source", "utm"}]]
    assert of("track") == of("/track") == of("track/") == of("/tra[ck]/") == of("/(?i)TRACK/") == of("/trac(?=k)k/") == of("(") == [set()]
    assert of("/track/") == of("^track$") == of("[/?]track[&=]") == [{"track"}]
    assert of("/a?b/") == [{"ab"}, {"b"}] and of("/(aa|b[c-e])/") == [set(), {"aa"}]
    assert tokens_of(Prefix("block", "a-b.com", "/En/7")) == [frozenset({"a", "b", "com", "en"})]


@pytest.mark.parametrize("most", [url_rules.LITERAL, 0])
def test_url_rules_equal_all_rules_run_on_all_urls(spark, monkeypatch, most):
    monkeypatch.setattr(url_rules, "LITERAL", most)
    rng = random.Random(4)
    words = ["ad", "ads", "track", "tracker", "spam", "x", "com", "net", "en", "De", "7", "70", "feed"]
    pick = lambda: rng.choice(words)
    urls = [rng.choice(["https://", "HTTP://", "", "ftp:"]) + rng.choice([".", "-"]).join(pick() for _ in range(rng.randint(1, 3))) + "".join(rng.choice("/?#&=") + pick() + rng.choice(["", "-" + pick(), "." + pick()]) for _ in range(rng.randrange(4))) for _ in range(400)]
    urls += ["https://ad-tracker.com/fr/1", "https://ads-tracking.example.org/fr/2", "https://ad-tracker.com/fr/1", None, "", "https://" + "x" * 20_000 + ".com/en/"]
    prefixes = tuple({r.text: r for r in (Prefix(rng.choice(["block", "allow"]), ".".join(pick().lower() for _ in range(rng.randint(1, 2))), "".join("/" + pick() + rng.choice(["", "/"]) for _ in range(rng.randrange(3)))) for _ in range(25))}.values())
    patterns = (*PATTERNS, Pattern("allow", "/(en|x)[-/]"), Pattern("block", "track(er)?$"), Pattern("block", "[a-d]s[-.]track"), Pattern("allow", "[?&]feed(=|$)"))

    def plain(url):
        url = url or ""
        rest = url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.lower()
        fit = [r for r in prefixes if "://" in url and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.text), r.text), default=None)
        found = [p.verdict for p in patterns if re.search(p.regex, url.lower())]
        return host, path, best and best.text, best.verdict if best else found[0] if found else "allow"

    pages = spark.createDataFrame([(i % 7 or None, u, "a", "b", "c", "d", "e") for i, u in enumerate(urls)], "page_id long, url string, tokens string, url_text string, fit string, prefix string, rule string").repartition(3)
    got = judge(pages, prefixes, patterns).select("page_id", "url", "host", "path", "rule", "verdict", "fit").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i % 7 or None, u, *plain(u), "c") for i, u in enumerate(urls)), key=key)
    assert {plain(u)[3] for u in urls} == {"allow", "block"} and any(plain(u)[2] for u in urls)
