"""One query for each operator of this subpackage, over its whole table, and DuckDB SQL where SQL can say the same.

op1, op3, op4, op5, op6, op8 and op10 have no SQL: tokenizers, compression, the filter's scores and byte removal can't be
said in it, and links of all pairs of documents are too slow there. ``tests/llm`` holds them against brute force, the
tokenizers' libraries and exact round trips.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm.byte_bpe import byte_bpe
from logweave.llm.exact_dedup import exact_groups
from logweave.llm.license_scan import license_scan
from logweave.llm.lm_score import lm_scores
from logweave.llm.ngram_join import ngram_components
from logweave.llm.packing import pack
from logweave.llm.quality_rules import RULES, STOP_WORDS, quality
from logweave.llm.suffix_dedup import suffix_dedup
from logweave.llm.token_tables import read_shards, write_shards
from logweave.llm.url_rules import PATTERNS, PREFIXES, judge
from logweave.llm.word_tokens import vocabulary

BYTE_BPE, WORD_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return byte_bpe(documents(spark, sf_dir), vocabulary(BYTE_BPE), PATTERN, ids=False)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op5_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir), vocabulary(WORD_BPE))).drop("ids")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), texts=False)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary(WORD_BPE))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_quality_rules, op3_license_scan, op4_lm_score, op5_token_tables, op6_suffix_dedup, op7_exact_dedup, op8_packing, op9_url_rules, op10_ngram_join)}


_MEASURE = {"mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "n_stop_words": "n_stop_words"}


def _rules_sql() -> str:
    tests = [f"{_MEASURE[r.measure]} >= {r.least}" for r in RULES if r.least is not None] + [f"{_MEASURE[r.measure]} <= {r.most}" for r in RULES if r.most is not None]
    return " and ".join(tests)


def _text(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _quality_sql() -> str:
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from d),
placed as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from placed),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
repeated as (select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2)) o(k) group by doc_id),
m as (
  select w.doc_id, len(w)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words,
         len(list_filter(w, lambda x: lower(x) in ({_text(STOP_WORDS)})))::bigint as n_stop_words
  from w left join repeated r on w.doc_id = r.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and {_rules_sql()} as kept
from m"""


_EXACT_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(t) as text_sha256
from d window g as (partition by t)"""


def _url_sql() -> str:
    prefixes = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in PREFIXES)
    patterns = " ".join(f"when regexp_matches(lower(coalesce(url, '')), '{r.regex}') then '{r.verdict}'" for r in PATTERNS)
    return rf"""
with rest as (select page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as r from pages),
p as (
  select page_id, url, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) as path
  from rest),
rules(verdict, h, p) as (values {prefixes}),
fit as (
  select page_id, max_by(h || rules.p, length(h || rules.p)) as rule, max_by(verdict, length(h || rules.p)) as verdict
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, rules.p) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, case {patterns} else 'allow' end) as verdict
from p left join fit on p.page_id = fit.page_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _quality_sql(), "op7_exact_dedup": _EXACT_SQL, "op9_url_rules": _url_sql()}
