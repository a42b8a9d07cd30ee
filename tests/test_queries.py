"""Every query that has SQL gives DuckDB's rows, values compared as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return int(x) if isinstance(x, int) else None if x is None else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    rel = duck.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want) and got == want


def test_all_names_have_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
