"""Queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from observatory.plans import lists_oracle, operations, oracle, reports, streams
from observatory.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE_SQL = oracle.ORACLE_SQL | lists_oracle.ORACLE_SQL | streams.ORACLE_SQL | operations.ORACLE_SQL | reports.ORACLE_SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert left == right


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
