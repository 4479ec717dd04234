"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest
from conftest import DATA

import taqlspark.table_queries  # noqa: F401
from taqlspark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    found = sql.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    ours = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    theirs = sorted(repr([norm(dict(zip(found.columns, r, strict=True))[c]) for c in sorted(df.columns)]) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
