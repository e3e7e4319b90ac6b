"""Queries against their SQL on the smallest tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [str(r) for r in rows(got)] == [str(r) for r in rows(want)]


def test_every_query_is_named_once(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
    assert os.path.exists(SF)
