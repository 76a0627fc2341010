"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from textlake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if not hasattr(v, "shape") and not isinstance(v, (list, dict)) and pd.isna(v):
            return ""
        return f"{float(v):.6g}" if hasattr(v, "dtype") and v.dtype.kind in "if" or isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_oracle(spark, duck, name):
    mine, theirs = QUERIES[name].run(spark, SF).toPandas(), duck.sql(QUERIES[name].sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_every_query_has_sql():
    assert [n for n, q in QUERIES.items() if q.sql is None] == []


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
