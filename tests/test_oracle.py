"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from curato import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 6) if hasattr(value, "__float__") else str(value)


def _rows(frame):
    return sorted(map(str, (tuple(map(_cell, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    found = catalog.queries()[name](spark, sf).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert _rows(found) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
