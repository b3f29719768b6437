"""Every registered query against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry
from runweave.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ["lineitem", "orders", "supplier", "events", "documents"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    none = df.astype(object).where(df.notna(), None)
    return sorted(none.itertuples(index=False, name=None), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(_rows(got), _rows(want)):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["pos", "v"]
