"""Every core query against its SQL on the smallest tables, and the driver's three functions."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestrand.plans import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def canon(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, (str, bool, pd.Timestamp)):
            return str(v)
        try:
            return f"{round(float(v), 5):.5f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted("|".join(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, small, db, name):
    got = catalogue.queries()[name](spark, small).toPandas()
    want = db.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())
