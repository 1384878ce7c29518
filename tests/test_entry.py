"""The catalogue: every query runs on the smallest tables, and those with SQL give the same rows there."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from strandloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(df):
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).values.tolist())


def test_names():
    q, s = catalogue.queries(), catalogue.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.execute(sql).df())
    assert math.isfinite(len(got))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
