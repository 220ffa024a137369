"""Every core query runs on the smallest tables and agrees with its SQL."""

import glob
import os

import pytest

from mentionlake.plans import catalogue, landed  # noqa: F401


def same(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if x is None or x != x else f"{float(x):.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLES:
        want = con.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and same(got) == same(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["source", "level", "docs", "confidence"]
