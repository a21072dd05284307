"""Every query with SQL returns the rows of that SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from keyloom import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def _rows(frame):
    def text(v):
        if hasattr(v, "tolist"):
            return str(v.tolist())
        return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), sql.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
