"""The driver contract, and every query with SQL against that SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from archivum.sources.fixtures import TABLES

TINY = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def norm(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, TINY)
    cols = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    ours = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert ours == sorted((tuple(norm(r[i]) for i in order) for r in want.fetchall()), key=str)
