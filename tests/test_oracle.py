"""Every query with SQL gives the rows that DuckDB does, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows

MINE = {k for m in entry._modules() if not m.__name__.startswith("siftspark.llm") for k in m.QUERIES}
SQL = {k: v for k, v in entry.oracle_sql().items() if k in MINE}


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
