"""Every query of the subpackage with SQL gives the rows that DuckDB does, and every other one runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows

MODULES = [m for m in entry._modules() if m.__name__.startswith("siftspark.llm")]
SQL = {k: v for m in MODULES for k, v in getattr(m, "ORACLE", {}).items()}
OTHERS = [k for m in MODULES for k in m.QUERIES if k not in SQL]


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, folder, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, want = entry.queries()[name](spark, folder), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


#: What the queries without SQL give: their columns, of which the first are a key without nulls.
KEYS = {
    "p1_found": 3, "p1_links": 3, "p1_overlap": 4, "p1_report": 2, "p2_found": 1, "p2_tiles": 1, "p3_found": 2, "p3_cells": 1, "p6_forest": 2, "p6_splits": 2, "p6_shares": 1,
    "p7_ids": 1, "p7_spans": 1, "p8_mix": 3, "p8_blocks": 6, "p8_shares": 1, "p8_lag": 1, "p9_found": 1, "p9_types": 1, "p9_functions": 1, "p9_halves": 3,
}


def test_all_are_named():
    assert set(KEYS) == set(OTHERS)


@pytest.mark.parametrize("name", OTHERS)
def test_rows_have_keys(spark, folder, name):
    """Rows come out, none twice, with the whole key; and again the same rows from the same tables."""
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    keys = [tuple(r)[: KEYS[name]] for r in got]
    assert got and len(set(keys)) == len(keys) and all(v is not None for k in keys for v in k[:2])
    if name in ("p6_splits", "p8_mix", "p2_found", "p9_found"):
        again = entry.queries()[name](spark, folder)
        assert sorted(map(str, again.collect())) == sorted(map(str, got))
