"""Every registered query of the library runs; those with SQL give DuckDB's rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from corpusforge import plans
from corpusforge.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, order):
    def one(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else str(v)

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLE:
        assert rows is not None
        return
    want = duck.sql(plans.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert normal(rows, [df.columns.index(c) for c in cols]) == normal(want.fetchall(), [want.columns.index(c) for c in cols])


def test_entry_registers_every_query():
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
