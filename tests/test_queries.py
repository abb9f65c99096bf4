"""Every registered query with a SQL twin gives the same rows on the smallest tables."""

import math
import os
from datetime import date, datetime

import duckdb
import pytest

from quillfold.plans import core

SQL = core.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in os.listdir(small):
        c.execute(f"create view {p[:-8]} as select * from read_parquet('{small}/{p}')")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, small, duck, name):
    df = core.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == cols
        assert got == sorted(tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
