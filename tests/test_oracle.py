"""Every registered library query against its SQL on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from photolake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    asked = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in asked.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str) == want
