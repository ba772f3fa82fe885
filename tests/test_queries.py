"""Every registered query of the library against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from tidewright.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted([plain(x) for x in r] for r in df.select(*[f"`{c}`" for c in columns]).collect()) == sorted([plain(x) for x in r] for r in want.fetchall())


def test_entry_registers_the_library():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
