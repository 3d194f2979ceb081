"""Every registered query of the core against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from spindrift.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    num = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert got == sorted(tuple(plain(num(r[i])) for i in at) for r in rel.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_rows(con, name):
    """No query is held against nothing, and none against one constant for all rows."""
    rel = con.sql(ORACLES[name])
    rows = rel.fetchall()
    assert rows and (len(rows) < 3 or len(set(map(str, rows))) > 1)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6 and set(e.oracle_sql()) <= set(e.queries())
