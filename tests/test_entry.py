"""The driver's contract, and the catalogue against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from wanderframe.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    mine = [tuple(plain(x) for x in r) for r in got.select(*cols).collect()]
    c = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    theirs = [tuple(plain(r[i]) for i in at) for r in c.fetchall()]
    assert sorted(mine, key=key) == sorted(theirs, key=key)
