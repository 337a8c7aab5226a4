"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from impressa.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(rows, names):
    def one(v):
        return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v if isinstance(v, (int, bool, type(None))) else str(v)

    return sorted((tuple(one(r[n]) for n in names) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got, names = df.collect(), sorted(df.columns)
    if name in catalogue.ORACLE:
        r = duck.execute(catalogue.ORACLE[name])
        cols = [x[0] for x in r.description]
        assert sorted(cols) == names
        assert plain(got, names) == plain([dict(zip(cols, x, strict=True)) for x in r.fetchall()], names)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
