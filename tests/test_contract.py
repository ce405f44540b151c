"""Every registered graph query against its SQL twin on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tallygraph import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


#: Law queries run whole algorithms for a minute each; test_tables.py tests these on small graphs.
TWINS = sorted(n for n in queries.ORACLE_SQL if not n.endswith("_law"))


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, db, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(str(tuple(None if x != x else float(x) if isinstance(x, (int, float)) else str(x) for x in r)) for r in d[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 1
