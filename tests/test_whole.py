"""Queries of the trade graph read whole tables."""

import os

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from tallygraph import queries
from tallygraph.sources import trade

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def counts():
    """Vertices and edges of the whole table, without Spark."""
    cust = dict(zip(*[pq.read_table(f"{DATA}/orders.parquet").column(c).to_pylist() for c in ("o_orderkey", "o_custkey")]))
    lines = zip(*[pq.read_table(f"{DATA}/lineitem.parquet").column(c).to_pylist() for c in ("l_orderkey", "l_partkey", "l_suppkey")])
    e = set()
    for o, p, s in lines:
        if o in cust:
            e |= {("c", cust[o], "p", p), ("c", cust[o], "s", s), ("p", p, "s", s)}
    return len({x[:2] for x in e} | {x[2:] for x in e}), len(e)


def test_edges_are_whole_by_default(spark):
    assert trade.edges(spark, DATA).count() == counts()[1]


def test_entry_is_whole(spark):
    got = contract.entry(spark).first()
    assert (got.n, got.m) == counts()


def test_a_query_without_twin_is_whole(spark):
    assert queries.QUERIES["greedy_colours"](spark, DATA).count() == counts()[0]
