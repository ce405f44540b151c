"""The tripartite trade graph of the order tables: customer, part and supplier
vertices (id = 3 * key + colour), an edge for each pair that shares a line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.model import canonical


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, with repeats): three pairs a line item from one join."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return three_pairs(lines, read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


def three_pairs(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The pairs of line items, of a table or of a stream."""
    c, p, s = F.col("o_custkey") * 3, F.col("l_partkey") * 3 + 1, F.col("l_suppkey") * 3 + 2
    three = F.explode(F.array(F.struct(c.alias("src"), p.alias("dst")), F.struct(c.alias("src"), s.alias("dst")), F.struct(p.alias("src"), s.alias("dst"))))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(three.alias("e")).select("e.src", "e.dst")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(pairs(spark, sf_dir))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the number of line items behind each."""
    return pairs(spark, sf_dir).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("weight"))


def nation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): customers and suppliers by nation, parts by brand's number."""
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("id"), F.col("c_nationkey").cast("long").alias("label"))
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3 + 2).alias("id"), F.col("s_nationkey").cast("long").alias("label"))
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") * 3 + 1).alias("id"), (F.col("p_partkey") % 25).cast("long").alias("label"))
    return c.unionByName(s).unionByName(p)


def colours(labels: DataFrame) -> DataFrame:
    """(id, label) by vertex colour instead."""
    return labels.select("id", (F.col("id") % 3).alias("label"))
