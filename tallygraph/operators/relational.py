"""Relational idioms on the driver's tables: joins, sets, windows, grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def propagate(near: DataFrame, values: DataFrame) -> DataFrame:
    """One round of message passing: each vertex gets the sum of its neighbours' values."""
    return near.join(values.toDF("other", "v"), "other").groupBy("id").agg(F.sum("v").alias("value"))


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, ties to the smaller tie value."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def _t(spark, d, n):
    return spark.read.parquet(f"{d}/{n}.parquet")


def stratified_top(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return top_k(o.select(F.col("c_nationkey").cast("long").alias("nation"), "o_orderkey", F.round("o_totalprice", 2).alias("price")), "nation", "price", "o_orderkey", 3).withColumn("rank", F.col("rank").cast("long"))


def priced_lines(spark, d):
    li = _t(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"))


def cube_counts(spark, d):
    li = _t(spark, d, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def customers_without_orders(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def customers_with_large_orders(spark, d):
    big = _t(spark, d, "orders").where("o_totalprice > 200000")
    return _t(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def nations_of_both(spark, d):
    c, s = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s)


def parts_never_ordered(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("k")))


def event_windows(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def event_properties(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


def order_gaps(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select("o_orderkey", F.coalesce(F.col("o_orderkey") - F.lag("o_orderkey").over(w), F.lit(-1)).alias("gap"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_cents"))


_J = "customer JOIN orders ON o_custkey = c_custkey"
EXTRAS = [
    (stratified_top, f"SELECT nation, o_orderkey, price, rank FROM (SELECT c_nationkey::BIGINT AS nation, o_orderkey, round(o_totalprice, 2) AS price, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS rank FROM {_J}) WHERE rank <= 3"),
    (priced_lines, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem GROUP BY 1, 2"),
    (cube_counts, "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    (customers_without_orders, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    (customers_with_large_orders, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    (nations_of_both, "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    (parts_never_ordered, "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem"),
    (event_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    (event_properties, "SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1"),
    (order_gaps, "SELECT o_orderkey, coalesce(o_orderkey - lag(o_orderkey) OVER w, -1) AS gap, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS running_cents FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
]
