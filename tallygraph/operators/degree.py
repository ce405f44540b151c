"""Degree, counting and entropy statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.functions.scalars import correlation
from tallygraph.model import both_ways, degrees


def histogram(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: min, max, mean, median, sd (n), cv, dispersion, p90, p99, max/mean and
    Gini. Ranks run over the histogram of degrees, which stays small, not over ids."""
    d = degrees(edges).select(F.col("degree").cast("double").alias("x"))
    gini = gini_of(histogram(d, "x"))
    one = d.agg(
        F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.expr("percentile(x, 0.5)").alias("median"),
        F.stddev_pop("x").alias("std"), (F.stddev_pop("x") / F.avg("x")).alias("cv"), (F.var_pop("x") / F.avg("x")).alias("dispersion"),
        F.expr("percentile(x, 0.9)").alias("p90"), F.expr("percentile(x, 0.99)").alias("p99"), (F.max("x") / F.avg("x")).alias("max_mean"),
    )
    return one.crossJoin(gini)  # one row each


def gini_of(hist: DataFrame) -> DataFrame:
    """Gini of values given by a histogram: a value's copies take consecutive ranks."""
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    r = hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    ranks = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2
    n, s = F.sum("n"), F.sum(F.col("value") * F.col("n"))
    return r.agg(F.when(s == 0, 0.0).otherwise(2 * F.sum(F.col("value") * ranks) / (n * s) - (n + 1) / n).alias("gini"))


def hill(edges: DataFrame) -> DataFrame:
    """Hill tail index over the k largest degrees, k = min(max(10, n div 10), 200, n - 1)."""
    d = degrees(edges).select(F.col("degree").alias("x"))
    n = d.count()
    if n < 10:
        return d.sparkSession.sql("SELECT cast(null AS double) AS hill")
    k = min(max(10, n // 10), 200, n - 1)
    top = d.orderBy(F.desc("x")).limit(k + 1)  # k is bounded by 200
    low = F.min("x")
    return top.agg((F.lit(1.0) / (F.sum(F.log("x") - F.lit(0.0)) - F.log(low) * (k + 1)) * k).alias("hill"))


def _ends(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return edges.join(d.toDF("src", "du"), "src").join(d.toDF("dst", "dv"), "dst")


def entropy(counts: DataFrame) -> DataFrame:
    """Entropy in nats of counts ``n``."""
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.crossJoin(total).agg((-F.sum(p * F.log(p))).alias("entropy"))


def difference_entropy(edges: DataFrame) -> DataFrame:
    return entropy(_ends(edges).groupBy(F.abs(F.col("du") - F.col("dv"))).agg(F.count("*").alias("n")))


def pair_entropy(edges: DataFrame) -> DataFrame:
    return entropy(_ends(edges).groupBy(F.least("du", "dv"), F.greatest("du", "dv")).agg(F.count("*").alias("n")))


def degree_entropy(edges: DataFrame) -> DataFrame:
    return entropy(degrees(edges).groupBy("degree").agg(F.count("*").alias("n")))


def assortativity(edges: DataFrame) -> DataFrame:
    """Pearson correlation of end degrees over both orientations."""
    e = _ends(edges)
    both = e.select("du", "dv").unionByName(e.select(F.col("dv").alias("du"), F.col("du").alias("dv")))
    return both.agg(correlation("du", "dv").alias("assortativity"))


def ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov gap, over the pooled histogram."""
    x = histogram(a, column).select("value", F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"))
    y = histogram(b, column).select("value", F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"))
    h = x.unionByName(y).groupBy("value").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cdf = h.select(F.sum("na").over(w).alias("ca"), F.sum("nb").over(w).alias("cb"))
    return cdf.agg(F.max("ca").alias("ta"), F.max("cb").alias("tb"), F.collect_list(F.struct("ca", "cb")).alias("s")).select(F.array_max(F.transform("s", lambda r: F.abs(r["ca"] / F.col("ta") - r["cb"] / F.col("tb")))).alias("ks"))


def density(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    m = edges.agg(F.count("*").alias("m"))
    ids = (vertices or degrees(edges)).agg(F.count("*").alias("n"))
    return ids.crossJoin(m).select("n", "m", (2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"), (2 * F.col("m") / F.col("n")).alias("mean_degree"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, ties at their mean rank: ranks come from value histograms."""

    def ranks(c: str) -> DataFrame:
        w = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        h = df.groupBy(c).agg(F.count("*").alias("n"))
        return h.select(c, (F.sum("n").over(w) - (F.col("n") - 1) / 2).alias(f"r_{c}"))

    return df.join(ranks(x), x).join(ranks(y), y).agg(correlation(f"r_{x}", f"r_{y}").alias("spearman"))


def block_density(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges by pair of labels over the possible ones, empty pairs with 0."""
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    e = edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst")
    n = e.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("edges"))
    grid = size.toDF("a", "sa").crossJoin(size.toDF("b", "sb")).where("a <= b")  # labels squared
    possible = F.when(F.col("a") == F.col("b"), F.col("sa") * (F.col("sa") - 1) / 2).otherwise(F.col("sa") * F.col("sb"))
    return grid.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(possible > 0, F.coalesce("edges", F.lit(0)) / possible).alias("density"))


def axons(weight):
    """Thickness law of a bundle of W edges: max(1, round half even (W^.05 (1 + (W - 1) / 11)^.95))."""
    w = F.col(weight).cast("double") if isinstance(weight, str) else weight
    return F.greatest(F.lit(1.0), F.bround(F.pow(w, F.lit(0.05)) * F.pow(1 + (w - 1) / 11, F.lit(0.95)), 0)).cast("long")


def neighbour_degree(edges: DataFrame) -> DataFrame:
    """(id, mean degree of neighbours)."""
    d = degrees(edges)
    return both_ways(edges).join(d.toDF("other", "d"), "other").groupBy("id").agg(F.avg("d").alias("mean_degree"))
