"""Partitions: modularity, roles, agreement, quotients. ``labels`` is (id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.model import both_ways


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """sum over labels of inside / m - gamma (degree sum / 2m)^2."""
    e = edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("la").alias("label"), (F.col("la") == F.col("lb")).cast("long").alias("i")), F.struct(F.col("lb").alias("label"), F.lit(0).cast("long").alias("i")))).alias("x"))
    g = ends.groupBy("x.label").agg(F.sum("x.i").alias("inside"), F.count("*").alias("d"))
    m = F.sum("d") / 2
    return g.agg((F.sum("inside") / m - gamma * F.sum(F.col("d").cast("double") * F.col("d")) / (4 * m * m)).alias("modularity"))


def roles(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, degree, participation, z): participation 1 - sum (k_is / k)^2, and
    the z of the degree inside one's own label (population sd; 0 where that is 0)."""
    near = both_ways(edges).join(labels.toDF("other", "there"), "other").groupBy("id", "there").agg(F.count("*").alias("k"))
    p = near.join(labels, "id").groupBy("id", "label").agg(
        F.sum("k").alias("degree"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.sum(F.when(F.col("there") == F.col("label"), F.col("k")).otherwise(0)).alias("own")
    )
    stats = p.groupBy("label").agg(F.avg("own").alias("mu"), F.stddev_pop("own").alias("sd"))  # no window gathers a label
    z = F.when(F.col("sd") > 0, (F.col("own") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return p.join(stats, "label").select("id", "label", "degree", (1 - F.col("sq") / (F.col("degree") * F.col("degree"))).alias("participation"), z.alias("z"))


def hubs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of connector (z >= 2.5, .30 < P <= .75) and kinless (P > .75) hubs."""
    r = roles(edges, labels)
    return r.agg(F.count_if((F.col("z") >= 2.5) & (F.col("participation") > 0.30) & (F.col("participation") <= 0.75)).alias("connector"), F.count_if((F.col("z") >= 2.5) & (F.col("participation") > 0.75)).alias("kinless"))


def agreement(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row over vertices in both: variation of information (nats), NMI
    (arithmetic), adjusted Rand index, from the contingency table's sums."""
    c = x.toDF("id", "a").join(y.toDF("id", "b"), "id").groupBy("a", "b").agg(F.count("*").alias("n"))
    pick = lambda v: F.sum(v * F.log(v))
    two = lambda v: F.sum(v * (v - 1) / 2)
    v = F.col("n").cast("double")
    joint = c.agg(F.sum(v).alias("t"), pick(v).alias("sab"), two(v).alias("pab"))
    side = lambda k: c.groupBy(k).agg(F.sum("n").alias("n")).agg(pick(v).alias(f"s{k}"), two(v).alias(f"p{k}"))
    one = joint.crossJoin(side("a")).crossJoin(side("b"))
    h = lambda s: F.log("t") - F.col(s) / F.col("t")
    ha, hb, hab = h("sa"), h("sb"), h("sab")
    info = ha + hb - hab
    expected = F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    return one.select(
        F.greatest(F.lit(0.0), ha + hb - 2 * info).alias("vi"),
        F.when(ha + hb > 0, 2 * info / (ha + hb)).otherwise(1.0).alias("nmi"),
        F.when((F.col("pa") + F.col("pb")) / 2 != expected, (F.col("pab") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)).otherwise(1.0).alias("ari"),
    )


def quotient(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, witness): label pairs with an edge between them, and how many."""
    e = edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst").where("la <> lb")
    return e.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("witness"))


def bundle_fans(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, weight, fan_a, fan_b): distinct end vertices on either side of a relation."""
    e = edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst").where("la <> lb")
    up = F.col("la") < F.col("lb")
    e = e.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), F.when(up, F.col("src")).otherwise(F.col("dst")).alias("va"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("vb"))
    # A row a vertex of a relation first, whatever its side: relations are few, and no task gathers one's vertices.
    side = lambda s, v: F.struct(F.lit(s).alias("side"), F.col(v).alias("v"))
    ends = e.select("a", "b", F.explode(F.array(side("a", "va"), side("b", "vb"))).alias("x")).groupBy("a", "b", "x.side", "x.v").agg(F.count("*").alias("n"))
    return ends.groupBy("a", "b").agg(F.sum(F.when(F.col("side") == "a", F.col("n"))).alias("weight"), F.count_if(F.col("side") == "a").alias("fan_a"), F.count_if(F.col("side") == "b").alias("fan_b"))


def cut_share(edges: DataFrame, labels: DataFrame) -> DataFrame:
    e = edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst")
    return e.agg(F.count_if(F.col("la") != F.col("lb")).alias("cut"), F.count("*").alias("m"), F.avg((F.col("la") != F.col("lb")).cast("double")).alias("share"))


def apportion(shares: DataFrame, key: str, share: str, seats: int) -> DataFrame:
    """Largest remainders: floors, then one more for the biggest fractions, ties to
    the smaller key. The table has one row a group."""
    total = shares.agg(F.sum(share).alias("t"))
    s = shares.crossJoin(total).withColumn("quota", F.col(share) * seats / F.col("t")).withColumn("floor", F.floor("quota"))
    rest = seats - F.sum("floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy((F.col("quota") - F.col("floor")).desc(), key))
    return s.withColumn("rest", rest).withColumn("rank", rank).select(key, (F.col("floor") + (F.col("rank") <= F.col("rest")).cast("long")).alias("seats"))


