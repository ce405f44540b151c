"""Triangles, clustering and wedges.

Edges are turned from the end of lower (degree, id) to the higher, so a hub has
few edges out and wedges number at most m^1.5 whatever the skew. Wedges are not rows:
a list of the upper end's edges out goes to each edge and meets the lower end's list there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.model import degrees, relabel_ids
from tallygraph.operators.paths import _cut


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), each triangle once, ``a`` its lowest vertex by (degree, id) and b < c."""
    d = degrees(edges)
    e = edges.join(d.toDF("src", "du"), "src").join(d.toDF("dst", "dv"), "dst")
    up = F.struct(F.col("du"), F.col("src")) < F.struct(F.col("dv").alias("du"), F.col("dst").alias("src"))
    e = _cut(e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi")))
    out = e.groupBy("lo").agg(F.collect_list("hi").alias("near"))
    met = e.join(out.toDF("hi", "far"), "hi").join(out, "lo").select("lo", "hi", F.explode(F.array_intersect("far", "near")).alias("top"))
    return met.select(F.col("lo").alias("a"), F.least("hi", "top").alias("b"), F.greatest("hi", "top").alias("c"))


def per_vertex(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering) of every vertex with an edge. The edges are
    written once: they are read for degrees, both sides of the wedges and the closing join."""
    edges = _cut(edges)
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    n = F.coalesce("t", F.lit(0))
    c = F.when(F.col("degree") > 1, 2 * n / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return degrees(edges).join(t, "id", "left").select("id", "degree", n.alias("triangles"), c.alias("clustering"))


def clustering(edges: DataFrame) -> DataFrame:
    """One row: triangles, wedges, transitivity, average clustering."""
    w = F.col("degree") * (F.col("degree") - 1) / 2
    return per_vertex(edges).agg((F.sum("triangles") / 3).cast("long").alias("triangles"), F.sum(w).cast("long").alias("wedges"), (F.sum("triangles") / F.sum(w)).alias("transitivity"), F.avg("clustering").alias("average_clustering"))


def support(edges: DataFrame) -> DataFrame:
    """(src, dst, support): triangles over each edge."""
    edges = _cut(edges)
    t = triangles(edges)
    side = lambda p, q: F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst"))
    n = t.select(F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("n"))
    return edges.join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).alias("support"))


def by_degree_band(edges: DataFrame, width: int = 30, least: int = 3) -> DataFrame:
    """Mean clustering by band of degrees with at least so many vertices."""
    band = F.floor(F.col("degree") / width).alias("band")
    return per_vertex(edges).groupBy(band).agg(F.count("*").alias("n"), F.avg("clustering").alias("clustering")).where(F.col("n") >= least)


def four_cycles(edges: DataFrame) -> DataFrame:
    """One row: cycles of four vertices, each once, from the wedges below their vertex of
    highest (degree, id); as many as the lesser degrees of all edges' ends together."""
    edges = _cut(edges)
    rank = degrees(edges).select("id", F.struct("degree", "id").alias("p"))
    e = edges.join(rank.toDF("src", "x"), "src").join(rank.toDF("dst", "y"), "dst").select("src", "dst", "x", "y")
    ends = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("o"), F.col("x").alias("pv"), F.col("y").alias("po")), F.struct(F.col("dst").alias("v"), F.col("src").alias("o"), F.col("y").alias("pv"), F.col("x").alias("po"))))
    near = _cut(e.select(ends.alias("e")).select("e.*"))
    tops, lows = near.where("po > pv").select("v", F.col("o").alias("u"), F.col("po").alias("pu")), near.select("v", F.col("o").alias("w"), F.col("po").alias("pw"))
    pairs = tops.join(lows, "v").where("pw < pu").groupBy("u", "w").agg(F.count("*").alias("c"))
    return pairs.agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0)).cast("long").alias("cycles"))


def closed_walks(edges: DataFrame) -> DataFrame:
    """(power, walks): closed walks of two, three and four steps, which are the traces of these
    powers of the adjacency matrix."""
    edges = _cut(edges)
    d = degrees(edges).agg(F.sum("degree").alias("ends"), F.sum(F.col("degree") * (F.col("degree") - 1)).alias("wedges"))
    three = triangles(edges).agg((F.count("*") * 6).alias("walks"))
    # Of four steps: an edge to and fro twice, two edges of a vertex to and fro, or a cycle from each of its vertices both ways.
    four = d.crossJoin(four_cycles(edges)).select((F.col("ends") + 2 * F.col("wedges") + 8 * F.col("cycles")).alias("walks"))  # rows of sums
    row = lambda df, p: df.select(F.lit(p).cast("long").alias("power"), F.col("walks").cast("long").alias("walks"))
    return row(d.withColumnRenamed("ends", "walks"), 2).unionByName(row(three, 3)).unionByName(row(four, 4))


def maximal_cliques(edges: DataFrame, by: str, most: int = 12) -> list[DataFrame]:
    """(by, c) for two, three, ... vertices: maximal cliques of many graphs at once, edges (by, src, dst).

    Cliques grow by a vertex a round, each listed once, in order of (degree, id), with the higher
    neighbours that all its members have; a row goes on to each of these and meets its list. A clique is
    maximal if it lies in none a vertex larger. Rows of a round are the cliques of one size; more than ``most``
    rounds raise."""
    edges = _cut(edges.select(by, "src", "dst"))
    d = edges.select(by, F.explode(F.array("src", "dst")).alias("id")).groupBy(by, "id").agg(F.count("*").alias("degree"))
    e = edges.join(d.select(by, F.col("id").alias("src"), F.col("degree").alias("du")), [by, "src"]).join(d.select(by, F.col("id").alias("dst"), F.col("degree").alias("dv")), [by, "dst"])
    up = F.struct(F.col("du").alias("d"), F.col("src").alias("i")) < F.struct(F.col("dv").alias("d"), F.col("dst").alias("i"))
    e = _cut(e.select(by, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi")))
    out = _cut(e.groupBy(by, "lo").agg(F.collect_list("hi").alias("near")))
    met = e.join(out.toDF(by, "hi", "far"), [by, "hi"], "left").join(out, [by, "lo"])
    both = F.when(F.col("far").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_intersect("near", "far"))
    now, held, size = _cut(met.select(by, F.array("lo", "hi").alias("c"), both.alias("more"))), [], 2
    while True:
        step = now.select(by, "c", "more", F.explode("more").alias("hi")).join(out.toDF(by, "hi", "near"), [by, "hi"], "left")
        more = F.when(F.col("near").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_intersect("more", "near"))
        grown = _cut(step.select(by, F.array_append("c", F.col("hi")).alias("c"), more.alias("more")))
        # Cliques that grow themselves are in one larger; the others are looked up in those that have grown.
        inside = grown.select(by, F.explode(F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.filter("c", lambda y, j: j != i))).alias("c")).distinct()
        held.append(now.where("size(more) = 0").select(by, "c").join(inside, [by, "c"], "left_anti"))
        if grown.isEmpty():
            return held
        now, size = grown, size + 1
        if size > most:
            raise ValueError(f"cliques of more than {most} vertices")


def clique_census(edges: DataFrame, by: str, most: int = 12) -> DataFrame:
    """(by, size, cliques) of ``maximal_cliques``."""
    sizes = [c.groupBy(by).agg(F.count("*").alias("cliques")).select(by, F.lit(size).cast("long").alias("size"), "cliques") for size, c in enumerate(maximal_cliques(edges, by, most), 2)]
    return reduce(DataFrame.unionByName, sizes)


def participation(edges: DataFrame, most: int = 12) -> DataFrame:
    """(vertex, degree, cliques): maximal cliques of two or more vertices at each vertex; dense ids."""
    edges = _cut(edges.select("src", "dst"))
    cliques = reduce(DataFrame.unionByName, maximal_cliques(edges.withColumn("graph", F.lit(0)), "graph", most))
    n = cliques.select(F.explode("c").alias("id")).groupBy("id").agg(F.count("*").alias("cliques"))
    return relabel_ids(edges).join(degrees(edges), "id").join(n, "id").select(F.col("new_id").alias("vertex"), "degree", "cliques")
