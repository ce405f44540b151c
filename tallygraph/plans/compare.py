"""Comparisons: arms paired within a seed, hubs over seeds, resolutions of one graph, two
runs of a rich club."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.model import relabel
from tallygraph.operators import communities, ensemble, richclub
from tallygraph.operators.paths import _cut


def paired(records: DataFrame, a: str, b: str, match: str, value: str) -> DataFrame:
    """One row over the seeds of ``records`` (arm, seed, match, value) that both arms
    have: how many agree in ``match`` (the others don't count), the mean of either arm,
    and of the differences a - b their mean, sd (n - 1) and mean in per cent of b."""
    side = lambda arm, n: records.where(F.col("arm") == arm).select("seed", F.col(match).alias(f"m{n}"), F.col(value).cast("double").alias(f"v{n}"))
    j = side(a, "a").join(side(b, "b"), "seed")
    on = F.col("ma") == F.col("mb")
    d = F.when(on, F.col("va") - F.col("vb"))
    return j.agg(
        F.count_if(on).alias("pairs"), F.count_if(~F.coalesce(on, F.lit(False))).alias("unmatched"), F.avg(F.when(on, F.col("va"))).alias("mean_a"), F.avg(F.when(on, F.col("vb"))).alias("mean_b"),
        F.avg(d).alias("change"), F.stddev_samp(d).alias("sd"), F.avg(F.when(on & (F.col("vb") != 0), 100 * d / F.col("vb"))).alias("per_cent"),
    )


def hub_stability(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """One row over the labellings ``runs`` (run, id, label) of a graph: the share with a
    connector hub, the least, median and most of these, and how that reads."""
    e = _cut(edges)
    near = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e")).select("e.*")
    k = near.join(runs.toDF("run", "other", "there"), "other").groupBy("run", "id", "there").agg(F.count("*").alias("k"))
    own = F.sum(F.when(F.col("there") == F.col("label"), F.col("k")).otherwise(0))
    p = k.join(runs, ["run", "id"]).groupBy("run", "id", "label").agg((1 - F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("p"), own.alias("own"))
    stats = p.groupBy("run", "label").agg(F.avg("own").alias("mu"), F.stddev_pop("own").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("own") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    hub = (z >= 2.5) & (F.col("p") > 0.30) & (F.col("p") <= 0.75)
    per = p.join(stats, ["run", "label"]).groupBy("run").agg(F.count_if(hub).alias("hubs"))
    rate = F.avg((F.col("hubs") > 0).cast("double"))
    row = per.agg(F.count("*").alias("runs"), rate.alias("rate"), F.min("hubs").alias("least"), F.expr("percentile(hubs, 0.5)").alias("median"), F.max("hubs").alias("most"))
    return row.withColumn("reading", F.when(F.col("rate") == 1, "stable pass").when(F.col("rate") == 0, "stable fail").otherwise("seed dependent"))


def nestings(runs: DataFrame) -> DataFrame:
    """(run, gamma, finer, nesting) of ``runs`` (gamma, run, vertex, label): for each
    resolution and the next finer one, the mean over fine labels of the share that lies
    in their main coarse label."""
    g = runs.select("gamma").distinct()
    step = g.select("gamma", F.lead("gamma").over(Window.orderBy("gamma")).alias("finer")).where("finer is not null")  # a row a resolution
    coarse = runs.select("run", "gamma", "vertex", F.col("label").alias("a")).join(step, "gamma")
    both = coarse.join(runs.select("run", F.col("gamma").alias("finer"), "vertex", F.col("label").alias("b")), ["run", "finer", "vertex"])
    c = both.groupBy("run", "gamma", "finer", "b", "a").agg(F.count("*").alias("n"))
    per = c.groupBy("run", "gamma", "finer", "b").agg((F.max("n") / F.sum("n")).alias("held"))
    return per.groupBy("run", "gamma", "finer").agg(F.avg("held").alias("nesting"))


def hierarchy(edges: DataFrame, gammas: tuple = (0.5, 0.8, 1.0, 1.5, 2.0, 3.0), repeats: int = 10, seed: int = 42) -> DataFrame:
    """(gamma, modularity, labels, nesting, spread): of the run with most resolutions whose
    standard modularity is above 0.3 (ties: the earliest) the modularity and labels, and over all
    runs the mean and sd (n - 1) of the mean nesting. Modularity is that of resolution 1."""
    e = _cut(relabel(edges))
    runs = _cut(ensemble.louvain(e, list(gammas), repeats, seed))
    x, y = runs.toDF("gamma", "run", "src", "la"), runs.toDF("gamma", "run", "dst", "lb")
    both = e.join(x, "src").join(y, ["gamma", "run", "dst"])
    end = lambda c, inside: F.struct(F.col(c).alias("label"), inside.alias("i"))
    ends = both.select("gamma", "run", F.explode(F.array(end("la", (F.col("la") == F.col("lb")).cast("long")), end("lb", F.lit(0).cast("long")))).alias("x"))
    g = ends.groupBy("gamma", "run", "x.label").agg(F.sum("x.i").alias("i"), F.count("*").cast("double").alias("d"))
    q = g.groupBy("gamma", "run").agg((F.sum("i") / (F.sum("d") / 2) - F.sum(F.col("d") * F.col("d")) / (F.sum("d") * F.sum("d"))).alias("modularity"), F.count("*").alias("labels"))
    q = _cut(q)
    best = q.groupBy("run").agg(F.count_if(F.col("modularity") > 0.3).alias("n")).agg(F.max_by("run", F.struct("n", -F.col("run"))).alias("run"))
    nest = nestings(runs).groupBy("run").agg(F.avg("nesting").alias("m")).agg(F.avg("m").alias("nesting"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("spread"))
    return q.join(best, "run").crossJoin(nest).select("gamma", "modularity", "labels", "nesting", "spread")


def partition_sizes(labels: DataFrame) -> DataFrame:
    """One row: labels, the sizes of the smallest, median and largest, sd (n)."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("labels"), F.min("n").alias("smallest"), F.expr("percentile(n, 0.5)").alias("median"), F.max("n").alias("largest"), F.stddev_pop("n").alias("sd"))


def straddling(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """One row: fine labels, how many lie in several coarse ones, and the vertices of these."""
    c = fine.toDF("id", "a").join(coarse.toDF("id", "b"), "id").groupBy("a").agg(F.count_distinct("b").alias("parts"), F.count("*").alias("n"))
    wide = F.col("parts") > 1
    return c.agg(F.count("*").alias("labels"), F.count_if(wide).alias("straddling"), F.coalesce(F.sum(F.when(wide, F.col("n"))), F.lit(0)).alias("vertices"))


def quotient_with_inside(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, witness) of label pairs with an edge, a = b for edges inside a label."""
    e = edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst")
    return e.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("witness"))


def floored_club(nulls: DataFrame, real: DataFrame, floor: int = 20, alpha: float = 0.05) -> DataFrame:
    """One row of a rich club at every k of the real curve, each against the nulls that
    reach it: significant k, their longest run, and both where at least ``floor``
    vertices have more than k."""
    t = richclub.null_table(nulls, real).join(real.select("k", "n_above"), "k")
    t = _cut(t.withColumn("on", (F.col("rho") > 1) & (F.col("p") < alpha)))
    out = None
    for name, on in (("", F.col("on")), ("_floored", F.col("on") & (F.col("n_above") >= floor))):
        runs = richclub.runs(t.where(on).select("k"), "k")
        row = t.agg(F.count_if(on).alias(f"significant{name}")).crossJoin(runs.agg(F.coalesce(F.max("length"), F.lit(0)).alias(f"run{name}")))
        out = row if out is None else out.crossJoin(row)
    top = t.agg(F.coalesce(F.max(F.when(F.col("n_above") >= floor, F.col("k"))), F.lit(0)).alias("highest_k"))
    return out.crossJoin(top)


def clubs_at(table: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, k, n_above, rho) of a null table (k, n_above, rho): the k whose club is
    nearest to each size (ties to the larger club, then the smaller k)."""
    ask = table.sparkSession.createDataFrame([(x,) for x in sizes], "size long")
    near = table.select("k", "n_above", "rho").crossJoin(F.broadcast(ask))  # a row a size
    order = F.struct(F.abs(F.col("n_above") - F.col("size")), -F.col("n_above"), F.col("k"))
    return near.groupBy("size").agg(F.min_by(F.struct("k", "n_above", "rho"), order).alias("x")).select("size", "x.*")


def compare_clubs(x: DataFrame, y: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, k_x, rho_x, k_y, rho_y, change) of two null tables at matched club sizes."""
    a, b = clubs_at(x, sizes).drop("n_above").toDF("size", "k_x", "rho_x"), clubs_at(y, sizes).drop("n_above").toDF("size", "k_y", "rho_y")
    return a.join(b, "size").withColumn("change", F.col("rho_y") - F.col("rho_x"))


def pair_clubs(table: DataFrame, nulls: int) -> DataFrame:
    """One row of the clubs of two vertices of a null table (k, n_above, mean, std, rho):
    their first and last k, and the ratio with its error from the nulls' mean."""
    t = table.where("n_above = 2")
    se = F.first("std") / F.sqrt(F.lit(float(nulls))) / F.first("mean")
    return t.orderBy("k").limit(1).agg(F.first("rho").alias("rho"), (F.first("rho") * se).alias("error")).crossJoin(t.agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"))).where("n > 0").drop("n")
