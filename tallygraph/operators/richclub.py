"""Rich club curves and the inference on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.model import degrees


def phi(edges: DataFrame) -> DataFrame:
    """(k, n_above, e_above, phi) for k = 0, 1, ... while two vertices have more than k.

    Counts above k are suffix sums over the histogram of degrees (and of the lesser
    end degree)."""
    d = degrees(edges)
    e = edges.join(d.toDF("src", "du"), "src").join(d.toDF("dst", "dv"), "dst")
    hist = d.select("degree", F.lit(1).cast("long").alias("v"), F.lit(0).cast("long").alias("e")).unionByName(e.select(F.least("du", "dv").alias("degree"), F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("e")))
    hist = hist.groupBy("degree").agg(F.sum("v").alias("v"), F.sum("e").alias("e"))
    # Windows run over the degrees that occur; each stands for the k from the one before it on.
    down = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.coalesce(F.lag("degree").over(Window.orderBy("degree")), F.lit(0).cast("long"))
    s = hist.select(low.alias("low"), F.col("degree").cast("long").alias("degree"), F.sum("v").over(down).alias("n_above"), F.sum("e").over(down).alias("e_above")).where("n_above >= 2")
    s = s.select(F.explode(F.sequence("low", F.col("degree") - 1)).alias("k"), "n_above", "e_above")
    return s.select("k", "n_above", "e_above", (2 * F.col("e_above") / (F.col("n_above") * (F.col("n_above") - 1))).alias("phi"))


def phi_by(edges: DataFrame, by: str) -> DataFrame:
    """(by, k, n_above, e_above, phi) as ``phi``, of many graphs at once: edges (by, src, dst)."""
    d = edges.select(by, F.explode(F.array("src", "dst")).alias("id")).groupBy(by, "id").agg(F.count("*").alias("degree"))
    e = edges.join(d.select(by, F.col("id").alias("src"), F.col("degree").alias("du")), [by, "src"]).join(d.select(by, F.col("id").alias("dst"), F.col("degree").alias("dv")), [by, "dst"])
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    hist = d.select(by, "degree", one.alias("v"), none.alias("e")).unionByName(e.select(by, F.least("du", "dv").alias("degree"), none.alias("v"), one.alias("e")))
    hist = hist.groupBy(by, "degree").agg(F.sum("v").alias("v"), F.sum("e").alias("e"))
    down = Window.partitionBy(by).orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.coalesce(F.lag("degree").over(Window.partitionBy(by).orderBy("degree")), none)
    s = hist.select(by, low.alias("low"), F.col("degree").alias("top"), F.sum("v").over(down).alias("n_above"), F.sum("e").over(down).alias("e_above")).where("n_above >= 2")
    s = s.select(by, F.explode(F.sequence("low", F.col("top") - 1)).alias("k"), "n_above", "e_above")
    return s.withColumn("phi", 2 * F.col("e_above") / (F.col("n_above") * (F.col("n_above") - 1)))


def benjamini_hochberg(tests: DataFrame, key: str, p: str) -> DataFrame:
    """(key, p, q): q of the i-th smallest p is min over j >= i of p_j n / j, 1 at most."""
    r = tests.select(key, p, F.row_number().over(Window.orderBy(p, key)).alias("rank"), F.count("*").over(Window.partitionBy()).alias("n"))
    low = F.min(F.col(p) * F.col("n") / F.col("rank")).over(Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    return r.select(key, p, F.least(F.lit(1.0), low).alias("q"))


def runs(marks: DataFrame, k: str) -> DataFrame:
    """(first, last, length) of the runs of consecutive integers."""
    g = marks.select(k, (F.col(k) - F.row_number().over(Window.orderBy(k))).alias("g"))
    return g.groupBy("g").agg(F.min(k).alias("first"), F.max(k).alias("last"), F.count("*").alias("length")).drop("g")


def null_table(nulls: DataFrame, real: DataFrame, least_nulls: int = 1) -> DataFrame:
    """(k, phi, mean, std, rho, p) against null curves (null_id, k, phi): sd with
    n - 1, p by (1 + nulls at least as high) / (1 + nulls)."""
    j = nulls.select("null_id", "k", F.col("phi").alias("null_phi")).join(real.select("k", "phi"), "k")
    g = j.groupBy("k", "phi").agg(F.avg("null_phi").alias("mean"), F.stddev_samp("null_phi").alias("std"), F.count("*").alias("n"), F.count_if(F.col("null_phi") >= F.col("phi")).alias("high"))
    return g.where(F.col("n") >= least_nulls).select("k", "phi", "mean", "std", F.when(F.col("mean") > 0, F.col("phi") / F.col("mean")).alias("rho"), ((1 + F.col("high")) / (1 + F.col("n"))).alias("p"))


def minima(curve: DataFrame, x: str, y: str, tol: float = 1e-12) -> DataFrame:
    """Local minima of a short curve; a flat valley is one, at its middle; ends are none."""
    w = Window.orderBy(x)
    step = F.when(F.abs(F.col(y) - F.lag(y).over(w)) <= tol, 0).otherwise(1)
    flat = curve.withColumn("island", F.sum(F.coalesce(step, F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = flat.groupBy("island").agg(F.min(y).alias("v"), F.expr(f"element_at(array_sort(collect_list({x})), cast(floor((count(*) - 1) / 2) as int) + 1)").alias("x"))
    v = Window.orderBy("island")
    return s.select("x", "v", F.lag("v").over(v).alias("a"), F.lead("v").over(v).alias("b")).where("v < a and v < b").select("x", F.col("v").alias("y"))
