"""Graphs as tables: vertices(id) and edges(src < dst), undirected and simple."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ship(spark) -> None:
    """Let Python workers started from now on import this package; a cluster whose
    machines don't have it installed gets it by ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in (env.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


@dataclass(frozen=True)
class GraphTables:
    """``vertices`` keeps isolates; ``edges`` may carry more columns (weight, layer)."""

    vertices: DataFrame
    edges: DataFrame


def canonical(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct undirected pairs, the smaller id first, loops dropped."""
    e = edges.where(F.col(src) != F.col(dst))
    return e.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (id, other). One pass over edges, no second scan."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    return edges.select(ends.alias("e")).select("e.id", "e.other")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of the vertices with an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    keep = ids.select("id")
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def relabel_ids(edges: DataFrame) -> DataFrame:
    """(id, new_id): ids become 0..n-1 in order of id, by ranks inside ranges of ids and
    the counts of the ranges before, so no task ranks all of them."""
    from pyspark.sql import Window

    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ranged = ids.withColumn("part", F.expr("id div 65536"))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return ranged.withColumn("r", rank).join(before, "part").select("id", (F.col("r") + F.col("before")).cast("long").alias("new_id"))


def relabel(edges: DataFrame) -> DataFrame:
    """Edges with ids 0..n-1 in order of id."""
    new = relabel_ids(edges)
    a, b = new.toDF("src", "new_src"), new.toDF("dst", "new_dst")
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
