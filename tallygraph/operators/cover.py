"""Box covers of one graph and the dimensions read off them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.kernels import structure as kernel
from tallygraph.model import induced
from tallygraph.operators import paths
from tallygraph.operators.ensemble import Shared, _rows, _run, distance_histogram
from tallygraph.operators.structure import scaling_fit


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component of most vertices (ties: of the smallest id)."""
    c = paths.components(edges)
    top = c.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return paths._cut(induced(edges, c.join(top, "component")))


def random_covers(edges: DataFrame, reaches: list[int], trials: int, seed: int = 42) -> DataFrame:
    """(reach, vertex, box) of the trial of fewest boxes (ties: the earliest) for each
    reach: balls of distance up to the reach around vertices in random order; a trial a
    task. Boxes of length l with distances below l are reach l - 1; dense ids."""
    shared = Shared(edges)

    def f(i):
        box = kernel.random_cover(shared.graph(), reaches[i // trials], seed + i % trials)
        return {"reach": np.full(shared.n, reaches[i // trials]), "trial": np.full(shared.n, i % trials), "vertex": np.arange(shared.n), "box": box}

    k = len(reaches) * trials
    tried = paths._cut(_run(_rows(edges.sparkSession, k, k), f, "reach long, trial long, vertex long, box long"))
    best = tried.groupBy("reach", "trial").agg(F.max("box").alias("boxes")).groupBy("reach").agg(F.min(F.struct("boxes", "trial"))["trial"].alias("trial"))
    return tried.join(best, ["reach", "trial"]).select("reach", "vertex", "box")


def mass_covers(edges: DataFrame, radii: list[int], seed: int = 42) -> DataFrame:
    """(radius, vertex, box): the maximal-excluded-mass cover with each vertex's box, named
    by its centre; dense ids."""
    shared = Shared(edges)

    def f(i):
        box = kernel.mass_cover(shared.graph(), radii[i], seed)[1]
        return {"radius": np.full(shared.n, radii[i]), "vertex": np.arange(shared.n), "box": box}

    return _run(_rows(edges.sparkSession, len(radii), len(radii)), f, "radius long, vertex long, box long")


def diameter(edges: DataFrame, sample: int | None = 300, seed: int = 42) -> int:
    """Largest distance seen from a seeded sample of sources: a lower bound."""
    return distance_histogram(edges, sample, seed).agg(F.max("d")).first()[0] or 0


def box_dimension(edges: DataFrame, trials: int = 30, lengths: tuple = (2, 3, 4, 5, 6, 8, 10, 12), seed: int = 42) -> DataFrame:
    """One row of fits over the given lengths up to the diameter, distances up to the
    length in a box."""
    lengths = [x for x in lengths if x <= diameter(edges, None)] or [lengths[0]]
    boxes = random_covers(edges, lengths, trials, seed).groupBy("reach").agg(F.count_distinct("box").alias("boxes"))
    return scaling_fit(boxes, "reach", "boxes")


def ball_dimension(edges: DataFrame, trials: int = 3, sample: int = 300, least: int = 4, seed: int = 42) -> DataFrame:
    """One row: fits of the ball cover of the largest component at radii from 1 to half
    its diameter, and which law fits better; too few points give none."""
    g = largest_component(edges)
    radii = list(range(1, max(2, diameter(g, sample, seed) // 2) + 1))
    boxes = random_covers(g, radii, trials, seed).groupBy("reach").agg(F.count_distinct("box").alias("boxes"))
    law = F.when(F.col("power_r2") > F.col("exponential_r2"), "power law").otherwise("exponential")
    return scaling_fit(boxes, "reach", "boxes", least).withColumn("verdict", F.when(F.col("points") < least, "too few points").otherwise(law))
