"""Audits: closed-form expectations, small-world ratios, verdicts, weight tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.functions.scalars import correlation
from tallygraph.kernels import generate, measures
from tallygraph.kernels import structure as kernel
from tallygraph.model import degrees, relabel
from tallygraph.operators import communities, ensemble, inference, richclub
from tallygraph.operators.degree import density, gini_of, histogram, ks
from tallygraph.operators.paths import _cut, effective_diameter, hop_plot

#: Euler's constant to the digits of the closed form of random graphs' path length.
EULER = 0.5772


def expectations(edges: DataFrame) -> DataFrame:
    """One row for a random graph of the same size: clustering p, path length
    (ln n - .5772) / ln<k> + 1/2, efficiency 1 / that."""
    path = (F.log("n") - EULER) / F.log("mean_degree") + 0.5
    return density(edges).select(F.col("density").alias("clustering"), path.alias("path"), (F.lit(1.0) / path).alias("efficiency"))


def null_kind(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """One row: 'layered' if every edge joins two of at least two colours of which each has
    more than one vertex, so that colours carry the structure; else 'plain'."""
    c = colours.toDF("id", "colour")
    sizes = c.groupBy("colour").agg(F.count("*").alias("n")).agg(F.count("*").alias("colours"), F.min("n").alias("least"))
    e = edges.join(c.toDF("src", "cu"), "src", "left").join(c.toDF("dst", "cv"), "dst", "left")
    wrong = e.agg(F.count_if(~F.coalesce(F.col("cu") != F.col("cv"), F.lit(False))).alias("wrong"))
    ok = (F.col("wrong") == 0) & (F.col("colours") >= 2) & (F.col("least") > 1)
    return sizes.crossJoin(wrong).select(F.when(ok, "layered").otherwise("plain").alias("kind"), "wrong")


#: Rules of an audit: which are scored, and the states a value gets by its condition.
SCORED = {
    "clustering_enriched": "clustering_p < 0.05",
    "path_near_random": "path_ratio <= 1.25",
    "small_world": "small_world > 1",
    "modularity_enriched": "modularity_p < 0.05 and modularity_real > 0.3",
    "efficiency_near_random": "efficiency_ratio >= 0.8 and efficiency_ratio < 1",
    "local_efficiency_enriched": "local_efficiency_p < 0.05",
    "connector_hubs": "connector > 0",
    "rich_club": "club_run >= 3",
    "stable_scales": "stable_scales >= 1",
}
DESCRIPTIVE = {"box_scaling": "box_points >= 3"}


def ensembles(edges: DataFrame, colours: DataFrame | None, nulls: int, seed: int) -> DataFrame:
    """(kind, i, name, value): the measures of an audit on the real graph (kind real), its
    rewirings (null; inside pairs of colours if these are given) and random graphs of its
    size (random), a graph a task; the first connected rewiring of eight, else the one
    with the largest component."""
    shared = ensemble.Shared(edges)
    n, layer = shared.n, None
    if colours is not None:
        from tallygraph.model import relabel_ids

        c = relabel_ids(edges).join(colours.toDF("id", "colour"), "id").orderBy("new_id").toArrow()
        layer = c.column("colour").to_numpy()

    def f(i):
        s, t = shared.arrays()
        kind, k = ("real", 0) if i == 0 else ("null", i - 1) if i <= nulls else ("random", i - 1 - nulls)
        if kind == "null" and layer is None:
            s, t = kernel.connected_swaps(n, s, t, seed + 1000 + k)
        elif kind == "null":
            s, t = kernel.layer_swaps(n, s, t, layer, seed + 1000 + k)
        elif kind == "random":
            s, t = generate.uniform(n, len(s), np.random.default_rng(seed + 7777 + k))
        got = measures.core(n, s, t, seed + k + 1 if i else seed)
        return {"kind": [kind] * len(got), "i": [k] * len(got), "name": list(got), "value": list(got.values())}

    rows = 1 + 2 * nulls
    return ensemble._run(ensemble._rows(edges.sparkSession, rows, rows), f, "kind string, i long, name string, value double")


def audit(edges: DataFrame, colours: DataFrame | None = None, nulls: int = 100, club_nulls: int = 1000, runs: int = 20, gammas: tuple = (0.5, 0.7, 1.0, 1.5, 2.0, 2.5, 3.0), radii: tuple = (1, 2, 3, 4), seed: int = 42) -> DataFrame:
    """(rule, scored, verdict): pass, fail or not_tested for each rule, from real measures
    against rewirings. Colours are used if ``null_kind`` says that they carry the graph.
    Every intermediate result that reaches the driver is one row."""
    e = _cut(relabel(edges))
    if colours is not None and null_kind(edges, colours).first().kind == "plain":
        colours = None
    ens = _cut(ensembles(edges, colours, nulls, seed))
    value = lambda kind: ens.where(F.col("kind") == kind).select("name", "value")
    row = None
    for lower in (False, True):
        some = ens.where((F.col("name") == "efficiency") == F.lit(lower))
        x = inference.null_summary(some.where("kind = 'null'").select("name", "value"), some.where("kind = 'real'").select("name", "value"), ["name"], lower)
        row = x if row is None else row.unionByName(x)
    wide = row.groupBy().pivot("name", list(measures.NAMES)).agg(F.first("real").alias("real"), F.first("ratio").alias("ratio"), F.first("p").alias("p"))
    er = value("random").groupBy("name").agg(F.avg("value").alias("r")).join(value("real"), "name")
    sigma = er.agg((F.max(F.when(F.col("name") == "transitivity", F.col("value") / F.nullif("r", F.lit(0.0)))) / F.max(F.when(F.col("name") == "path", F.col("value") / F.col("r")))).alias("small_world"))
    best = ensemble.louvain(e, [1.0], 1, seed).select(F.col("vertex").alias("id"), "label")
    hubs = communities.hubs(e, _cut(best)).select("connector")
    clubs = richclub.null_table(ensemble.null_rich_clubs(e, club_nulls, seed), richclub.phi(e))
    club = richclub.runs(_cut(clubs.where("rho > 1 and p < 0.05").select("k")), "k").agg(F.coalesce(F.max("length"), F.lit(0)).alias("club_run"))
    labels = _cut(ensemble.louvain(e, list(gammas), runs, seed))
    low = richclub.minima(_cut(inference.stability(labels).select("gamma", "mean_vi")), "gamma", "mean_vi")
    x, y = labels.toDF("gamma", "run", "src", "la"), labels.toDF("gamma", "run", "dst", "lb")
    both = e.join(x, "src").join(y, ["gamma", "run", "dst"]).select("gamma", "run", F.explode(F.array(F.struct(F.col("la").alias("l"), (F.col("la") == F.col("lb")).cast("double").alias("i")), F.struct(F.col("lb").alias("l"), F.lit(0.0).alias("i")))).alias("x"))
    per = both.groupBy("gamma", "run", "x.l").agg(F.sum("x.i").alias("i"), F.count("*").cast("double").alias("d"))
    q = per.groupBy("gamma", "run").agg((F.sum("i") / (F.sum("d") / 2) - F.sum(F.col("d") * F.col("d")) / (F.sum("d") * F.sum("d"))).alias("q")).groupBy("gamma").agg(F.avg("q").alias("q"))
    stable = low.join(q, low["x"] == q["gamma"]).agg(F.count_if(F.col("q") > 0.3).alias("stable_scales"))
    boxes = ensemble.box_counts(e, list(radii)).agg(F.count_if(F.col("boxes") > 1).alias("box_points"))
    one = _cut(wide.crossJoin(sigma).crossJoin(hubs).crossJoin(club).crossJoin(stable).crossJoin(boxes))  # a row each
    scored = F.col("rule").isin(*SCORED)
    return verdicts(one, SCORED | DESCRIPTIVE).select("rule", scored.alias("scored"), "verdict")


def six_tests(model: DataFrame, other: DataFrame) -> DataFrame:
    """One row: the normalised errors of a graph's edges against another's in degrees,
    effective diameter, pairs within two hops, largest eigenvalues, principal vector and
    triangles, and their mean; 0 is an exact match."""
    from tallygraph.operators import spectra, triangles

    parts = None
    sides = []
    for name, e in (("m", _cut(model.select("src", "dst"))), ("r", _cut(other.select("src", "dst")))):
        h = _cut(ensemble.distance_histogram(e))
        values = _cut(spectra.scree(e).where("rank < 2"))
        top = values.agg(F.max(F.when(F.col("rank") == 0, F.col("value"))).alias(f"top_{name}"), F.max(F.when(F.col("rank") == 0, F.col("gap"))).alias(f"gap_{name}"))
        two = hop_plot(h).agg(F.max(F.when(F.col("h") <= 2, F.col("share"))).alias(f"two_{name}"))
        one = top.crossJoin(two).crossJoin(effective_diameter(h).toDF(f"wide_{name}")).crossJoin(degrees(e).agg(F.avg("degree").alias(f"mean_{name}")))
        parts = one if parts is None else parts.crossJoin(one)
        vector = spectra.network_value(e).select(F.round("value", 12).alias("value"))
        sides.append((degrees(e), _cut(vector), _cut(triangles.per_vertex(e))))
    for i, (k, column) in enumerate((("degree", "degree"), ("vector", "value"), ("triangles", "triangles"))):
        parts = parts.crossJoin(ks(sides[0][i], sides[1][i], column).toDF(f"ks_{k}"))
    gap = lambda c: F.abs(F.col(f"{c}_m") - F.col(f"{c}_r")) / F.col(f"{c}_r")
    ratio = lambda n: F.col(f"top_{n}") / F.col(f"mean_{n}")
    scree = 0.5 * F.abs(ratio("m") - ratio("r")) / ratio("r") + 0.5 * F.least(gap("gap"), F.lit(2.0))
    out = parts.select(F.col("ks_degree").alias("degrees"), gap("wide").alias("effective_diameter"), gap("two").alias("hops"), scree.alias("scree"), F.col("ks_vector").alias("vector"), F.col("ks_triangles").alias("triangles"))
    return out.withColumn("score", sum((F.col(c) for c in out.columns), F.lit(0.0)) / len(out.columns))


def ks_floor(x: DataFrame, y: DataFrame, column: str, at: float = 1.0) -> DataFrame:
    """One row: the shares of x equal to ``at`` and of y up to it, and their gap, which no
    monotone rule that keeps ``at`` can close."""
    a = x.agg(F.avg((F.col(column) == at).cast("double")).alias("ones"))
    b = y.agg(F.avg((F.col(column) <= at).cast("double")).alias("others"))
    return a.crossJoin(b).select("ones", "others", F.abs(F.col("ones") - F.col("others")).alias("floor"))


def small_world(transitivity: float, path: float, null_transitivity: float, null_path: float) -> float:
    """(T / T0) / (L / L0)."""
    return (transitivity / null_transitivity) / (path / null_path)


def verdicts(measures: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, verdict) of a one-row table: pass, fail, or not_tested where a rule's
    condition is null."""
    states = [F.struct(F.lit(name).alias("rule"), F.when(F.expr(c).isNull(), "not_tested").when(F.expr(c), "pass").otherwise("fail").alias("verdict")) for name, c in rules.items()]
    return measures.select(F.explode(F.array(*states)).alias("r")).select("r.rule", "r.verdict")


def weight_table(weights: DataFrame, column: str) -> DataFrame:
    """One row of a weight distribution: mean, median, max, share at most 5, share of 1,
    90 % over median, Gini."""
    w = weights.select(F.col(column).cast("double").alias("x"))
    one = w.agg(
        F.avg("x").alias("mean"), F.expr("percentile(x, 0.5)").alias("median"), F.max("x").alias("max"), F.avg((F.col("x") <= 5).cast("double")).alias("at_most_5"),
        F.avg((F.col("x") == 1).cast("double")).alias("ones"), (F.expr("percentile(x, 0.9)") / F.expr("percentile(x, 0.5)")).alias("p90_median"),
    )
    return one.crossJoin(gini_of(histogram(w, "x")))


def heavy_hub_share(edges: DataFrame, hubs: float = 0.1, heavy: float = 0.01) -> DataFrame:
    """One row: of the heaviest share of edges (src, dst, weight; those at least as heavy
    as the cutoff's), how many join two vertices of the top share of degrees."""
    edges = _cut(edges.select("src", "dst", "weight"))
    d = _cut(degrees(edges))
    limit = lambda t, c, q: t.agg(F.expr(f"percentile_disc({1 - q}) within group (order by {c})").alias("cutoff")).first()[0]
    dc, wc = limit(d, "degree", hubs), limit(edges, "weight", heavy)
    top = d.where(F.col("degree") >= F.lit(dc)).select("id")
    e = edges.where(F.col("weight") >= F.lit(wc))
    e = e.join(top.select(F.col("id").alias("src"), F.lit(1).alias("a")), "src", "left").join(top.select(F.col("id").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    return e.agg(F.count("*").alias("heavy"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("hub_hub"))


def keep_share(edges: DataFrame, share: float = 0.67) -> DataFrame:
    """Edges above the weight w for which the share of edges heavier than w comes
    nearest to ``share`` (ties to the lighter), from the histogram of weights."""
    h = edges.groupBy("weight").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    pick = h.select("weight", F.abs(above / total - share).alias("gap")).agg(F.min_by("weight", F.struct(F.round("gap", 12), "weight")).alias("w"))
    return edges.join(F.broadcast(pick), F.col("weight") > F.col("w")).select("src", "dst", "weight")


def enrichment(real: DataFrame, nulls: DataFrame) -> DataFrame:
    """(size, real, mean, ratio, z) of counts (size, cliques) against nulls (null_id,
    size, cliques): a size that a null lacks counts 0 there; 0 over 0 is 1."""
    runs = nulls.agg(F.count_distinct("null_id").alias("runs"))
    g = nulls.groupBy("size").agg(F.sum("cliques").alias("s"), F.sum(F.col("cliques").cast("double") * F.col("cliques")).alias("q"))
    j = real.select("size", F.col("cliques").alias("real")).join(g, "size", "full").crossJoin(runs)
    n, s, q, r = F.col("runs"), F.coalesce("s", F.lit(0)), F.coalesce("q", F.lit(0.0)), F.coalesce("real", F.lit(0))
    sd = F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / F.greatest(n - 1, F.lit(1))))
    ratio = F.when(s > 0, r / (s / n)).when(r > 0, F.lit(float("inf"))).otherwise(1.0)
    return j.select("size", r.alias("real"), (s / n).alias("mean"), ratio.alias("ratio"), F.when(sd > 0, (r - s / n) / sd).alias("z"))


def peaks(hist: DataFrame, x: str, y: str) -> DataFrame:
    """Local maxima of a histogram, gaps between its ends filled with 0."""
    ends = hist.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    grid = ends.select(F.explode(F.sequence("a", "b")).alias(x)).join(hist.select(x, y), x, "left").fillna(0, [y])
    w = Window.orderBy(x)
    c = grid.select(x, y, F.coalesce(F.lag(y).over(w), F.lit(0)).alias("l"), F.coalesce(F.lead(y).over(w), F.lit(0)).alias("r"))
    return c.where(f"{y} > l and {y} >= r").select(x, y)


def bimodality(hist: DataFrame, x: str, y: str) -> DataFrame:
    """One row of a histogram with whole x, gaps between its ends filled with 0: the fullest
    x (ties to the smaller), the two highest local maxima (ends count; a flat top is
    none), the valley between them over the lower one, and whether that is below half;
    nulls with fewer maxima or fewer than three filled x."""
    ends = hist.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.count("*").alias("filled"))
    grid = ends.select(F.explode(F.sequence("a", "b")).alias("x"), "filled").join(hist.select(F.col(x).alias("x"), F.col(y).alias("y")), "x", "left").fillna(0, ["y"])
    w = Window.orderBy("x")
    near = grid.select("x", "y", "filled", F.lag("y").over(w).alias("l"), F.lead("y").over(w).alias("r"))
    is_top = (F.col("filled") >= 3) & F.coalesce(F.col("y") > F.col("l"), F.lit(True)) & F.coalesce(F.col("y") > F.col("r"), F.lit(True)) & (F.col("l").isNotNull() | F.col("r").isNotNull())
    rank = F.row_number().over(Window.orderBy(F.desc("y"), "x"))
    two = near.where(is_top).select("x", "y", rank.alias("k")).where("k <= 2").agg(F.min("x").alias("first"), F.max("x").alias("second"), F.min("y").alias("lower"), F.count("*").alias("n"))
    valley = grid.crossJoin(two).where("n = 2 and x >= first and x <= second").agg(F.min("y").alias("valley"))
    most = hist.agg(F.max_by(x, F.struct(y, -F.col(x))).alias("fullest"))
    on = F.col("n") == 2
    ratio = F.when(on & (F.col("lower") > 0), F.col("valley") / F.col("lower"))
    return most.crossJoin(two).crossJoin(valley).select("fullest", F.when(on, F.col("first")).alias("first"), F.when(on, F.col("second")).alias("second"), ratio.alias("ratio"), F.coalesce(ratio < 0.5, F.lit(False)).alias("bimodal"))


def participation_table(rows: DataFrame) -> DataFrame:
    """One row of (vertex, degree, cliques): mean, sd (n), median and most cliques, vertices
    above mean + 2 sd, correlation with degree (0 where one doesn't vary), Gini."""
    x = rows.select(F.col("degree").cast("double").alias("d"), F.col("cliques").cast("double").alias("c"))
    one = x.agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.expr("percentile(c, 0.5)").alias("median"), F.max("c").alias("max"), F.coalesce(correlation("c", "d"), F.lit(0.0)).alias("r"))
    high = x.crossJoin(one.select((F.col("mean") + 2 * F.col("std")).alias("cut"))).agg(F.count_if(F.col("c") > F.col("cut")).alias("high"), F.avg((F.col("c") > F.col("cut")).cast("double")).alias("high_share"))
    return one.crossJoin(high).crossJoin(gini_of(histogram(x, "c"))).select("mean", "std", "median", "max", "high", "high_share", F.col("r").alias("degree_correlation"), "gini")
