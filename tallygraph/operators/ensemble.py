"""Kernels over rows: one (kind, seed, resolution) or block of sources a row.

The graph goes to the tasks once, behind a check of its size. Of larger graphs, distances,
betweenness, boxes and labels take each component of bounded size by the same kernel, in groups,
and larger components by joins; the rest take the join forms in ``paths`` and ``triangles``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.kernels import graphs
from tallygraph.model import both_ways, degrees, relabel, ship
from tallygraph.operators import partition, paths, rewiring
from tallygraph.operators.paths import _cut

MOST_EDGES = 5_000_000
#: Rows that a walk by joins holds at once: sources times vertices.
MOST_PAIRS = 50_000_000
#: Nulls over tables that are made at once.
NULLS = 4


def arrays(edges: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Vertex count and end arrays of a graph of bounded size, ids made dense."""
    m = edges.count()
    if m > MOST_EDGES:
        raise ValueError(f"{m} edges; kernels take {MOST_EDGES}")
    e = relabel(edges).orderBy("src", "dst").toArrow()
    src, dst = e.column("src").to_numpy(), e.column("dst").to_numpy()
    return int(max(src.max(initial=-1), dst.max(initial=-1)) + 1), src, dst


def _rows(spark, n: int, parts: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, parts or max(1, min(n, spark.sparkContext.defaultParallelism * 2)))


def _run(df: DataFrame, f, schema: str) -> DataFrame:
    def go(batches):
        for b in batches:
            for i in b.id:
                yield pd.DataFrame(f(int(i)))

    ship(df.sparkSession)
    return df.mapInPandas(go, schema)


_graphs: dict[str, graphs.Csr] = {}


class Shared:
    """A graph of bounded size for kernels: its arrays go to each worker once, by
    broadcast, and a worker sorts its neighbour lists once, not once a task."""

    def __init__(self, edges: DataFrame):
        self.n, s, t = arrays(edges)
        self.m, self.name = len(s), uuid.uuid4().hex
        self.ends = edges.sparkSession.sparkContext.broadcast((s, t))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ends.value

    def graph(self) -> graphs.Csr:
        if self.name not in _graphs:
            _graphs.clear()
            _graphs[self.name] = graphs.Csr(self.n, *self.ends.value)
        return _graphs[self.name]


def _sources(n: int, sample: int | None, seed: int) -> np.ndarray:
    """All vertices, or a seeded sample of so many."""
    return np.arange(n) if sample is None or sample >= n else np.sort(np.random.default_rng(seed).choice(n, sample, replace=False))


class Split:
    """A graph of any size for kernels, ids made dense: components of at most MOST_EDGES edges
    as groups, and the ``large`` ones as a table."""

    def __init__(self, edges: DataFrame):
        e = _cut(relabel(edges))
        held = e.join(paths.components(e).toDF("src", "component"), "src")
        held = _cut(held.join(held.groupBy("component").agg(F.count("*").alias("m")), "component"))
        self.n = (e.agg(F.max("dst")).first()[0] or -1) + 1
        self.m = held.count()
        self.large = held.where(F.col("m") > MOST_EDGES).select("src", "dst")
        self.small = held.where(F.col("m") <= MOST_EDGES).select("component", "src", "dst")
        self.count = self.small.select("component").distinct().count()

    def chunks(self) -> int:
        """Groups a component is dealt to where a kernel takes its sources in shares."""
        return max(1, -(-4 * self.small.sparkSession.sparkContext.defaultParallelism // max(1, self.count)))

    def run(self, f, schema: str, chunks: int) -> DataFrame:
        """f(chunk, chunks, ids, graph, src, dst) over every component of bounded size and chunk;
        vertices of the graph are places in ids, which rise."""

        def go(key, df: pd.DataFrame) -> pd.DataFrame:
            src, dst = df["src"].to_numpy(), df["dst"].to_numpy()
            order = np.lexsort((dst, src))
            ids = np.unique(np.concatenate([src, dst]))
            s, t = np.searchsorted(ids, src[order]), np.searchsorted(ids, dst[order])
            return pd.DataFrame(f(int(key[1]), chunks, ids, graphs.Csr(len(ids), s, t), s, t))

        ship(self.small.sparkSession)
        rows = self.small.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        # A number of its own, so that groups that are small but slow don't share a task.
        return rows.repartition(max(1, min(2 * chunks * self.count, 1_000)), "component", "chunk").groupBy("component", "chunk").applyInPandas(go, schema)

    def blocks(self, some: np.ndarray | None) -> list[DataFrame]:
        """Sources of the large components, in blocks whose walks hold MOST_PAIRS rows."""
        if self.large.isEmpty():
            return []
        ids = self.large.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if some is not None:
            ids = ids.where(F.col("id").isin([int(x) for x in some]))
        ids = _cut(ids)
        parts = -(-ids.count() * self.n // MOST_PAIRS)
        return [ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) for i in range(parts)]


def _few(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges, written once, and whether a kernel takes them all."""
    e = _cut(edges)
    return e, e.count() <= MOST_EDGES


def _chosen(ids: np.ndarray, some: np.ndarray | None) -> np.ndarray:
    return np.arange(len(ids)) if some is None else np.flatnonzero(np.isin(ids, some))


def _histogram_of_any(split: Split, some: np.ndarray | None) -> DataFrame:
    def f(i, chunks, ids, g, s, t):
        total = graphs.reach_counts(g, _chosen(ids, some)[i::chunks])
        return {"d": np.arange(len(total)), "pairs": total}

    got = split.run(f, "d long, pairs long", split.chunks()).where("d > 0").groupBy("d").agg(F.sum("pairs").alias("pairs"))
    total: dict[int, int] = {}
    for block in split.blocks(some):
        for r in paths.histogram(paths.distances(split.large, block)).collect():  # a row a distance
            total[r.d] = total.get(r.d, 0) + r.pairs
    far = split.large.sparkSession.createDataFrame(sorted(total.items()), "d long, pairs long")
    return got.unionByName(far).groupBy("d").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def distance_histogram(edges: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """(d, pairs) over ordered pairs from every vertex, or from a seeded sample of so
    many sources (then the largest d bounds the diameter from below). Above MOST_EDGES by
    components, and in those above it by joins, a block of sources at a time."""
    edges, few = _few(edges)
    if not few:
        split = Split(edges)
        return _histogram_of_any(split, None if sample is None or sample >= split.n else _sources(split.n, sample, seed))
    shared = Shared(edges)
    some = _sources(shared.n, sample, seed)

    def f(i):
        total = graphs.reach_counts(shared.graph(), some[i * 64 : i * 64 + 64])
        return {"d": np.arange(len(total)), "pairs": total}

    return _run(_rows(edges.sparkSession, -(-len(some) // 64)), f, "d long, pairs long").where("d > 0").groupBy("d").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def _dependencies(near: DataFrame, sources: DataFrame) -> DataFrame:
    """(vertex, part): dependencies of every vertex summed over the sources (id), by joins: paths are
    counted a level a round going out and shared out coming back."""
    level = _cut(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("sigma")))
    levels = [level]
    while True:
        step = level.join(near, "id").groupBy("source", F.col("other").alias("id")).agg(F.sum("sigma").alias("sigma"))
        for held in levels[-2:]:  # a neighbour is a level nearer, as far or a level farther
            step = step.join(held, ["source", "id"], "left_anti")
        level = _cut(step)
        if level.isEmpty():
            break
        levels.append(level)
    far, out = levels[-1].withColumn("delta", F.lit(0.0)), []
    for nearer in reversed(levels[:-1]):
        if len(levels) > 1:
            out.append(far)
        give = far.select("source", "id", ((1 + F.col("delta")) / F.col("sigma")).alias("x"))
        got = give.join(near, "id").select("source", F.col("other").alias("id"), "x").join(nearer, ["source", "id"])
        got = got.groupBy("source", "id").agg((F.first("sigma") * F.sum("x")).alias("delta"))
        far = _cut(nearer.join(got, ["source", "id"], "left").fillna(0.0, ["delta"]))
    parts = out[0] if out else far.limit(0)  # a source's own level is left out
    for more in out[1:]:
        parts = parts.unionByName(more)
    return _cut(parts.groupBy(F.col("id").alias("vertex")).agg(F.sum("delta").alias("part")))


def _betweenness_of_any(split: Split, some: np.ndarray | None) -> DataFrame:
    def f(i, chunks, ids, g, s, t):
        return {"vertex": ids, "part": graphs.brandes(g, _chosen(ids, some)[i::chunks])}

    parts = split.run(f, "vertex long, part double", split.chunks())
    near = _cut(both_ways(split.large))
    for block in split.blocks(some):
        parts = parts.unionByName(_dependencies(near, block))
    ids = split.large.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().select("vertex", F.lit(0.0).alias("part"))
    n, took = split.n, split.n if some is None else len(some)
    scale = n / max(1, took) / max(1, (n - 1) * (n - 2))
    return parts.unionByName(ids).groupBy("vertex").agg((F.sum("part") * scale).alias("betweenness"))


def betweenness(edges: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """(vertex, betweenness), normalised; vertices by dense id. Exact, or from a seeded
    sample of so many sources, scaled up by n over their number. Above MOST_EDGES by
    components, and in those above it by joins, a block of sources at a time."""
    edges, few = _few(edges)
    if not few:
        split = Split(edges)
        return _betweenness_of_any(split, None if sample is None or sample >= split.n else _sources(split.n, sample, seed))
    shared = Shared(edges)
    n, some = shared.n, _sources(shared.n, sample, seed)

    def f(i):
        return {"vertex": np.arange(n), "part": graphs.brandes(shared.graph(), some[i * 64 : i * 64 + 64])}

    scale = n / max(1, len(some)) / max(1, (n - 1) * (n - 2))
    return _run(_rows(edges.sparkSession, -(-len(some) // 64)), f, "vertex long, part double").groupBy("vertex").agg((F.sum("part") * scale).alias("betweenness"))


def _null_rich_clubs_of_any(edges: DataFrame, nulls: int, seed: int) -> DataFrame:
    """Of nulls over tiles, a few at a time: degrees are the graph's, so a null only adds the histogram of its edges' lesser
    degrees. Ids are places in order of (degree, id), so an edge's lesser degree is that of its lesser end."""
    deg = _cut(degrees(edges))
    sizes = sorted((r.degree, r.n) for r in deg.groupBy("degree").agg(F.count("*").alias("n")).collect())  # a row a degree
    spark, k, n = edges.sparkSession, np.array([d for d, _ in sizes]), np.array([c for _, c in sizes])
    start = np.cumsum(n) - n
    before = F.broadcast(spark.createDataFrame(list(zip(k.tolist(), start.tolist())), "degree long, before long"))
    place = F.row_number().over(Window.partitionBy("degree").orderBy("id")) - 1 + F.col("before")
    new = _cut(deg.join(before, "degree").select("id", place.cast("long").alias("place")))
    e = edges.join(new.toDF("src", "x"), "src").join(new.toDF("dst", "y"), "dst")
    e = _cut(e.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")))

    def count(batches):
        for b in batches:
            at = np.searchsorted(start, b.column("src").to_numpy(), "right") - 1
            code, m = np.unique(b.column("null_id").to_numpy() * len(k) + at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // len(k)), pa.array(code % len(k)), pa.array(m)], names=["null_id", "at", "m"])

    above = np.cumsum(n[::-1])[::-1]  # vertices of this degree or more, as of all k from the degree before it on
    out: dict[str, list] = {"null_id": [], "k": [], "phi": []}
    for first in range(0, nulls, NULLS):
        many = min(NULLS, nulls - first)
        held = np.zeros((many, len(k)), np.int64)
        ship(spark)
        got = rewiring.tiled(e, many, seed=seed + 5000 + first).mapInArrow(count, "null_id long, at long, m long")
        for r in got.groupBy("null_id", "at").agg(F.sum("m").alias("m")).collect():  # a row a null and degree
            held[r.null_id, r.at] = r.m
        inside = np.cumsum(held[:, ::-1], 1)[:, ::-1]
        reach = np.repeat(np.arange(len(k)), np.diff(np.r_[0, k]))
        reach = reach[above[reach] >= 2]
        for i in range(many):
            out["null_id"] += [first + i] * len(reach)
            out["k"] += list(range(len(reach)))
            out["phi"] += (2 * inside[i, reach] / (above[reach] * (above[reach] - 1))).tolist()
    return spark.createDataFrame(pd.DataFrame(out), "null_id long, k long, phi double")


def null_rich_clubs(edges: DataFrame, nulls: int, seed: int = 42) -> DataFrame:
    """(null_id, k, phi) of degree-preserving rewirings, a seed each; above MOST_EDGES over tables."""
    edges, few = _few(edges)
    if not few:
        return _null_rich_clubs_of_any(edges, nulls, seed)
    shared = Shared(edges)

    def f(i):
        phi = graphs.rich_club(shared.n, *graphs.swaps(shared.n, *shared.arrays(), seed + 5000 + i))
        return {"null_id": np.full(len(phi), i), "k": np.arange(len(phi)), "phi": phi}

    return _run(_rows(edges.sparkSession, nulls, nulls), f, "null_id long, k long, phi double")


def weighted_nulls(edges: DataFrame, nulls: int, seed: int = 42, attempts: int = 8) -> DataFrame:
    """(null_id, k, phi): weighted curves of rewirings (the first connected of some, a seed
    each) whose edges get the weights (src, dst, weight) in seeded order. phi is the
    weight among vertices of degree above k over that of as many heaviest edges."""
    from tallygraph.kernels import structure

    shared = Shared(edges.select("src", "dst"))
    w = edges.agg(F.sort_array(F.collect_list(F.col("weight").cast("double")))).first()[0]  # as many as Shared has checked
    weights = edges.sparkSession.sparkContext.broadcast(np.array(w or [], float))

    def f(i):
        a, b = structure.connected_swaps(shared.n, *shared.arrays(), seed + 1000 + i, attempts)
        dealt = np.random.default_rng(seed + 2000 + i).permutation(weights.value)
        phi = graphs.weighted_rich_club(shared.n, a, b, dealt)
        return {"null_id": np.full(len(phi), i), "k": np.arange(len(phi)), "phi": phi}

    return _run(_rows(edges.sparkSession, nulls, nulls), f, "null_id long, k long, phi double")


def connected_nulls(edges: DataFrame, nulls: int, seed: int = 42, attempts: int = 8) -> DataFrame:
    """(null_id, src, dst): for each seed the first connected one of some rewirings, else
    the one of the largest component; dense ids."""
    from tallygraph.kernels import structure

    shared = Shared(edges)

    def f(i):
        a, b = structure.connected_swaps(shared.n, *shared.arrays(), seed + 1000 + i, attempts)
        return {"null_id": np.full(len(a), i), "src": a, "dst": b}

    return _run(_rows(edges.sparkSession, nulls, nulls), f, "null_id long, src long, dst long")


def _labels_of_any(split: Split, gammas: list[float], repeats: int, seed: int, potts: bool) -> DataFrame:
    k, m, schema = len(gammas) * repeats, split.m, "gamma double, run long, vertex long, label long"

    def f(i, chunks, ids, g, s, t):
        gamma, r = gammas[i // repeats], i % repeats
        # A component's share of the edges, so that degrees weigh as in the whole graph.
        label = graphs.louvain(g.n, s, t, gamma if potts else gamma * len(s) / m, seed + r, potts)
        return {"gamma": gamma, "run": r, "vertex": ids, "label": ids[np.unique(label, return_index=True)[1]][label]}

    got = split.run(f, schema, k)
    large = split.large.count()
    if not large:
        return got
    quality = "potts" if potts else "modularity"
    for gamma in gammas:  # the runs of a resolution are copies side by side, which hash, and so turn, by their ids
        at = lambda c: (F.col(c) * (repeats + seed) + F.col("run")).alias(c)
        copies = _cut(split.large.crossJoin(_rows(split.large.sparkSession, repeats, 1).toDF("run")))
        ends = copies.select("run", F.explode(F.array("src", "dst")).alias("id")).distinct()
        labels = partition.louvain(copies.select(at("src"), at("dst")), gamma if potts else gamma * large / m, quality, _cut(ends.select(at("id"), F.col("run").alias("block"))))
        of = lambda c: F.expr(f"{c} div {repeats + seed}")
        got = got.unionByName(labels.select(F.lit(float(gamma)).alias("gamma"), F.pmod("id", F.lit(repeats + seed)).cast("long").alias("run"), of("id").alias("vertex"), of("label").alias("label")))
    return got


def louvain(edges: DataFrame, gammas: list[float], repeats: int, seed: int = 42, potts: bool = False) -> DataFrame:
    """(gamma, run, vertex, label): every resolution and seed a task; by modularity or
    the constant Potts model. Above MOST_EDGES a component a task, as labels never reach
    across, and components above it by the table form; a label is then one of its vertices."""
    edges, few = _few(edges)
    if not few:
        return _labels_of_any(Split(edges), gammas, repeats, seed, potts)
    shared = Shared(edges)
    n = shared.n

    def f(i):
        g, r = gammas[i // repeats], i % repeats
        return {"gamma": np.full(n, g), "run": np.full(n, r), "vertex": np.arange(n), "label": graphs.louvain(n, *shared.arrays(), g, seed + r, potts)}

    k = len(gammas) * repeats
    return _run(_rows(edges.sparkSession, k, k), f, "gamma double, run long, vertex long, label long")


def clique_census(edges: DataFrame) -> DataFrame:
    """(size, cliques): maximal cliques, each found from its first vertex by degree."""
    return clique_members(edges, False).groupBy("size").agg(F.sum("cliques").alias("cliques"))


def clique_members(edges: DataFrame, members: bool = True) -> DataFrame:
    """(size, vertex, cliques): how many maximal cliques of a size hold a vertex, as
    partial counts a task; without ``members`` (size, cliques)."""
    shared = Shared(edges)

    def f(i):
        g, total = shared.graph(), {}
        if not hasattr(g, "rank"):
            g.rank = graphs.by_degree(g)
        for v in range(i * 256, min(g.n, i * 256 + 256)):
            for c in graphs.cliques(g, v, g.rank):
                for key in [(len(c), x) for x in c] if members else [(len(c),)]:
                    total[key] = total.get(key, 0) + 1
        columns = list(zip(*total)) if total else [[], []][: 1 + members]
        return dict(zip(("size", "vertex"), columns)) | {"cliques": list(total.values())}

    return _run(_rows(edges.sparkSession, -(-shared.n // 256)), f, "size long, vertex long, cliques long" if members else "size long, cliques long")


def participation(edges: DataFrame) -> DataFrame:
    """(vertex, degree, cliques): maximal cliques of two or more vertices at each vertex."""
    d = degrees(relabel(edges)).withColumnRenamed("id", "vertex")
    return d.join(clique_members(edges).groupBy("vertex").agg(F.sum("cliques").alias("cliques")), "vertex")


def spectrum(edges: DataFrame, most: int = 4_000) -> DataFrame:
    """One row of spectral measures of a small graph: largest and least adjacency
    eigenvalue, energy, log10 Estrada, Hoffman bound, Kirchhoff index, spanning-tree
    entropy, algebraic connectivity, random-walk gap."""
    n, s, t = arrays(edges)
    if n > most:
        raise ValueError(f"{n} vertices; dense spectra take {most}")

    def f(_):
        a = np.zeros((n, n))
        a[s, t] = a[t, s] = 1
        d = a.sum(1)
        x = np.linalg.eigvalsh(a)
        mu = np.linalg.eigvalsh(np.diag(d) - a)
        root = 1 / np.sqrt(np.maximum(d, 1))
        walk = np.linalg.eigvalsh(a * root[:, None] * root[None, :])
        up = mu[mu > 1e-10]
        return {
            "n": [n], "lambda_max": [x[-1]], "lambda_min": [x[0]], "ratio": [x[-1] / d.mean()], "energy": [np.abs(x).sum()],
            "log_estrada": [(x[-1] + np.log(np.exp(x - x[-1]).sum())) / np.log(10)], "hoffman": [1 + x[-1] / abs(x[0])],
            "kirchhoff": [n * (1 / up).sum()], "tree_entropy": [(np.log(up).sum() - np.log(n)) / n], "connectivity": [mu[1]], "walk_gap": [walk[-1] - walk[-2]],
        }

    names = "n long, " + ", ".join(f"{c} double" for c in ("lambda_max", "lambda_min", "ratio", "energy", "log_estrada", "hoffman", "kirchhoff", "tree_entropy", "connectivity", "walk_gap"))
    return _run(_rows(edges.sparkSession, 1, 1), f, names)


def fractional_cover(edges: DataFrame) -> DataFrame:
    """Value of the fractional vertex cover, which is that of the fractional matching:
    half the largest matching of the bipartite double cover."""
    n, s, t = arrays(edges)

    def f(_):
        near: list[list[int]] = [[] for _ in range(n)]
        for a, b in zip(s.tolist(), t.tolist()):
            near[a].append(b)
            near[b].append(a)
        return {"value": [graphs.matching(n, n, near) / 2]}

    return _run(_rows(edges.sparkSession, 1, 1), f, "value double")


def _boxes(near: DataFrame, radius: int) -> int:
    """Boxes of that cover by joins. A centre's choice changes masses within twice the radius only, so all
    vertices that lead (mass, then smaller id) so far are centres of one round, as they would be one by one."""
    ids = near.select("id").distinct()
    ball = front = _cut(ids.select("id", F.col("id").alias("other")))
    for _ in range(radius):
        step = front.join(near.toDF("other", "next"), "other").select("id", F.col("next").alias("other")).distinct()
        front = _cut(step.join(ball, ["id", "other"], "left_anti"))
        ball = ball.unionByName(front)
    open_, count = _cut(ids), 0
    while not open_.isEmpty():
        mass = ball.join(open_.toDF("other"), "other").groupBy("id").agg(F.struct(F.count("*").alias("mass"), (-F.col("id")).alias("first")).alias("x"))
        led = mass = _cut(mass)
        for _ in range(2):
            led = _cut(ball.join(led.toDF("other", "x"), "other").groupBy("id").agg(F.max("x").alias("x")))
        centres = _cut(mass.join(led.toDF("id", "most"), "id").where("x = most").select("id"))
        count += centres.count()
        open_ = _cut(open_.join(ball.join(centres, "id").select(F.col("other").alias("id")), "id", "left_anti"))
    return count


def box_counts(edges: DataFrame, radii: list[int]) -> DataFrame:
    """(radius, boxes) of the maximal-excluded-mass cover. Above MOST_EDGES by components, and in
    those above it by joins."""
    edges, few = _few(edges)
    if not few:
        split = Split(edges)
        got = split.run(lambda i, chunks, ids, g, s, t: {"radius": [radii[i]], "boxes": [graphs.boxes(g, radii[i])]}, "radius long, boxes long", len(radii))
        if not split.large.isEmpty():
            near = _cut(both_ways(split.large))
            got = got.unionByName(edges.sparkSession.createDataFrame([(r, _boxes(near, r)) for r in radii], "radius long, boxes long"))
        return got.groupBy("radius").agg(F.sum("boxes").alias("boxes"))
    shared = Shared(edges)
    return _run(_rows(edges.sparkSession, len(radii), len(radii)), lambda i: {"radius": [radii[i]], "boxes": [graphs.boxes(shared.graph(), radii[i])]}, "radius long, boxes long")
