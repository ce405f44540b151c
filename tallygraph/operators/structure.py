"""Structure of one graph: kernels over rows of sources, trials or kinds, and the
DataFrame forms of weighted rich clubs, nesting, refinement and fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.kernels import generate, graphs
from tallygraph.kernels import structure as kernel
from tallygraph.model import both_ways, canonical, degrees, relabel, relabel_ids, ship
from tallygraph.operators import baselines as tables
from tallygraph.operators import colouring as colouring_
from tallygraph.operators import ensemble, forests, rewiring, triangles
from tallygraph.operators.ensemble import MOST_EDGES, Shared, _rows, _run, arrays
from tallygraph.operators.paths import _cut
from tallygraph.operators.tiles import Tiles

#: Edges of neighbourhoods that a task takes as one group, about.
TRIANGLES = 1_000_000


def _once(edges: DataFrame, f, schema: str) -> DataFrame:
    n, s, t = arrays(edges)
    return _run(_rows(edges.sparkSession, 1, 1), lambda _: f(n, s, t), schema)


def bridges(edges: DataFrame) -> DataFrame:
    """(src, dst) on no cycle; dense ids."""
    e = _cut(edges.select("src", "dst"))
    return forests.dense(forests.bridges(e), e)


def odd_cycle(edges: DataFrame) -> DataFrame:
    """(at, vertex) around an odd cycle; no rows if the graph is bipartite; dense ids."""
    e = _cut(edges.select("src", "dst"))
    new = relabel_ids(e).toDF("vertex", "new")
    return forests.odd_cycle(e).join(new, "vertex").select("at", F.col("new").alias("vertex"))


def enforce_odd_cycle(edges: DataFrame, witness: DataFrame) -> DataFrame:
    """The edges, with those of the witness cycle where they are bipartite without."""
    if not odd_cycle(edges).isEmpty():
        return edges
    both = edges.unionByName(witness.select("src", "dst")).distinct()
    if odd_cycle(both).isEmpty():
        raise ValueError("the witness closes no odd cycle")
    return both


def matching(edges: DataFrame) -> DataFrame:
    """(src, dst) of a largest matching; dense ids."""

    def f(n, s, t):
        e = np.array(kernel.blossom(graphs.Csr(n, s, t)), np.int64).reshape(-1, 2)
        return {"src": e[:, 0], "dst": e[:, 1]}

    return _once(edges, f, "src long, dst long")


def maximal_matching(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(src, dst) that no edge can be added to, by rounds of local minima of hashed
    priorities; its ends are a vertex cover at most twice the least."""
    left, taken = _cut(edges.select("src", "dst", F.xxhash64(F.lit(seed), "src", "dst").alias("p"))), None
    while not left.isEmpty():
        rank = F.struct("p", "src", "dst")
        ends = left.select(F.explode(F.array("src", "dst")).alias("id"), rank.alias("r")).groupBy("id").agg(F.min("r").alias("best"))
        a, b = ends.toDF("src", "ba"), ends.toDF("dst", "bb")
        won = _cut(left.join(a, "src").join(b, "dst").where((F.col("ba") == rank) & (F.col("bb") == rank)).select("src", "dst"))
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode(F.array("src", "dst")).alias("id"))
        left = _cut(left.join(used.toDF("src"), "src", "left_anti").join(used.toDF("dst"), "dst", "left_anti").select("src", "dst", "p"))
    return edges.select("src", "dst").limit(0) if taken is None else taken


def colouring(edges: DataFrame) -> DataFrame:
    """(vertex, colour) by greedy saturation; dense ids. Above MOST_EDGES a component a task, whose colours are those it has in
    the whole graph; components above it are coloured by the table form, by degree instead of saturation."""
    edges, few = ensemble._few(edges)
    if few:
        return _once(edges, lambda n, s, t: {"vertex": np.arange(n), "colour": kernel.dsatur(graphs.Csr(n, s, t))}, "vertex long, colour long")
    split = ensemble.Split(edges)
    got = split.run(lambda i, chunks, ids, g, s, t: {"vertex": ids, "colour": kernel.dsatur(g)}, "vertex long, colour long", 1)
    if split.large.isEmpty():
        return got
    return got.unionByName(colouring_.priority_colouring(split.large).select(F.col("id").alias("vertex"), F.col("colour").cast("long").alias("colour")))


def chromatic_number(edges: DataFrame, most: int = 8, vertices: int = 40) -> DataFrame:
    """One row: the exact number of a small graph, or most + 1 beyond ``most``."""
    n, s, t = arrays(edges)
    if n > vertices:
        raise ValueError(f"{n} vertices; exact colouring takes {vertices}")
    return _run(_rows(edges.sparkSession, 1, 1), lambda _: {"colours": [kernel.chromatic(graphs.Csr(n, s, t), most)]}, "colours long")


def symmetry(edges: DataFrame, vertices: int = 200) -> DataFrame:
    """(vertex, orbit, log_order): orbits of the automorphism group by least vertex, and
    the natural logarithm of its order; small graphs."""
    n, s, t = arrays(edges)
    if n > vertices:
        raise ValueError(f"{n} vertices; symmetry takes {vertices}")

    def f(_):
        import math

        order, orbit = kernel.symmetry(graphs.Csr(n, s, t))
        return {"vertex": np.arange(n), "orbit": orbit, "log_order": [math.log(order)] * n}

    return _run(_rows(edges.sparkSession, 1, 1), f, "vertex long, orbit long, log_order double")


def edge_symmetry(edges: DataFrame, vertices: int = 60) -> DataFrame:
    """(src, dst, orbit): edge orbits of the automorphism group of a small graph, each by
    the number of its first edge; dense ids."""
    n, s, t = arrays(edges)
    if n > vertices:
        raise ValueError(f"{n} vertices; edge symmetry takes {vertices}")

    def f(_):
        e = np.array(kernel.edge_orbits(graphs.Csr(n, s, t)), np.int64).reshape(-1, 3)
        return {"src": e[:, 0], "dst": e[:, 1], "orbit": e[:, 2]}

    return _run(_rows(edges.sparkSession, 1, 1), f, "src long, dst long, orbit long")


def group_entropy(groups: DataFrame, key: str) -> DataFrame:
    """Bits of entropy of the group sizes, and how many groups."""
    c = groups.groupBy(key).agg(F.count("*").cast("double").alias("n"))
    return c.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"), F.count("*").alias("groups"))


def refined(edges: DataFrame) -> DataFrame:
    """(id, colour): stable colours, a bound on the orbits of graphs of any size. A
    vertex's next colour hashes its own and the sum of its neighbours' mixed colours,
    so a hub's neighbours meet as partial sums only."""
    edges = _cut(edges)
    colour = _cut(degrees(edges).select("id", F.col("degree").alias("colour")))
    tiles = Tiles(both_ways(edges), colour.agg(F.sum("colour")).first()[0] or 0)
    count = colour.select("colour").distinct().count()
    while True:
        around = tiles.sums(colour.select("id", F.xxhash64("colour").alias("s")))
        colour = _cut(colour.join(around, "id").select("id", F.xxhash64("colour", F.col("s").cast("string")).alias("colour")))
        now = colour.select("colour").distinct().count()
        if now == count:
            tiles.close()
            return colour
        count = now


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness): shortest paths over each edge, as a share of vertex
    pairs; dense ids."""
    shared = Shared(edges)
    n = shared.n

    def f(i):
        g = shared.graph()
        owner = np.repeat(np.arange(n), g.degree)
        part = kernel.edge_brandes(g, range(i * 64, min(n, i * 64 + 64)))
        on = part > 0
        return {"src": np.minimum(owner, g.near)[on], "dst": np.maximum(owner, g.near)[on], "part": part[on]}

    scale = 1.0 / max(1, n * (n - 1))
    return _run(_rows(edges.sparkSession, -(-n // 64)), f, "src long, dst long, part double").groupBy("src", "dst").agg((F.sum("part") * scale).alias("betweenness"))


def skeleton(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness): the heaviest spanning forest by edge betweenness."""
    got = edge_betweenness(edges).withColumn("betweenness", F.round("betweenness", 12)).orderBy("src", "dst").toArrow()
    s, t, w = (got.column(c).to_numpy() for c in ("src", "dst", "betweenness"))
    n = int(max(s.max(initial=-1), t.max(initial=-1)) + 1)

    def f(_):
        at = kernel.spanning(n, s, t, w)
        return {"src": s[at], "dst": t[at], "betweenness": w[at]}

    return _run(_rows(edges.sparkSession, 1, 1), f, "src long, dst long, betweenness double")


def random_box_counts(edges: DataFrame, lengths: list[int], trials: int, seed: int = 42) -> DataFrame:
    """(length, boxes): the fewest boxes over trials of random covers, a trial a task."""
    shared = Shared(edges)

    def f(i):
        length = lengths[i // trials]
        return {"length": [length], "boxes": [kernel.random_boxes(shared.graph(), length, seed + i % trials)]}

    k = len(lengths) * trials
    return _run(_rows(edges.sparkSession, k, k), f, "length long, boxes long").groupBy("length").agg(F.min("boxes").alias("boxes"))


def scaling_fit(counts: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """One row: slope and R2 of log10 y on log10 x (power) and of ln y on x
    (exponential), over rows with y > 1; null with fewer points than ``least``."""
    c = counts.where(F.col(y) > 1).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"), F.log(y).alias("ny"), F.col(x).cast("double").alias("x"))
    ok = F.count("*") >= least
    return c.agg(
        F.when(ok, -F.regr_slope("ly", "lx")).alias("dimension"), F.when(ok, F.regr_r2("ly", "lx")).alias("power_r2"),
        F.when(ok, -F.regr_slope("ny", "x")).alias("rate"), F.when(ok, F.regr_r2("ny", "x")).alias("exponential_r2"), F.count("*").alias("points"),
    )


def _local_efficiency_of_any(edges: DataFrame) -> DataFrame:
    e = _cut(relabel(edges))
    tri = _cut(triangles.triangles(e))
    parts = max(1, tri.count() * 3 // TRIANGLES)
    corner = lambda v, a, b: F.struct(F.col(v).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    rows = tri.select(F.explode(F.array(corner("a", "b", "c"), corner("b", "a", "c"), corner("c", "a", "b"))).alias("t")).select("t.*")

    def go(t):
        v, total = kernel.ego_paths(t["v"].to_numpy(), t["a"].to_numpy(), t["b"].to_numpy())
        return pa.table({"id": v, "total": total})

    ship(edges.sparkSession)
    sums = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts))).groupBy("part").applyInArrow(go, "id long, total double")
    pairs = F.col("degree") * (F.col("degree") - 1)
    return degrees(e).join(sums, "id", "left").select(F.col("id").alias("vertex"), F.when(F.col("total").isNull(), 0.0).otherwise(F.col("total") / pairs).alias("efficiency"))


def local_efficiency(edges: DataFrame) -> DataFrame:
    """(vertex, efficiency) inside each vertex's neighbourhood; dense ids. Above MOST_EDGES from triangles: those at
    a vertex are the edges of its neighbourhood, and many neighbourhoods are one group."""
    edges, few = ensemble._few(edges)
    if not few:
        return _local_efficiency_of_any(edges)
    shared = Shared(edges)
    n = shared.n

    def f(i):
        g = shared.graph()
        vs = np.arange(i * 256, min(n, i * 256 + 256))
        return {"vertex": vs, "efficiency": [kernel.local_efficiency(g, int(v)) for v in vs]}

    return _run(_rows(edges.sparkSession, -(-n // 256)), f, "vertex long, efficiency double")


def controllability(edges: DataFrame, most: int = 4_000) -> DataFrame:
    """(vertex, average, modal) of the adjacency over 1 + its largest eigenvalue c:
    average sums v_ij^2 / (1 - lambda_j^2), modal is 1 - degree / c^2; dense ids."""
    n, s, t = arrays(edges)
    if n > most:
        raise ValueError(f"{n} vertices; dense spectra take {most}")

    def f(_):
        a = np.zeros((n, n))
        a[s, t] = a[t, s] = 1
        x, v = np.linalg.eigh(a)
        c = 1 + np.abs(x).max(initial=0)
        return {"vertex": np.arange(n), "average": (v**2 / (1 - (x / c) ** 2 + 1e-10)).sum(1), "modal": 1 - a.sum(1) / c**2}

    return _run(_rows(edges.sparkSession, 1, 1), f, "vertex long, average double, modal double")


def fiedler_cut(edges: DataFrame, most: int = 4_000) -> DataFrame:
    """(n, cut, share): edges between the halves of the second Laplacian vector, the
    better of both halvings if n is odd."""
    n, s, t = arrays(edges)
    if n > most:
        raise ValueError(f"{n} vertices; dense spectra take {most}")

    def f(_):
        a = np.zeros((n, n))
        a[s, t] = a[t, s] = 1
        vector = np.linalg.eigh(np.diag(a.sum(1)) - a)[1][:, 1]
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), np.round(vector, 9)))] = np.arange(n)
        cut = min(int(((rank[s] < h) != (rank[t] < h)).sum()) for h in {n // 2, -(-n // 2)})
        return {"n": [n], "cut": [cut], "share": [cut / max(1, len(s))]}

    return _run(_rows(edges.sparkSession, 1, 1), f, "n long, cut long, share double")


def layered_nulls(edges: DataFrame, colours: DataFrame, nulls: int, seed: int = 42) -> DataFrame:
    """(null_id, src, dst) of rewirings that keep every vertex's degree towards every
    colour; ids as given. A seed a task, and above MOST_EDGES over tables."""
    edges, few = ensemble._few(edges)
    if not few:
        return rewiring.tiled(edges, nulls, seed=seed, layer=colours)
    e = edges.join(colours.toDF("src", "cs"), "src").join(colours.toDF("dst", "cd"), "dst").orderBy("src", "dst").toArrow()
    s, t = e.column("src").to_numpy(), e.column("dst").to_numpy()
    ids, dense = np.unique(np.r_[s, t], return_inverse=True)
    a, b = dense[: len(s)], dense[len(s) :]
    colour = np.zeros(len(ids), np.int64)
    colour[a], colour[b] = e.column("cs").to_numpy(), e.column("cd").to_numpy()

    def f(i):
        x, y = kernel.layer_swaps(len(ids), a, b, colour, seed + 1000 * (i + 1))
        return {"null_id": np.full(len(x), i), "src": ids[x], "dst": ids[y]}

    return _run(_rows(edges.sparkSession, nulls, nulls), f, "null_id long, src long, dst long")


def baselines(edges: DataFrame, kinds: tuple = generate.KINDS, seed: int = 42) -> DataFrame:
    """(kind, src, dst): random graphs of the edges' size, degrees or Louvain blocks; dense ids. A kind a
    task, of graphs above MOST_EDGES over tables."""
    edges = _cut(edges.select("src", "dst"))
    if edges.count() > MOST_EDGES:
        return _baselines_of_any(edges, kinds, seed)
    n, s, t = arrays(edges)

    def f(i):
        label = graphs.louvain(n, s, t, 1.0, seed) if kinds[i] == "block_degrees" else np.zeros(n, np.int64)
        a, b = generate.make(kinds[i], n, s, t, label, seed + i)
        return {"kind": [kinds[i]] * len(a), "src": a, "dst": b}

    return _run(_rows(edges.sparkSession, len(kinds), len(kinds)), f, "kind string, src long, dst long")


def _baselines_of_any(edges: DataFrame, kinds: tuple, seed: int) -> DataFrame:
    e = _cut(canonical(relabel(edges)))
    d = _cut(degrees(e))
    n, m, out = d.count(), e.count(), None
    labels = lambda: _cut(ensemble.louvain(e, [1.0], 1, seed).select(F.col("vertex").alias("id"), "label"))
    for i, kind in enumerate(kinds):
        got = _cut(tables.make(kind, e, d, n, m, labels, seed + i).select(F.lit(kind).alias("kind"), "src", "dst"))
        out = got if out is None else out.unionByName(got)
    return out


def manifest(graphs_: DataFrame) -> DataFrame:
    """(kind, n, m, mean_degree, cv) of each baseline."""
    d = graphs_.select("kind", F.explode(F.array("src", "dst")).alias("id")).groupBy("kind", "id").agg(F.count("*").alias("d"))
    g = d.groupBy("kind").agg(F.count("*").alias("n"), (F.sum("d") / 2).cast("long").alias("m"), F.avg("d").alias("mean_degree"), F.stddev_pop("d").alias("sd"))
    return g.select("kind", "n", "m", "mean_degree", (F.col("sd") / F.col("mean_degree")).alias("cv"))


def weighted_rich_club(edges: DataFrame) -> DataFrame:
    """(k, phi): weight among vertices of degree above k over that of as many heaviest
    edges; 0 without edges above k. ``edges`` has a weight. Sums run over histograms of
    degree and of weight."""
    d = degrees(edges)
    e = edges.join(d.toDF("src", "du"), "src").join(d.toDF("dst", "dv"), "dst")
    low = e.groupBy(F.least("du", "dv").alias("degree")).agg(F.count("*").alias("c"), F.sum("weight").alias("w"))
    both = d.groupBy("degree").agg(F.count("*").alias("v")).join(low, "degree", "full")
    grid = d.agg(F.max("degree").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("degree"))
    above = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(o) for c, o in (("v", "n"), ("c", "e"), ("w", "sum"))]
    curve = grid.join(both, "degree", "left").select(F.col("degree").alias("k"), *sums).where("n >= 2")
    # Heaviest first, level by level: the sum of the first e weights lies in one level.
    level = edges.groupBy("weight").agg(F.count("*").alias("c"))
    before = Window.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("c").over(before), F.lit(0))
    held = F.coalesce(F.sum(F.col("c") * F.col("weight")).over(before), F.lit(0))
    level = level.select(first.alias("at"), F.lit(0).alias("asks"), F.struct(first.alias("first"), held.alias("held"), "weight").alias("level"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("sum"))
    asks = curve.select(F.col("e").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(level.schema["level"].dataType).alias("level"), F.col("k").cast("long").alias("k"), F.col("sum").cast("double").alias("sum"))
    seen = F.last("level", ignorenulls=True).over(Window.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    found = level.unionByName(asks).withColumn("level", seen).where("asks = 1")
    best = F.expr("level.held + (at - level.first) * level.weight")
    return found.select("k", F.when(F.col("at") > 0, F.col("sum") / best).otherwise(0.0).alias("phi"))


def nesting(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """One row: the share of vertices that lie in the main coarse label of their fine one."""
    c = fine.toDF("id", "a").join(coarse.toDF("id", "b"), "id").groupBy("a", "b").agg(F.count("*").alias("n"))
    per = c.groupBy("a").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.agg((F.sum("top") / F.sum("n")).alias("nesting"), F.count("*").alias("labels"))


def best_partition(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(vertex, label, modularity) of the run of highest modularity (ties: the earlier);
    ``runs`` is (run, vertex, label) on dense ids."""
    e = relabel(edges)
    x, y = runs.select("run", F.col("vertex").alias("src"), F.col("label").alias("la")), runs.select("run", F.col("vertex").alias("dst"), F.col("label").alias("lb"))
    both = e.join(x, "src").join(y, ["run", "dst"])
    ends = both.select("run", F.explode(F.array(F.struct(F.col("la").alias("label"), (F.col("la") == F.col("lb")).cast("long").alias("i")), F.struct(F.col("lb").alias("label"), F.lit(0).cast("long").alias("i")))).alias("x"))
    g = ends.groupBy("run", "x.label").agg(F.sum("x.i").alias("i"), F.count("*").cast("double").alias("d"))
    q = g.groupBy("run").agg((F.sum("i") / (F.sum("d") / 2) - F.sum(F.col("d") * F.col("d")) / (F.sum("d") * F.sum("d"))).alias("modularity"))
    best = q.agg(F.max_by("run", F.struct(F.round("modularity", 12), -F.col("run"))).alias("run"), F.max("modularity").alias("modularity"))
    return runs.join(F.broadcast(best), "run").select("vertex", "label", "modularity")


def merged_labels(edges: DataFrame, labels: DataFrame, target: int, rule: str = "small", most: int = 100_000) -> DataFrame:
    """(id, label) after labels are joined until ``target`` are left: the smallest into
    its densest partner, or always the densest pair. The label graph is of bounded size."""
    from tallygraph.operators.communities import quotient

    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).limit(most + 1).toArrow()
    if sizes.num_rows > most:
        raise ValueError(f"more than {most} labels")
    w = quotient(edges, labels).limit(MOST_EDGES + 1).toArrow()
    if w.num_rows > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} label pairs")
    size = dict(zip(sizes.column("label").to_pylist(), sizes.column("n").to_pylist()))
    weight = dict(zip(zip(w.column("a").to_pylist(), w.column("b").to_pylist()), w.column("witness").to_pylist()))
    into = (kernel.merge_small if rule == "small" else kernel.merge_dense)(size, weight, target)
    table = edges.sparkSession.createDataFrame(sorted(into.items()), "label long, new long")
    return labels.join(table, "label").select("id", F.col("new").alias("label"))


def intersection_array(distances: DataFrame, edges: DataFrame) -> DataFrame:
    """(d, c, b): at each distance d between two vertices, how many neighbours of one
    are nearer to the other and how many farther; null where that isn't constant."""
    near = both_ways(edges).toDF("id", "other")
    x = distances.select("source", "id", "d").join(near, "id")
    y = distances.select("source", F.col("id").alias("other"), F.col("d").alias("e"))
    c = x.join(y, ["source", "other"]).groupBy("source", "id", "d").agg(F.count_if(F.col("e") == F.col("d") - 1).alias("c"), F.count_if(F.col("e") == F.col("d") + 1).alias("b"))
    one = lambda v: F.when(F.min(v) == F.max(v), F.min(v)).alias(v)
    return c.groupBy(F.col("d").cast("long").alias("d")).agg(one("c"), one("b"))
