"""What the plans hold between stages, and table forms where kernels had a ceiling."""

import itertools
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph import queries, table_queries  # noqa: F401
from tallygraph.kernels import graphs as kernels
from tallygraph.kernels import structure as kernels_of_structure
from tallygraph.operators import baselines, colouring, communities, construct, ensemble, forests, growth, layers, matching, partition, paths, rewiring, sketches, structure, tiles, triangles
from tallygraph.operators.ranges import Ranges
from tallygraph.plans import audit

DATA = "/root/testdata/sf0.001"


def _graph(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src long, dst long")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def shuffled(spark):
    """Runs a frame without broadcast joins and counts the records that its shuffles write."""
    store = spark.sparkContext._jsc.sc().statusStore()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def total():
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        return sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))

    def run(f):
        before = total()
        got = _rows(f())
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return got, total() - before

    yield run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_club_without_null_edges_has_no_ratio(spark):
    nulls = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.25), (0, 2, 0.0), (1, 2, 0.0)], "null_id long, k long, phi double")
    real = spark.createDataFrame([(1, 0.5), (2, 1.0)], "k long, phi double")
    got = {r.k: r for r in rewiring.club_table(nulls, real).collect()}
    assert got[1].ratio == pytest.approx(0.5 / 0.375) and got[2].ratio is None and got[2].p == pytest.approx(1 / 3)


def test_kronecker_products_are_not_shuffled(spark, shuffled):
    e = _graph(spark, itertools.combinations(range(12), 2))
    seed = _graph(spark, [(0, 1), (1, 2), (0, 2), (2, 3)])
    got, n = shuffled(lambda: construct.kronecker(e, seed, 4))
    want = {(u * 4 + x, v * 4 + y) for u, v in itertools.combinations(range(12), 2) for a, b in [(0, 1), (1, 2), (0, 2), (2, 3)] for x, y in ((a, b), (b, a))}
    assert got == sorted(want) and n < len(want) / 2


def test_kronecker_of_loops_repeats_and_wide_seeds(spark):
    e = spark.createDataFrame([(1, 0), (0, 1), (2, 2)], "src long, dst long")
    for pairs, size in (([(0, 1), (1, 2)], 3), ([(0, 5), (1, 2)], 3)):
        every = {tuple(sorted((u * size + x, v * size + y))) for u, v in ((1, 0), (2, 2)) for a, b in pairs for x, y in ((a, b), (b, a)) if u * size + x != v * size + y}
        assert _rows(construct.kronecker(e, spark.createDataFrame(pairs, "src long, dst long"), size)) == sorted(every)


def test_wedges_are_not_shuffled(spark, shuffled):
    pairs = [(a, 40 + b) for a in range(40) for b in range(40)] + [(0, 1), (2, 3)]
    got, n = shuffled(lambda: triangles.triangles(_graph(spark, pairs)))
    assert sorted(tuple(sorted(t)) for t in got) == sorted((a, b, 40 + c) for a, b in ((0, 1), (2, 3)) for c in range(40))
    assert all(b < c for _, b, c in got) and n < 15 * len(pairs)  # 31,200 wedges


@pytest.mark.parametrize("held", [7, 1_000_000])
@pytest.mark.parametrize("forests_", [1, 2])
def test_thinned_edges_keep_every_cut(spark, monkeypatch, forests_, held):
    import numpy as np

    monkeypatch.setattr(paths, "HELD", held)
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(map(int, rng.integers(0, 30, 2)))) for _ in range(160)}
    pairs = sorted((a, b, int(rng.integers(0, 4))) for a, b in pairs)
    # Repeats, a turned edge and loops change nothing.
    e = spark.createDataFrame(pairs + pairs[:20] + [(b, a, c) for a, b, c in pairs[20:30]], "src long, dst long, cost long")
    got = [(r.src, r.dst) for r in paths.thinned(e, forests_).collect()]
    assert len(got) == len(set(got)) and set(got) <= {(a, b) for a, b, _ in pairs if a < b}
    for _ in range(300):
        side = set(np.flatnonzero(rng.random(30) < rng.random()).tolist())
        cut = [(c, a, b) for a, b, c in pairs if (a in side) != (b in side)]
        kept = [(a, b) for a, b in got if (a in side) != (b in side)]
        assert len(kept) >= min(forests_, len(cut)) and (not cut or min(cut)[1:] in kept)


def test_rounds_of_components_and_forests_run_on_few_edges(spark, shuffled):
    pairs = list(itertools.combinations(range(70), 2)) + [(100, 101), (101, 102)]
    e = _graph(spark, pairs)
    got, n = shuffled(lambda: paths.components(e))
    assert got == [(i, 0) for i in range(70)] + [(i, 100) for i in (100, 101, 102)] and n < 2 * len(pairs)
    got, n = shuffled(lambda: forests.spanning_forest(e.withColumn("w", F.col("src") + F.col("dst")), "w", False))
    assert [r[:2] for r in got] == [(0, i) for i in range(1, 70)] + [(100, 101), (101, 102)] and n < 2 * len(pairs)
    got, n = shuffled(lambda: forests.bridges(e))
    assert got == [(100, 101), (101, 102)] and n < 4 * len(pairs)


def test_cliques_grow_without_wedges(spark, shuffled):
    pairs = [(a, 40 + b) for a in range(40) for b in range(40)] + [(0, 1)]
    e = _graph(spark, pairs).withColumn("g", F.lit(7).cast("long"))
    got, n = shuffled(lambda: triangles.clique_census(e, "g"))
    assert got == [(7, 2, 1600 - 80), (7, 3, 40)] and n < 30 * len(pairs)  # 31,200 wedges, and as many looked up
    at = {r.vertex: (r.degree, r.cliques) for r in triangles.participation(e).collect()}
    assert at[0] == (41, 40) and at[5] == (40, 40) and at[45] == (40, 39) and len(at) == 80


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["clique_census", "clique_participation", "fractional_cover"])
def test_no_ceiling_of_edges(spark, monkeypatch, name):
    import __spark_entry__  # noqa: F401  (registers all queries)

    want = _rows(queries.QUERIES[name](spark, DATA))
    monkeypatch.setattr(ensemble, "MOST_EDGES", 100)
    assert _rows(queries.QUERIES[name](spark, DATA)) == want


def test_heavy_hubs_take_their_edges_once(spark, shuffled):
    rows = [(a, b, 1 + (a * b) % 5) for a, b in itertools.combinations(range(60), 2)]
    e = spark.createDataFrame(rows, "src long, dst long, weight long")
    got, n = shuffled(lambda: audit.heavy_hub_share(e.repartition(5, "src", "dst")))
    assert got[0][0] == sum(w == 5 for *_, w in rows) and n < 1.8 * len(rows)


@pytest.fixture
def pieces(spark, monkeypatch):
    """Two components for the kernels and one above their limit, which goes by joins; and the pairs."""
    monkeypatch.setattr(ensemble, "MOST_EDGES", 60)
    monkeypatch.setattr(ensemble, "MOST_PAIRS", 900)
    rng = np.random.default_rng(3)
    pairs = {(i, i + 1) for i in range(100, 139)} | {(min(a, b), max(a, b)) for a, b in rng.integers(100, 140, (60, 2)).tolist() if a != b}
    return sorted(pairs | {(i, i + 1) for i in range(9)} | {(i, j) for j in range(20, 29) for i in range(20, j)})


def _dense(pairs):
    ids = np.unique(np.array(pairs))
    at = np.searchsorted(ids, np.array(pairs))
    return ids, kernels.Csr(len(ids), at[:, 0], at[:, 1])


def test_distances_without_a_ceiling(spark, pieces):
    ids, g = _dense(pieces)
    want = dict(enumerate(kernels.reach_counts(g, np.arange(g.n)).tolist()))
    got = {r.d: r.pairs for r in ensemble.distance_histogram(_graph(spark, pieces)).collect()}
    assert got == {d: n for d, n in want.items() if d}
    some = ensemble._sources(g.n, 7, 42)
    want = dict(enumerate(kernels.reach_counts(g, some).tolist()))
    assert {r.d: r.pairs for r in ensemble.distance_histogram(_graph(spark, pieces), 7).collect()} == {d: n for d, n in want.items() if d}


def test_betweenness_without_a_ceiling(spark, pieces):
    ids, g = _dense(pieces)
    want = kernels.brandes(g, np.arange(g.n)) / ((g.n - 1) * (g.n - 2))
    got = {r.vertex: r.betweenness for r in ensemble.betweenness(_graph(spark, pieces)).collect()}
    assert [got[i] for i in range(g.n)] == pytest.approx(want.tolist())


def test_boxes_without_a_ceiling(spark, pieces):
    _, g = _dense(pieces)
    got = {r.radius: r.boxes for r in ensemble.box_counts(_graph(spark, pieces), [1, 2]).collect()}
    assert got == {r: kernels.boxes(g, r) for r in (1, 2)}


def test_best_partition_without_a_ceiling(spark, pieces):
    e = _graph(spark, pieces)
    ids, g = _dense(pieces)
    at = np.searchsorted(ids, np.array(pieces))
    got = structure.best_partition(e, ensemble.louvain(e, [1.0], 2).drop("gamma")).collect()
    label = dict((r.vertex, r.label) for r in got)
    assert sorted(label) == list(range(g.n))

    def modularity(x):
        inside, ends = np.mean([x[a] == x[b] for a, b in at]), {}
        for v in at.ravel():
            ends[x[v]] = ends.get(x[v], 0) + 1
        return inside - sum((d / at.size) ** 2 for d in ends.values())

    best = max(modularity(kernels.louvain(g.n, at[:, 0], at[:, 1], 1.0, 42 + r)) for r in range(2))
    assert got[0].modularity == pytest.approx(modularity(label)) and got[0].modularity >= 0.95 * best


def test_closure_without_a_ceiling(spark, pieces):
    e = _graph(spark, pieces)
    colours = spark.createDataFrame([(int(i), int(i) % 3) for i in np.unique(np.array(pieces))], "id long, colour long")
    after, record = growth.random_closure(e, colours, 20)
    new = {tuple(r) for r in after.collect()} - set(pieces)
    assert record.columns == ["round", "drawn", "legal", "stopped", "taken"] and len(new) == 20 == record.agg(F.sum("taken")).first()[0]
    near = {}
    for a, b in pieces:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert all((a - b) % 3 and near[a] & near[b] for a, b in new)


def test_fans_hold_no_relation_in_a_group(spark):
    e = _graph(spark, [(a, 100 + b) for a in range(30) for b in range(a % 5 + 1)])
    labels = spark.createDataFrame([(i, i % 2 if i < 100 else 2) for i in [*range(30), *range(100, 105)]], "id long, label long")
    df = communities.bundle_fans(e, labels)
    assert _rows(df) == [(0, 2, 45, 15, 5), (1, 2, 45, 15, 5)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan.lower()


def test_prints_in_blocks(spark):
    rng = np.random.default_rng(5)
    p, x = rng.integers(0, 4, (40, 3)).astype(float), rng.integers(0, 4, (90, 3)).astype(float)
    prints = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "print_id long, vec array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>").repartition(3)
    d = np.sqrt(((p[:, None] - x[None]) ** 2).sum(2))
    assert _rows(layers.fingerprint_match(prints, rows, 7)) == [(i, int(d[i].argmin()), d[i].min()) for i in range(40)]


def test_sums_over_tiles_leave_the_edges(spark, shuffled, monkeypatch):
    monkeypatch.setattr(tiles, "ENDS", 2_000)
    rng = np.random.default_rng(1)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 100, (9_000, 2)).tolist() if a != b})
    ends = np.array(pairs + [(b, a) for a, b in pairs])
    t = tiles.Tiles(spark.createDataFrame(ends.tolist(), "id long, other long"), len(ends))
    t.near.count()
    values = spark.range(99).select("id", (F.col("id") / 7).alias("x"), F.xxhash64("id").alias("h")).localCheckpoint()  # one has none
    got, n = shuffled(lambda: t.sums(values))
    x, h = np.append(np.arange(99) / 7, 0), {r.id: r.h for r in values.collect()}
    assert [r[1] for r in got] == pytest.approx([x[ends[ends[:, 0] == i, 1]].sum() for i in range(100)])
    assert [int(r[2]) for r in got] == [sum(h.get(o, 0) for o in ends[ends[:, 0] == i, 1].tolist()) % 2**64 for i in range(100)]
    assert n <= 2 * t.side * 100 < len(ends) / 5
    t.close()


def test_sketches_are_not_sent_along_edges(spark, shuffled):
    pairs = [(a, 60 + b) for a in range(60) for b in range(60)]
    got, n = shuffled(lambda: sketches.neighbourhood(_graph(spark, pairs)))
    assert got == [(1, 2 * len(pairs)), (2, 120 * 119 - 2 * len(pairs))]  # degrees and whole components need no estimate
    assert n < 4 * len(pairs)  # both ends once, not once a round


def test_boxes_are_checked_inside_ranges(spark, shuffled):
    pairs = [(a, 60 + b) for a in range(60) for b in range(60)] + [(1, 200)]
    e = _graph(spark, pairs)
    got, n = shuffled(lambda: sketches.box_cover(e, 2))
    assert len(got) == 121 and n < 6 * len(pairs)
    boxes = spark.createDataFrame([(i, 0, 0) for i in range(120)] + [(200, 200, 0)], "id long, centre long, distance int")
    assert sketches.check_cover(e, boxes, 2) == (0, 0)
    boxes = spark.createDataFrame([(i, 0, 0) for i in range(119)] + [(119, 119, 0), (200, 0, 0)], "id long, centre long, distance int")
    assert sketches.check_cover(e, boxes, 2) == (1, 2)


def test_colours_are_checked_in_words(spark, shuffled):
    pairs = list(itertools.combinations(range(70), 2))
    e, c = _graph(spark, pairs), spark.createDataFrame([(i, i) for i in range(70)], "id long, colour int")
    got, n = shuffled(lambda: colouring.check(e, c))
    assert got == [(i, i, 0, i) for i in range(70)] and n < 2.5 * len(pairs)
    c = spark.createDataFrame([(i, max(i, 1) + (i == 69)) for i in range(70)], "id long, colour int")
    got = {r.id: (r.clashes, r.lesser) for r in colouring.check(e, c).collect()}
    assert got[0] == got[1] == (1, 0) and got[2] == (0, 1) and got[69] == (0, 68)


def test_partitions_send_no_table_through_the_driver(spark):
    """And both ends of the edges are not shuffled once a round."""
    pairs = [(20 * r + i, 20 * r + j) for r in range(6) for i in range(20) for j in range(i)] + [(20 * r, 20 * ((r + 1) % 6)) for r in range(6)]
    blocks = spark.createDataFrame([(i, i // 60) for i in range(130)], "id long, block long")
    store = spark._jsparkSession.sharedState().statusStore()

    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return {x.executionId(): x.physicalPlanDescription() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList())}

    before = plans()
    got = {r.id: r.label for r in partition.leiden(_graph(spark, pairs), 0.3, "potts", blocks).collect()}
    new = [p for k, p in plans().items() if k not in before]
    assert got == {i: i // 20 * 20 for i in range(120)}
    assert new and not any("Broadcast" in p for p in new)


def test_partition_rounds_shuffle_vertices(spark, shuffled):
    pairs = list(itertools.combinations(range(120), 2))
    nodes, near = partition.start(_graph(spark, pairs), 0.3, "potts")
    near.near.count()
    labelled = nodes.withColumn("label", F.col("id") % 2).localCheckpoint()
    got, n = shuffled(lambda: partition._step(near, labelled, 0, 2).select("id", "part"))
    assert len(got) == 120 and n < len(pairs) / 10
    got, n = shuffled(lambda: partition.refine(near, labelled, 1))
    assert len(got) == 120 and n < len(pairs) / 2
    near.close()


def test_matchings_shuffle_edges_once(spark, shuffled):
    pairs = list(itertools.product(range(60), range(100, 170)))  # ten stay without a mate
    e = _graph(spark, pairs)
    got, n = shuffled(lambda: matching.double_cover(e)[0])
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == 120 and set(map(tuple, map(sorted, got))) <= set(pairs)
    assert n < 6 * len(pairs)  # both ends once, and vertices; no layer sends edges
    near = Ranges(e)
    x, y = matching.fractional(e, near)
    assert matching.check(near, x, y) == (0, 0)
    x = spark.createDataFrame([(0, 100, 1.0), (0, 1, 0.5), (1, 500, 0.5)], "src long, dst long, x double")
    y = spark.createDataFrame([(i, 1.0 if i else 0.5) for i in range(60)] + [(100 + i, 0.0) for i in range(70)], "id long, y double")
    assert matching.check(near, x, y) == (2, 70)
    near.close()


def test_greedy_colours_without_a_ceiling(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pairs = [(100 * part + a, 100 * part + b) for part in range(3) for a, b in rng.integers(0, 30, (120, 2)).tolist() if a != b]
    e = _graph(spark, pairs).distinct()
    whole = _rows(structure.colouring(e))
    monkeypatch.setattr(ensemble, "MOST_EDGES", 130)
    assert _rows(structure.colouring(e)) == whole
    monkeypatch.setattr(ensemble, "MOST_EDGES", 50)  # components too are larger
    got = dict(_rows(structure.colouring(e)))
    ids = {v: i for i, v in enumerate(sorted({x for p in pairs for x in p}))}
    assert sorted(got) == sorted(ids.values()) and all(got[ids[a]] != got[ids[b]] for a, b in pairs)


def test_saturation_is_not_quadratic():
    n = 20_000
    ring = np.array([(min(i, (i + 1) % n), max(i, (i + 1) % n)) for i in range(n)])
    start = time.process_time()
    assert set(kernels_of_structure.dsatur(kernels.Csr(n, *ring.T))) == {0, 1}
    assert time.process_time() - start < 5


def test_tiles_are_rewired_whole(spark, monkeypatch):
    monkeypatch.setattr(rewiring, "TILE", 300)
    rng = np.random.default_rng(4)
    pairs = {(min(p), max(p)) for p in map(tuple, rng.integers(0, 90, (1_500, 2)).tolist()) if p[0] != p[1]}
    e, layer = _graph(spark, pairs), spark.range(90).select("id", (F.col("id") % 2).alias("layer"))
    for by in (None, layer):
        nulls = rewiring.tiled(e, 2, layer=by).localCheckpoint()
        for r in rewiring.check(e, nulls, by).collect():
            assert (r.edges, r.loops, r.repeated, r.off_degree) == (len(pairs), 0, 0, 0) and r.kept < 0.6 * len(pairs)
        assert _rows(rewiring.tiled(e, 2, layer=by)) == _rows(nulls) and len(set(_rows(nulls.select("src", "dst")))) > 1.3 * len(pairs)


def test_layered_nulls_without_a_ceiling(spark, monkeypatch):
    monkeypatch.setattr(ensemble, "MOST_EDGES", 100)
    rng = np.random.default_rng(3)
    e = _graph(spark, {(min(p), max(p)) for p in map(tuple, rng.integers(0, 60, (400, 2)).tolist()) if p[0] % 3 != p[1] % 3})
    c = spark.range(60).select("id", (F.col("id") % 3).alias("colour"))
    got = rewiring.check(e, structure.layered_nulls(e, c, 2), c).collect()
    assert [(r.edges, r.loops, r.repeated, r.off_degree) for r in got] == [(e.count(), 0, 0, 0)] * 2


def test_null_rich_clubs_without_a_ceiling(spark, monkeypatch):
    rng = np.random.default_rng(6)
    e = _graph(spark, {(min(p), max(p)) for p in map(tuple, (60 * rng.random((500, 2)) ** 2).astype(int).tolist()) if p[0] != p[1]})
    means = lambda df: {r.k: (r.n, r.phi) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.avg("phi").alias("phi")).collect()}
    few = means(ensemble.null_rich_clubs(e, 5))
    monkeypatch.setattr(ensemble, "MOST_EDGES", 100)
    any_ = means(ensemble.null_rich_clubs(e, 5))
    assert any_.keys() == few.keys() and all(any_[k][0] == 5 for k in any_)
    assert any_[0] == pytest.approx(few[0]) and all(any_[k][1] == pytest.approx(few[k][1], abs=0.25) for k in few)
    assert sum(abs(any_[k][1] - few[k][1]) for k in few) / len(few) < 0.06


def test_local_efficiency_without_a_ceiling(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pairs = {(min(p), max(p)) for p in map(tuple, rng.integers(0, 60, (400, 2)).tolist()) if p[0] != p[1]}
    pairs |= {(200, v) for v in range(201, 351)} | {(v, v + 1) for v in range(201, 350)} | {(400, 401)}  # paths of more than 64 steps
    e = _graph(spark, pairs)
    want = {r.vertex: r.efficiency for r in structure.local_efficiency(e).collect()}
    monkeypatch.setattr(ensemble, "MOST_EDGES", 100)
    monkeypatch.setattr(structure, "TRIANGLES", 500)
    assert {r.vertex: r.efficiency for r in structure.local_efficiency(e).collect()} == pytest.approx(want)


def test_enriched_cliques_shuffle_nulls_a_few_times(spark, shuffled):
    m = queries.trade.edges(spark, DATA).count()
    got, n = shuffled(lambda: queries.QUERIES["clique_enrichment"](spark, DATA))
    assert got and n < 120 * m, n / m


def test_degree_baseline_shuffles_edges_a_few_times(spark, shuffled):
    rng = np.random.default_rng(9)
    pairs = {(min(p), max(p)) for p in map(tuple, rng.integers(0, 200, (2_000, 2)).tolist()) if p[0] != p[1]}
    e = _graph(spark, pairs)
    got, n = shuffled(lambda: baselines.make("degrees", e, None, 200, len(pairs), None, 3))
    assert len(got) == len(set(got)) == len(pairs) and n < 8 * len(pairs)
