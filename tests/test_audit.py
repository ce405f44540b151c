"""Audits, covers, spectra, comparisons, displays, sweeps and sinks on small graphs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.kernels import graphs, measures, seeds
from tallygraph.kernels import structure as kernel
from tallygraph.operators import construct, cover, display, ensemble, growth, layers, paths, richclub, spectra, structure, sweeps
from tallygraph.plans import audit, compare
from tallygraph.sources import files, reports

PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]


def csr(pairs, n=None):
    e = np.array(sorted((min(a, b), max(a, b)) for a, b in pairs), np.int64)
    return graphs.Csr(n or int(e.max()) + 1, e[:, 0], e[:, 1])


def table(spark, pairs):
    return spark.createDataFrame(sorted({(min(a, b), max(a, b)) for a, b in pairs}), "src long, dst long")


def drawn(n, m, seed=0):
    rng, out = np.random.default_rng(seed), set()
    while len(out) < m:
        a, b = rng.integers(0, n, 2).tolist()
        if a != b:
            out.add((min(a, b), max(a, b)))
    return sorted(out)


def test_waves_walk_as_single_searches():
    g = csr(drawn(150, 260, 3), 150)  # with isolates and several components
    want = np.zeros(200, np.int64)
    for v in range(150):
        c = np.bincount(graphs.bfs(g, v)[graphs.bfs(g, v) > 0])
        want[: len(c)] += c
    got = graphs.reach_counts(g, np.arange(150))
    assert got.tolist() == want[: len(got)].tolist() and not want[len(got) :].any()
    d = np.stack([graphs.bfs(g, v) for v in range(150)])
    assert (graphs.balls(g, 2) == ((d >= 0) & (d <= 2))).all()


@pytest.mark.parametrize("reach", [0, 1, 2, 3])
def test_covers_hold_their_radius(reach):
    g = csr(drawn(80, 120, 5), 80)
    d = np.stack([graphs.bfs(g, v) for v in range(80)])
    box = kernel.random_cover(g, reach, 1)
    assert (box >= 0).all() and kernel.random_boxes(g, reach + 1, 1) == box.max() + 1
    centres, mine = kernel.mass_cover(g, reach, 2)
    assert set(mine.tolist()) == set(centres) and graphs.boxes(g, reach) == len(centres)
    near = d[:, centres].copy()
    near[near < 0] = 10**6
    assert (near.min(1) <= reach).all() and all(mine[c] == c for c in centres)


def test_dimension_of_a_path_is_one(spark):
    e = table(spark, [(i, i + 1) for i in range(119)])
    row = cover.ball_dimension(e, trials=3)
    r = row.first()
    assert r.verdict == "power law" and 0.8 < r.dimension < 1.2
    assert cover.ball_dimension(table(spark, PETERSEN)).first().verdict == "too few points"


def test_spectra_of_known_graphs(spark):
    e = table(spark, PETERSEN)
    x = [round(r.value, 9) for r in spectra.eigenvalues(e).orderBy("rank").collect()]
    assert x == [3.0] + [1.0] * 5 + [-2.0] * 4
    assert [round(r.value, 9) for r in spectra.scree(e).orderBy("rank").collect()] == [3.0] + [2.0] * 4 + [1.0] * 5
    assert all(abs(r.value - 1 / math.sqrt(10)) < 1e-9 for r in spectra.network_value(e).collect())
    rows = spectra.embedding(table(spark, [(i, i + 1) for i in range(9)])).orderBy("vertex").collect()
    u = np.array([(r.u2, r.u3) for r in rows])
    assert np.allclose(u.T @ u, np.eye(2)) and (np.diff(np.sign(u[:, 0])) != 0).sum() == 1
    c = spectra.control_summary(e).first()
    assert (c.n, c.average_std, c.modal_std, c.modal_degree) == (10, 0.0, 0.0, None)  # every degree is three


def test_effective_dimension(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = spark.createDataFrame([(float(x), float(2 * x), float(y), None if i == 0 else 1.0) for i, (x, y) in enumerate(zip(a, b))], "a double, b double, c double, d double")
    got = spectra.effective_dimension(rows, ["a", "b", "c"]).orderBy("component").collect()
    assert got[0].needed == 2 and got[-1].total == pytest.approx(1) and got[0].variance == pytest.approx(2 / 3, abs=0.1)


def test_paired(spark):
    rows = [("x", 1, 5, 10.0), ("y", 1, 5, 8.0), ("x", 2, 6, 3.0), ("y", 2, 6, 4.0), ("x", 3, 7, 9.0), ("y", 3, 8, 1.0), ("x", 4, 1, 1.0)]
    r = compare.paired(spark.createDataFrame(rows, "arm string, seed long, m long, v double"), "x", "y", "m", "v").first()
    assert (r.pairs, r.unmatched, r.mean_a, r.mean_b, r.change) == (2, 1, 6.5, 6.0, 0.5)
    assert r.sd == pytest.approx(np.std([2, -1], ddof=1)) and r.per_cent == 0.0


def test_clubs(spark):
    t = spark.createDataFrame([(0, 40, 1.0, 0.2, 1.1), (1, 12, 1.0, 0.2, 1.2), (2, 8, 1.0, 0.2, 1.3), (3, 2, 2.0, 0.5, 1.5), (4, 2, 2.0, 0.5, 1.5)], "k long, n_above long, mean double, std double, rho double")
    assert [(r["size"], r.k) for r in compare.clubs_at(t, [10, 100, 2]).orderBy("size").collect()] == [(2, 3), (10, 1), (100, 0)]
    p = compare.pair_clubs(t, 25).first()
    assert (p["first"], p["last"]) == (3, 4) and p.error == pytest.approx(1.5 * 0.5 / 5 / 2)
    assert compare.compare_clubs(t, t, [10]).first().change == 0


def test_hierarchy_of_two_cliques(spark):
    two = [(a, b) for k in (0, 8) for a in range(k, k + 8) for b in range(a + 1, k + 8)] + [(0, 8)]
    rows = compare.hierarchy(table(spark, two), gammas=(0.5, 1.0), repeats=3).orderBy("gamma").collect()
    assert rows[1].labels == 2 and rows[1].modularity > 0.45 and rows[0].nesting == pytest.approx(1.0)
    runs = spark.createDataFrame([(0.5, 0, v, 0) for v in range(4)] + [(1.0, 0, v, v // 2) for v in range(3)] + [(1.0, 0, 3, 1)], "gamma double, run long, vertex long, label long")
    assert compare.nestings(runs).first().nesting == 1.0


def test_potts_splits_cliques():
    e = np.array([(a, b) for k in (0, 6) for a in range(k, k + 6) for b in range(a + 1, k + 6)] + [(0, 6)], np.int64)
    label = graphs.louvain(12, e[:, 0], e[:, 1], 0.5, 1, potts=True)
    assert len(set(label[:6])) == len(set(label[6:])) == 1 and label[0] != label[6]


def test_weighted_curve_agrees_with_the_table(spark):
    e = drawn(30, 90, 8)
    w = [float(1 + (i * 7) % 5) for i in range(len(e))]
    rows = spark.createDataFrame([(a, b, x) for (a, b), x in zip(e, w)], "src long, dst long, weight double")
    s, t = np.array(e).T
    want = graphs.weighted_rich_club(30, s, t, np.array(w))
    got = {r.k: r.phi for r in structure.weighted_rich_club(rows).collect()}
    assert got == pytest.approx(dict(enumerate(want)))
    nulls = ensemble.weighted_nulls(rows, 2).groupBy("null_id").agg(F.max("phi").alias("m")).collect()
    assert len(nulls) == 2 and all(0 < r.m <= 1 + 1e-9 for r in nulls)


def test_edge_orbits(spark):
    assert structure.edge_symmetry(table(spark, PETERSEN)).select("orbit").distinct().count() == 1
    rows = structure.edge_symmetry(table(spark, [(0, 1), (1, 2), (2, 3)])).orderBy("src").collect()
    assert [r.orbit for r in rows] == [0, 1, 0]


def test_checked_seed(spark):
    colours = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "id long, colour long")
    assert construct.checked(table(spark, [(0, 1), (1, 2)]), colours).count() == 2
    for bad in ([(0, 2)], [(0, 3)]):
        with pytest.raises(Exception, match="not legal"):
            construct.checked(table(spark, bad), colours).collect()


def test_class_places_over_ranges(spark):
    v = spark.createDataFrame([(i * 50_000, i % 2) for i in range(20)], "id long, colour long")
    got = {(r.colour, r.place): r.id for r in construct.class_ids(v).collect()}
    assert got == {(c, k): (2 * k + c) * 50_000 for c in range(2) for k in range(10)}


SEED = ([(0, 2), (0, 4), (1, 3), (1, 5), (2, 4), (3, 5), (2, 5), (3, 6), (4, 6)], [0, 0, 1, 1, 2, 2, 0], [0] * 7)


def test_product_law_and_arms():
    edges, colour, block = SEED
    n, s, t, c, trace = sweeps.grow(7, edges, colour, block, [0.0, 0.0, 0.0])
    want = seeds.invariants(7, edges, 3)
    assert (n, len(s)) == (343, want["product_m"]) and 2 * len(s) / n == pytest.approx(want["product_degree"])
    a = adjacency(7, edges)
    assert np.linalg.eigvalsh(np.kron(np.kron(a, a), a))[-1] == pytest.approx(want["product_top"])
    for arm in sweeps.ARMS:
        n, s, t, c, trace = sweeps.grow(7, edges, colour, block, [0.0, 2.0], arm, accept=0.5)
        assert trace[-1]["closure"] > 0 and len(set(zip(s.tolist(), t.tolist()))) == len(s) and (s < t).all()
        made = trace[-1]["product"]
        assert arm != "colours" or (c[s[made:]] != c[t[made:]]).all()


def adjacency(n, edges):
    a = np.zeros((n, n))
    s, t = np.array(edges).T
    a[s, t] = a[t, s] = 1
    return a


def test_tuning_schedules_and_amplification():
    edges, colour, block = SEED
    goal = len(sweeps.grow(7, edges, colour, block, [0.0, 0.0, 1.5])[1])
    alpha, m = sweeps.tuned(7, edges, colour, block, [0.0, 0.0, 0.0], goal, high=8.0, near=5)
    assert abs(m - goal) <= 5 and alpha > 0
    for name in sweeps.SCHEDULES:
        assert sum(sweeps.deal(6.0, 3, name)) == pytest.approx(6.0)
    assert sweeps.deal(6.0, 3, "front") == sweeps.deal(6.0, 3, "back")[::-1]
    rows = sweeps.schedules(7, edges, colour, block, {"none": [0.0] * 3, "late": [0.0, 0.0, 2.0]}, degree=2 * goal / 343)
    assert rows[0]["closure"] == 0 and rows[1]["closure"] > 0
    amp = sweeps.amplification(7, edges, colour, block, 3)
    assert amp[0]["factor"] > amp[2]["factor"]


@pytest.mark.parametrize("family", seeds.FAMILIES)
def test_seed_families(family):
    made = [x for s in range(6) for b in (True, False) if (x := seeds.make(family, 9, 3, s, b))]
    assert made
    for edges, colour, k, block in made:
        g = csr(edges, 9)
        assert k == kernel.chromatic(g) == 3 and kernel.odd_cycle(g) and (graphs.bfs(g, 0) >= 0).all() and all(colour[a] != colour[b] for a, b in edges)


def test_sweep_goes_on_from_its_log(spark, tmp_path):
    from tallygraph.sources.formats import append_lines

    grid = spark.createDataFrame([("sparse", 8, 3, s, True, 1, "colours", "last", 1.0, 2) for s in range(3)] + [("sparse", 2, 3, 0, True, 1, "free", "even", 1.0, 1)], "family string, size long, colours long, seed long, balanced boolean, blocks long, arm string, schedule string, alpha double, steps long")
    out = sweeps.sweep(spark, grid)
    rows = out.collect()
    assert len({r.key for r in rows}) == 4 and {r.status for r in rows} <= {"ok", "none"} and any(r.status == "none" for r in rows)
    ok = next(r for r in rows if r.status == "ok")
    assert json.loads(ok.trace)[-1]["total"] == ok.m and ok.m >= ok.product_m
    path = str(tmp_path / "log")
    assert append_lines(out, path, "key").count() == 4 and append_lines(out, path, "key").count() == 4


def test_prune_and_repairs(spark):
    e = drawn(40, 200, 4)
    colours = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, colour long")
    edges = table(spark, [x for x in e if x[0] % 3 != x[1] % 3])
    got = sweeps.prune_step(edges, colours, 40).collect()
    d = np.bincount(np.array(got).ravel(), minlength=40)
    assert paths.components(spark.createDataFrame(got)).select("component").distinct().count() == 1 and (d[d > 0] >= 1).all()
    fixed = sweeps.random_repair(table(spark, [(0, 1), (1, 2)]), colours, 3).collect()
    deg = np.bincount(np.array(fixed).ravel(), minlength=40)
    assert (deg >= 3).all() and all(a % 3 != b % 3 for a, b in fixed) and {(0, 1), (1, 2)} <= {(a, b) for a, b in fixed}


def rings(k=4, size=6):
    """Cliques in a ring, weights heavier inside."""
    e = [(c * size + a, c * size + b, 9) for c in range(k) for a in range(size) for b in range(a + 1, size)]
    return e + [(c * size, ((c + 1) % k) * size + 1, 2 + c) for c in range(k)] + [(c * size + 2, ((c + 2) % k) * size + 3, 1) for c in range(k // 2)]


def weighted(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "src long, dst long, weight long")


def test_display_labels_nest_and_show(spark):
    w = weighted(spark, rings())
    lab = paths._cut(display.nested_labels(w))
    rows = lab.collect()
    assert len(rows) == 24 and len({(r.outer, r.middle, r.inner) for r in rows}) >= len({r.outer for r in rows}) >= 2
    t = display.tiers(w, lab).collect()
    by = {r.id: r for r in rows}
    assert all((r.tier == 4) == (by[r.src].outer != by[r.dst].outer) for r in t)
    got = display.shown(w, lab, 62)
    assert {(r.src, r.dst) for r in t if r.tier < 4} <= {tuple(r) for r in got.collect()}
    assert paths.components(got).select("component").distinct().count() == 1
    places = display.order(w, lab).orderBy("place").collect()
    assert [p.place for p in places] == list(range(24)) and [by[p.id].outer for p in places] == sorted(by[p.id].outer for p in places)


def test_swap(spark):
    labels = spark.createDataFrame([(i, 0, i // 6, 0) for i in range(24)], "id long, outer long, middle long, inner long")
    w = weighted(spark, [x for x in rings() if x[:2] not in ((0, 5), (6, 11))])
    after, gone, new = display.swapped(w, w, labels, 2)
    assert {tuple(r) for r in new.collect()} == {(0, 5), (6, 11)} and all(r.weight == 1 for r in gone.collect())
    assert after.count() == w.count() and paths.components(after).select("component").distinct().count() == 1
    parent = table(spark, [(a * 2 + i, b * 2 + 1 - i) for a, b, _ in rings() for i in (0, 1) if (a, b) not in ((0, 5), (6, 11))])
    vertices = spark.createDataFrame([(v, v // 2, v % 2) for v in range(48)], "id long, label long, colour long")
    lifted, quotient = display.swap_and_lift(parent, vertices, w.select("src", "dst"), w, labels, 2)
    pairs = {(min(a // 2, b // 2), max(a // 2, b // 2)) for a, b in lifted.collect()}
    assert {(0, 5), (6, 11)} <= pairs and pairs == {tuple(sorted(r)) for r in quotient.collect()}


def test_match_bundles(spark):
    rng = np.random.default_rng(2)
    vertices = [(v, v // 10, v % 2) for v in range(40)]
    parent = sorted({(a, b) for a, b in rng.integers(0, 40, (300, 2)).tolist() if a < b and a % 2 != b % 2})
    label = lambda v: v // 10
    visible = [(0, 1), (0, 2), (1, 2), (2, 3)]
    v = spark.createDataFrame(vertices, "id long, label long, colour long")
    sample = spark.createDataFrame([(1.2,), (3.0,), (20.0,), (40.0,)], "value double")
    got = display.match_bundles(table(spark, parent), v, spark.createDataFrame(visible, "a long, b long"), sample).collect()
    count = {}
    for a, b in got:
        assert a % 2 != b % 2 or label(a) == label(b)
        k = tuple(sorted((label(a), label(b))))
        count[k] = count.get(k, 0) + 1
    assert sorted(count[k] for k in visible) == [1, 3, 20, 40] and not {k for k in count if k[0] != k[1]} - set(visible)
    assert sum(label(a) == label(b) for a, b in parent) == sum(n for k, n in count.items() if k[0] == k[1])


def brute_ssim(a, b, size=7):
    out = []
    for i in range(a.shape[0] - size + 1):
        for j in range(a.shape[1] - size + 1):
            x, y = a[i : i + size, j : j + size].ravel(), b[i : i + size, j : j + size].ravel()
            c = np.cov(x, y)
            out.append((2 * x.mean() * y.mean() + 1e-4) * (2 * c[0, 1] + 9e-4) / ((x.mean() ** 2 + y.mean() ** 2 + 1e-4) * (c[0, 0] + c[1, 1] + 9e-4)))
    return np.mean(out)


def test_structural_similarity(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 12)), rng.random((12, 12))
    rows = [(0, a.ravel().tolist(), a.ravel().tolist()), (1, a.ravel().tolist(), b.ravel().tolist()), (2, None, b.ravel().tolist()), (3, [0.5], [0.5])]
    got = {r.id: r.ssim for r in layers.structural_similarity(spark.createDataFrame(rows, "id long, a array<double>, b array<double>"), 12).collect()}
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(brute_ssim(a, b)) and got[2] is None and got[3] is None


def test_audit_of_a_small_world(spark):
    n = 60
    e = {(min(a, b), max(a, b)) for i in range(n) for a, b in ((i, (i + 1) % n), (i, (i + 2) % n), (i, (i + 3) % n))}
    e |= {(min(a, b), max(a, b)) for a, b in drawn(n, 20, 1)}
    got = {r.rule: (r.scored, r.verdict) for r in audit.audit(table(spark, e), nulls=24, club_nulls=20, runs=3, gammas=(0.5, 1.0, 2.0)).collect()}
    assert set(got) == set(audit.SCORED) | set(audit.DESCRIPTIVE) and all(v in ("pass", "fail", "not_tested") for _, v in got.values())
    assert got["clustering_enriched"] == (True, "pass") and got["small_world"][1] == "pass" and got["local_efficiency_enriched"][1] == "pass" and not got["box_scaling"][0]
    core = measures.core(10, *np.array(sorted((min(a, b), max(a, b)) for a, b in PETERSEN)).T, 1)
    assert core["clustering"] == 0 and core["path"] == pytest.approx(5 / 3) and core["efficiency"] == pytest.approx((3 + 6 / 2) / 9)


def test_null_kind_and_layered_nulls(spark):
    e = [(a, b) for a in range(4) for b in range(4, 8) if (a + b) % 3] + [(4, 9), (5, 8), (6, 9), (0, 8), (1, 9)]
    colours = spark.createDataFrame([(i, 0 if i < 4 else 1 if i < 8 else 2) for i in range(10)], "id long, colour long")
    assert audit.null_kind(table(spark, e), colours).first().kind == "layered"
    assert audit.null_kind(table(spark, [*e, (0, 1)]), colours).first().kind == "plain"
    ens = audit.ensembles(table(spark, e), colours, 2, 1)
    assert ens.groupBy("kind").count().count() == 3


def test_six_tests(spark):
    e = table(spark, drawn(40, 120, 2))
    assert audit.six_tests(e, e).first().score == 0
    assert audit.six_tests(e, table(spark, [(i, i + 1) for i in range(39)])).first().score > 0.3


def test_bimodality(spark):
    h = lambda d: spark.createDataFrame(list(d.items()), "x long, y long")
    r = audit.bimodality(h({2: 5, 3: 9, 5: 1, 7: 6}), "x", "y").first()
    assert (r.fullest, r["first"], r["second"], r.ratio, r.bimodal) == (3, 3, 7, 0.0, True)
    r = audit.bimodality(h({1: 9, 2: 8, 3: 9}), "x", "y").first()
    assert (r["first"], r["second"], r.bimodal) == (1, 3, False) and r.ratio == pytest.approx(8 / 9)
    r = audit.bimodality(h({1: 1, 2: 2}), "x", "y").first()
    assert r.ratio is None and not r.bimodal


def test_sampled_sources_are_scaled(spark):
    e = table(spark, drawn(30, 80, 6))
    exact = {r.vertex: r.betweenness for r in ensemble.betweenness(e).collect()}
    assert {r.vertex: r.betweenness for r in ensemble.betweenness(e, 30).collect()} == pytest.approx(exact)
    some = {r.vertex: r.betweenness for r in ensemble.betweenness(e, 15).collect()}
    assert sum(some.values()) == pytest.approx(sum(exact.values()), rel=0.3)
    assert ensemble.distance_histogram(e, 5).agg(F.sum("pairs")).first()[0] <= 5 * 29


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "local-cluster[2,1,1024]"}.get(key, default)

    class Fake:
        class sparkContext:
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError):
        paths.scratch(Fake)


def test_reports(spark, tmp_path):
    one = spark.createDataFrame([(1, float("nan"), "x", [1.0, float("inf")])], "a long, b double, c string, d array<double>")
    many = spark.createDataFrame([("r", 1.5), ("longer", None)], "rule string, value double")
    path = f"file://{tmp_path}/out.json"
    reports.json_report({"one": one, "many": many}, path)
    got = json.loads((tmp_path / "out.json").read_text())
    assert got == {"one": {"a": 1, "b": None, "c": "x", "d": [1.0, None]}, "many": [{"rule": "r", "value": 1.5}, {"rule": "longer", "value": None}]}
    assert reports.text_table(many, "T", 2).splitlines() == ["T", "=", "rule    value", "------  -----", "r        1.50", "longer      -"]


def test_masks_round_trip(spark, tmp_path):
    vertices = spark.createDataFrame([(i * 10, i % 3) for i in range(10)], "id long, colour long")
    e = table(spark, [(0, 10), (0, 20), (10, 50), (30, 70), (60, 80)])
    path = f"file://{tmp_path}/g.npz"
    reports.write_masks(e, vertices, path)
    g = files.layered(spark, path)
    # Classes in order, ids inside a class in order.
    place = {v: i for i, v in enumerate(sorted(range(0, 100, 10), key=lambda v: (v // 10 % 3, v)))}
    assert {(r.src, r.dst) for r in g.edges.collect()} == {tuple(sorted((place[a], place[b]))) for a, b in e.collect()}
    assert g.vertices.count() == 10 and {r.layer for r in g.edges.collect()} == {"12", "13", "23"}
    assert files.with_policy(g, isolates=False).vertices.count() == len({x for r in e.collect() for x in r})
    assert files.with_policy(g, component=True).edges.count() <= 5
    with pytest.raises(ValueError):
        reports.write_masks(table(spark, [(0, 30)]), vertices, path)
    files.write_archive(e, 100, f"file://{tmp_path}/h.npz")
    assert files.archive(spark, f"file://{tmp_path}/h.npz").count() == 5 and files.layered(spark, f"file://{tmp_path}/h.npz").vertices.count() == 100


def test_gml_tables(spark, tmp_path):
    (tmp_path / "g.gml").write_text('graph [ node [ id 1 label "a" ] node [ id 2 ] node [ id 3 label "c d" ] edge [ source 1 target 2 ] edge [ source 2 target 1 value 3 ] edge [ source 1 target 1 ] ]')
    g = files.gml_tables(spark, f"file://{tmp_path}/g.gml")
    assert {(r.id, r.label) for r in g.vertices.collect()} == {(1, "a"), (2, None), (3, "c d")} and [tuple(r) for r in g.edges.collect()] == [(1, 2)]


def test_image_shards_and_sources(spark, tmp_path):
    path = f"file://{tmp_path}/shard"
    spark.createDataFrame([(({"bytes": bytearray(b"abc")}),)], "image struct<bytes:binary>").write.parquet(path)
    assert bytes(reports.image_shards(spark, path).first().bytes) == b"abc"
    assert reports.first_source(spark, None, path).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        reports.first_source(spark, path + "x", path)
    with pytest.raises(ValueError):
        reports.first_source(spark, None, "")


def test_closure_keeps_to_blocks():
    edges, colour, _ = SEED
    s, t = np.array(edges, np.int64).T
    block = np.array([0, 0, 0, 1, 1, 1, 1])
    new, _ = kernel.closure(7, s, t, np.array(colour), 50, 1.0, 3, block=block)
    assert len(new) and all(block[a] == block[b] and colour[a] != colour[b] for a, b in new)


def test_growth_and_floored_club(spark):
    real = spark.createDataFrame([(k, 30 - k, 0.5 + 0.01 * k) for k in range(15)], "k long, n_above long, phi double")
    nulls = spark.createDataFrame([(i, k, 0.3 + 0.001 * i) for i in range(30) for k in range(12)], "null_id long, k long, phi double")
    r = compare.floored_club(nulls, real).first()
    assert (r.significant, r.run, r.significant_floored, r.run_floored, r.highest_k) == (12, 12, 11, 11, 10)
    assert growth.relocate(table(spark, [(0, 1), (1, 2)]), table(spark, [(1, 2)])).count() == 1
    assert richclub.phi(table(spark, PETERSEN)).count() == 3


def test_recurrent_messages(spark):
    e = spark.createDataFrame([(0, 1, "12"), (0, 2, "13"), (1, 2, "23")], "src long, dst long, layer string")
    base = spark.createDataFrame([(0, 1.0)], "id long, value double")
    got = {(r.round, r.id): r.value for r in layers.recurrent(e, base, 2, (1,)).collect()}
    # Round 1: a2 = 1, a1 = 1, a3 = 1 + 1 = 2. Round 2: a2 = 1 + 2, a1 = 1 + 2, a3 = 3 + 3.
    assert got == {(1, 2): 2.0, (2, 0): 3.0, (2, 1): 3.0, (2, 2): 6.0}


def test_swapped_parent_edges_move_once_a_label(spark):
    labels = spark.createDataFrame([(i, 0, i // 6, 0) for i in range(24)], "id long, outer long, middle long, inner long")
    some = [x for x in rings() if x[:2] not in ((0, 5), (6, 11))]
    w = weighted(spark, some).persist()
    parent = table(spark, [(a * 20 + i, b * 20 + j) for a, b, _ in some for i in range(20) for j in range(20) if (i + j) % 2]).persist()
    vertices = spark.createDataFrame([(v, v // 20, v % 2) for v in range(480)], "id long, label long, colour long")
    store, m = spark.sparkContext._jsc.sc().statusStore(), parent.count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def sent():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
        return sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))

    before = sent()
    lifted = display.swap_and_lift(parent, vertices, w.select("src", "dst"), w, labels, 2)[0].collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    pairs = {(a // 20, b // 20) for a, b in lifted}
    assert {(0, 5), (6, 11)} <= pairs and len(lifted) == len(set(map(tuple, lifted)))
    assert sent() - before < 6 * m


def test_lifted_pairs_come_from_all_members(spark, monkeypatch):
    monkeypatch.setattr(display, "ENDS", 50)
    rng = np.random.default_rng(5)
    colour = lambda v: v % 3
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 200, (500, 2)) if a < b} | {(48, z) for z in range(150, 170)} | {(99, z) for z in range(150, 170)} | {(47, z) for z in range(150, 160)}
    pairs |= {(v, 300) for v in range(100)} - {(48, 99)}
    label = {v: v // 50 for v in range(200)} | {300: 4, 400: 5, 401: 5, 403: 6, 404: 6}
    vertices = spark.createDataFrame([(v, k, colour(v)) for v, k in label.items()], "id long, label long, colour long")
    ends = spark.createDataFrame([(u, label[u], colour(u), z) for a, b in pairs for u, z in ((a, b), (b, a))], "id long, label long, colour long, z long")
    near = {v: {z for a, b in pairs for u, z in ((a, b), (b, a)) if u == v} for v in label}
    asked = [(0, 1), (0, 2), (1, 3), (5, 6), (0, 6)]
    want = {min((-len(near[u] & near[w]), u, w) for u in label for w in label if (label[u], label[w]) == p and colour(u) != colour(w))[1:] for p in asked}
    got = display.best_joins(spark.createDataFrame(asked, "a long, b long"), vertices, ends).collect()
    assert {tuple(r) for r in got} == {tuple(sorted(p)) for p in want} and any(u % 50 >= 30 for u, _ in want)


def test_swap_tries_members_beyond_the_thirtieth(spark):
    labels = spark.createDataFrame([(i, 0, i // 6, 0) for i in range(24)], "id long, outer long, middle long, inner long")
    w = weighted(spark, [x for x in rings() if x[:2] not in ((0, 5), (6, 11))])
    of = lambda label, i: label * 40 + i
    parent = table(spark, [(of(2, i), of(0, 37)) for i in range(9)] + [(of(2, i), of(5, 38)) for i in range(9)])
    vertices = spark.createDataFrame([(v, v // 40, v % 2) for v in range(960)], "id long, label long, colour long")
    lifted = display.swap_and_lift(parent, vertices, w.select("src", "dst"), w, labels, 2)[0].collect()
    assert (of(0, 37), of(5, 38)) in {tuple(sorted(r)) for r in lifted}
