"""Graph operators on graphs whose answers are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.kernels import graphs
from tallygraph.model import canonical, degrees, relabel
from tallygraph.operators import communities, construct, degree, ensemble, paths, richclub, triangles
from tallygraph.sources import files

PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]


def frame(spark, edges):
    return canonical(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long"))


def complete(n):
    return [(i, j) for i in range(n) for j in range(i)]


def test_petersen_distances(spark):
    e = frame(spark, PETERSEN)
    h = {r.d: r.pairs for r in paths.histogram(paths.distances(e, degrees(e).select("id"))).collect()}
    assert h == {1: 30, 2: 60} == {r.d: r.pairs for r in ensemble.distance_histogram(e).collect()}
    s = paths.path_summary(paths.histogram(paths.distances(e, degrees(e).select("id"))), 10).first()
    assert s.diameter == 2 and s.average_path == pytest.approx(5 / 3)
    assert triangles.clustering(e).first().transitivity == 0


def test_components(spark):
    e = frame(spark, [(i, i + 1) for i in range(30)] + [(100 + i, 101 + i) for i in range(5)])
    got = {r.id: r.component for r in paths.components(e).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(6)}}


def test_complete_graph(spark):
    e = frame(spark, complete(6))
    c = triangles.clustering(e).first()
    assert (c.triangles, c.transitivity, c.average_clustering) == (20, 1.0, 1.0)
    assert {r.support for r in triangles.support(e).collect()} == {4}
    s = ensemble.spectrum(e).first()
    assert s.lambda_max == pytest.approx(5) and s.energy == pytest.approx(10) and s.hoffman == pytest.approx(6) and s.kirchhoff == pytest.approx(5)
    assert s.tree_entropy == pytest.approx(math.log(6**4) / 6)
    assert [(r["size"], r.cliques) for r in ensemble.clique_census(e).collect()] == [(6, 1)]
    assert ensemble.fractional_cover(e).first().value == 3


def test_star_betweenness_and_gini(spark):
    e = frame(spark, [(0, i) for i in range(1, 6)])
    b = {r.vertex: r.betweenness for r in ensemble.betweenness(e).collect()}
    assert b[0] == pytest.approx(1) and all(b[i] == 0 for i in range(1, 6))
    x = np.sort([5, 1, 1, 1, 1, 1])
    want = 2 * (x * np.arange(1, 7)).sum() / (6 * x.sum()) - 7 / 6
    assert degree.summary(e).first().gini == pytest.approx(want)


def test_cover_and_matching(spark):
    assert ensemble.fractional_cover(frame(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)])).first().value == 2.5
    rng = np.random.default_rng(0)
    for _ in range(20):
        near = [sorted(set(rng.integers(0, 8, 3).tolist())) for _ in range(8)]
        best = 0
        for order in range(60):
            used, size = set(), 0
            for u in np.random.default_rng(order).permutation(8):
                v = next((v for v in near[u] if v not in used), None)
                if v is not None:
                    used.add(v)
                    size += 1
            best = max(best, size)
        assert best <= graphs.matching(8, 8, near) <= 8


def test_swaps_keep_degrees():
    rng = np.random.default_rng(1)
    e = {tuple(sorted(x)) for x in rng.integers(0, 40, (200, 2)).tolist() if x[0] != x[1]}
    s, t = np.array(sorted(e)).T
    a, b = graphs.swaps(40, s, t, 7)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(e) and (a < b).all()
    assert (np.bincount(np.r_[a, b], minlength=40) == np.bincount(np.r_[s, t], minlength=40)).all()
    assert (graphs.swaps(40, s, t, 7)[0] == a).all()


def test_louvain_finds_planted_blocks(spark):
    e = complete(8) + [(8 + i, 8 + j) for i, j in complete(8)] + [(0, 8)]
    got = ensemble.louvain(frame(spark, e), [1.0], 3).where("run = 0").collect()
    labels = {r.vertex: r.label for r in got}
    assert len({labels[i] for i in range(8)}) == 1 and len({labels[8 + i] for i in range(8)}) == 1 and labels[0] != labels[8]


def test_rich_club_forms_agree(spark):
    rng = np.random.default_rng(2)
    e = frame(spark, rng.integers(0, 30, (120, 2)).tolist())
    n, s, t = ensemble.arrays(e)
    got = [r.phi for r in richclub.phi(e).orderBy("k").collect()]
    assert got == pytest.approx(graphs.rich_club(n, s, t).tolist())
    table = richclub.null_table(ensemble.null_rich_clubs(e, 5), richclub.phi(e)).collect()
    assert all(0 < r.p <= 1 for r in table)


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.20])), "k long, p double")
    got = [r.q for r in richclub.benjamini_hochberg(t, "k", "p").orderBy("k").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20])


def test_minima(spark):
    c = spark.createDataFrame(list(zip(range(8), [3.0, 1.0, 1.0, 1.0, 2.0, 0.5, 0.7, 0.7])), "x long, y double")
    assert [(r.x, r.y) for r in richclub.minima(c, "x", "y").orderBy("x").collect()] == [(2, 1.0), (5, 0.5)]


def test_axon_law(spark):
    w = [1, 2, 5, 6, 10, 20, 50, 100, 200, 978]
    got = spark.createDataFrame([(x,) for x in w], "w long").select("w", degree.axons("w").alias("a")).orderBy("w").collect()
    assert [r.a for r in got] == [1, 1, 1, 2, 2, 3, 6, 11, 21, 101]


def test_agreement_of_a_partition_with_itself(spark):
    x = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, label long")
    r = communities.agreement(x, x).first()
    assert r.vi == pytest.approx(0, abs=1e-9) and r.nmi == pytest.approx(1) and r.ari == pytest.approx(1)


def test_product_edge_count(spark):
    seed = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    e = seed
    for k in (2, 3):
        e = construct.kronecker(e, seed, 3)
        assert e.count() == 2 ** (k - 1) * 3**k


def test_boxes():
    n = 12
    g = graphs.Csr(n, np.arange(n - 1), np.arange(1, n))
    assert [graphs.boxes(g, r) for r in (1, 2, 20)] == [4, 3, 1]


def test_readers(spark, tmp_path):
    want = {(1, 2), (2, 3)}
    cases = {
        "a.txt": ("# c\n% d\n\n1 2\n3,2\n2 2\nx y\n2 1 7.5\n", files.edge_list, want),
        "a.gml": ("graph [ node [ id 1 ] edge [ source 1 target 2 ] edge [ source 3 target 2 value 4 ] ]", files.gml, want),
        "a.wl": ("Graph[{1,2,3},{DirectedEdge[1, 2], DirectedEdge[2,1],DirectedEdge[3,2]}]", files.arrow_graph, want),
        "a.json": ('{"adjacencyList": [[], [2], [1, 3], [2]]}', files.adjacency_json, want),
        "a.mtx": ("%%MatrixMarket matrix coordinate pattern symmetric\n% x\n4 4 2\n3 2\n4 3\n", files.matrix_market, want),
    }
    for name, (text, read, expected) in cases.items():
        (tmp_path / name).write_text(text)
        assert {(r.src, r.dst) for r in read(spark, str(tmp_path / name)).collect()} == expected, name
    files.write_archive(frame(spark, [(0, 1), (2, 1)]), 3, str(tmp_path / "g.npz"))
    assert {(r.src, r.dst) for r in files.archive(spark, str(tmp_path / "g.npz")).collect()} == {(0, 1), (1, 2)}
    mask = np.zeros((2, 2), np.uint8)
    mask[1, 0] = 1  # row of the higher class, column of the lower
    np.savez(tmp_path / "m.npz", n1=2, n2=2, n3=2, mask_12=mask, mask_13=np.zeros((2, 2), np.uint8), mask_23=np.zeros((2, 2), np.uint8))
    assert [(r.src, r.dst) for r in files.archive(spark, str(tmp_path / "m.npz")).collect()] == [(0, 3)]


def test_relabel(spark):
    got = relabel(frame(spark, [(10, 70_000), (70_000, 500_000)])).orderBy("src").collect()
    assert [(r.src, r.dst) for r in got] == [(0, 1), (1, 2)]
