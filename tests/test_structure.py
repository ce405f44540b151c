"""Structure, growth, layers, formats and streams on inputs whose answers are known."""

import io
import math
import tarfile
import zipfile
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.functions import scalars
from tallygraph.kernels import generate, graphs
from tallygraph.kernels import structure as kernel
from tallygraph.model import degrees
from tallygraph.operators import ensemble, growth, layers, paths, structure
from tallygraph.plans import audit
from tallygraph.sources import formats
from tallygraph.streaming import tables
from tests.test_graph import PETERSEN, complete, frame


def csr(n, edges):
    e = np.array(sorted({tuple(sorted(x)) for x in edges if x[0] != x[1]}), np.int64).reshape(-1, 2)
    return graphs.Csr(n, e[:, 0], e[:, 1])


def drawn(seed, n=9, m=12):
    return [tuple(x) for x in np.random.default_rng(seed).integers(0, n, (m, 2)).tolist()]


def parts(n, edges):
    s = kernel.Sets(n)
    for a, b in edges:
        s.join(a, b)
    return len({s.find(v) for v in range(n)})


def test_bridges_against_removal():
    for seed in range(20):
        e = sorted({tuple(sorted(x)) for x in drawn(seed) if x[0] != x[1]})
        want = [x for x in e if parts(9, [y for y in e if y != x]) > parts(9, e)]
        assert kernel.bridges(csr(9, e)) == want


def test_odd_cycles():
    assert kernel.odd_cycle(csr(6, [(i, (i + 1) % 6) for i in range(6)])) == []
    for n, edges in ((7, [(i, (i + 1) % 7) for i in range(7)]), (10, PETERSEN)):
        c, g = kernel.odd_cycle(csr(n, edges)), csr(n, edges)
        assert len(c) % 2 and len(set(c)) == len(c) and all(c[i] in g.of(c[i - 1]) for i in range(len(c)))


def test_blossom_against_search():
    for seed in range(40):
        e = sorted({tuple(sorted(x)) for x in drawn(seed, 9, 11) if x[0] != x[1]})
        got = kernel.blossom(csr(9, e))
        assert all(x in e for x in got) and len({v for x in got for v in x}) == 2 * len(got)
        best = next((k for k in (4, 3, 2, 1) if any(len({v for x in c for v in x}) == 2 * k for c in combinations(e, k))), 0)
        assert len(got) == best
    assert len(kernel.blossom(csr(10, PETERSEN))) == 5


def test_colours_and_symmetry():
    assert [kernel.chromatic(csr(n, e)) for n, e in ((10, PETERSEN), (5, complete(5)), (6, [(i, (i + 1) % 6) for i in range(6)]), (3, []))] == [3, 5, 2, 1]
    g = csr(10, PETERSEN)
    colour = kernel.dsatur(g)
    assert all(colour[v] != colour[w] for v in range(10) for w in g.of(v))
    assert kernel.symmetry(g) == (120, [0] * 10)
    assert kernel.symmetry(csr(4, [(0, 1), (0, 2), (0, 3)])) == (6, [0, 1, 1, 1])
    assert kernel.symmetry(csr(4, [(0, 1), (1, 2), (2, 3)])) == (2, [0, 1, 1, 0])


def test_edge_betweenness_and_skeleton(spark):
    e = frame(spark, [(0, 1), (1, 2), (2, 3), (0, 2)])
    b = {(r.src, r.dst): r.betweenness * 12 / 2 for r in structure.edge_betweenness(e).collect()}
    assert b == pytest.approx({(0, 1): 1, (1, 2): 2, (2, 3): 3, (0, 2): 2})
    s = {(r.src, r.dst) for r in structure.skeleton(e).collect()}
    assert len(s) == 3 and (2, 3) in s


def test_boxes_and_fit(spark):
    assert kernel.random_boxes(csr(5, complete(5)), 2, 0) == 1 and kernel.random_boxes(csr(5, complete(5)), 1, 0) == 5
    c = spark.createDataFrame([(x, 1000.0 / x**2) for x in (1, 2, 4, 5)], "l long, n double")
    r = structure.scaling_fit(c, "l", "n").first()
    assert r.dimension == pytest.approx(2) and r.power_r2 == pytest.approx(1) and r.exponential_r2 < 1
    assert structure.scaling_fit(c.limit(2), "l", "n").first().dimension is None


def test_local_efficiency(spark):
    assert {r.efficiency for r in structure.local_efficiency(frame(spark, complete(5))).collect()} == {1.0}
    assert {r.efficiency for r in structure.local_efficiency(frame(spark, PETERSEN)).collect()} == {0.0}
    # The hub of a wheel sees a cycle of 5: five pairs at 1, five at 2.
    wheel = [(0, i) for i in range(1, 6)] + [(i, i % 5 + 1) for i in range(1, 6)]
    assert structure.local_efficiency(frame(spark, wheel)).where("vertex = 0").first().efficiency == pytest.approx(0.75)


def test_spectral_forms(spark):
    r = structure.controllability(frame(spark, complete(4))).first()
    assert r.modal == pytest.approx(1 - 3 / 16)
    assert r.average == pytest.approx(0.25 / (1 - 9 / 16) + 0.75 / (1 - 1 / 16))
    two = complete(5) + [(5 + i, 5 + j) for i, j in complete(5)] + [(0, 5)]
    assert tuple(structure.fiedler_cut(frame(spark, two)).first()) == (10, 1, pytest.approx(1 / 21))


def test_layers_keep_degrees_towards_colours(spark):
    rng = np.random.default_rng(3)
    e = frame(spark, [x for x in rng.integers(0, 40, (250, 2)).tolist() if x[0] % 3 != x[1] % 3])
    c = degrees(e).select("id", (F.col("id") % 3).alias("colour"))

    def towards(rows):
        out = {}
        for a, b in rows:
            for v, w in ((a, b), (b, a)):
                out[v, w % 3] = out.get((v, w % 3), 0) + 1
        return out

    rows = [(r.src, r.dst) for r in e.collect()]
    nulls = structure.layered_nulls(e, c, 2).collect()
    for i in (0, 1):
        got = [(r.src, r.dst) for r in nulls if r.null_id == i]
        assert len(set(got)) == len(rows) and towards(got) == towards(rows) and set(got) != set(rows)


def test_connected_null():
    e = csr(12, [(i, (i + 1) % 12) for i in range(12)] + [(0, 6), (3, 9)])
    owner = np.repeat(np.arange(12), e.degree)
    on = owner < e.near
    a, b = kernel.connected_swaps(12, owner[on], e.near[on], 1)
    assert parts(12, zip(a.tolist(), b.tolist())) == 1


@pytest.mark.parametrize("kind", generate.KINDS)
def test_baselines(kind):
    rng = np.random.default_rng(1)
    e = np.unique(np.sort(rng.integers(0, 200, (900, 2)), 1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    a, b = generate.make(kind, 200, e[:, 0], e[:, 1], np.arange(200) % 4, 5)
    assert (a < b).all() and len(set(zip(a.tolist(), b.tolist()))) == len(a) and b.max() < 200
    assert len(a) == len(e) if kind in ("uniform", "geometric", "blocks", "rewired") else 0.7 * len(e) < len(a) < 1.25 * len(e)
    if kind == "uniform":
        assert len(generate.uniform(5, 10, rng)[0]) == 10 == len(set(zip(*[x.tolist() for x in generate._pairs(np.arange(10), 5)])))


def test_closure_is_legal_and_recorded(spark):
    e = frame(spark, np.random.default_rng(4).integers(0, 60, (150, 2)).tolist())
    c = degrees(e).select("id", (F.col("id") % 3).alias("colour"))
    after, record = growth.random_closure(e, c, 50)
    old = {(r.src, r.dst) for r in e.collect()}
    rows = [(r.src, r.dst) for r in after.collect()]
    new = set(rows) - old
    assert len(rows) == len(set(rows)) == len(old) + record.agg(F.sum("taken")).first()[0]
    near = {v: {w for x in old for w in x if v in x and w != v} for x in old for v in x}
    assert new and all(a % 3 != b % 3 and near[a] & near[b] for a, b in new)
    assert all(r.drawn >= r.legal + r.stopped and r.legal >= r.taken for r in record.collect())
    assert {tuple(r) for r in growth.random_closure(e, c, 50)[1].collect()} == {tuple(r) for r in record.collect()}


def test_growth(spark):
    seed = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    e, c = growth.grow(seed, spark.createDataFrame([(i, i) for i in range(3)], "id long, colour long"), 3, [0, 0])
    assert e.count() == 18 and c.count() == 9 and e.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("a = b").count() == 0


def test_merges(spark):
    size, weight = {0: 1, 1: 4, 2: 4, 3: 5}, {(0, 1): 1, (0, 2): 2, (1, 3): 9, (2, 3): 1}
    assert kernel.merge_small(size, weight, 3) == {0: 2, 1: 1, 2: 2, 3: 3}
    assert kernel.merge_dense(size, weight, 3) == {0: 0, 1: 1, 2: 0, 3: 3}
    assert len(set(kernel.merge_dense(size, weight, 1).values())) == 1
    assert len(set(kernel.merge_small({0: 1, 1: 1}, {}, 1).values())) == 2


def test_partitions(spark):
    two = complete(6) + [(6 + i, 6 + j) for i, j in complete(6)] + [(0, 6)]
    e = frame(spark, two)
    r = structure.best_partition(e, ensemble.louvain(e, [1.0], 3).drop("gamma")).collect()
    assert len({x.label for x in r if x.vertex < 6}) == 1 and r[0].modularity == pytest.approx(30 / 31 - 0.5)
    fine = spark.createDataFrame([(i, i // 2) for i in range(8)], "id long, label long")
    coarse = spark.createDataFrame([(i, i // 4) for i in range(8)], "id long, label long")
    assert structure.nesting(fine, coarse).first().nesting == 1 and structure.nesting(coarse, fine).first().nesting == 0.5


def test_refined_and_cover(spark):
    e = frame(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])
    c = {r.id: r.colour for r in structure.refined(e).collect()}
    assert c[0] == c[4] and c[1] == c[3] and len(set(c.values())) == 3
    m = structure.maximal_matching(frame(spark, PETERSEN)).collect()
    used = {v for r in m for v in r}
    assert len(used) == 2 * len(m) and all(set(x) & used for x in PETERSEN)
    assert structure.maximal_matching(e.limit(0)).count() == 0


def test_intersection_array(spark):
    e = frame(spark, PETERSEN)
    d = paths.distances(e, degrees(e).select("id"))
    assert [tuple(r) for r in structure.intersection_array(d, e).orderBy("d").collect()] == [(0, 0, 3), (1, 1, 2), (2, 1, 0)]


def test_odd_cycle_is_restored(spark):
    even = frame(spark, [(0, 1), (1, 2), (2, 3), (0, 3)])
    got = structure.enforce_odd_cycle(even, frame(spark, [(0, 2)]))
    assert got.count() == 5 and structure.enforce_odd_cycle(got, even).count() == 5
    with pytest.raises(ValueError):
        structure.enforce_odd_cycle(even, even)


def test_shared_boxes(spark):
    b = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 9), (3, 2, 1), (3, 1, 1)], "id long, scale long, box long")
    lab = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 0)], "id long, label long")
    col = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 2)], "id long, colour long")
    assert [tuple(r) for r in growth.shared_boxes(b, frame(spark, [(0, 1)]), lab, col).collect()] == [(1, 3)]


def test_masks_and_errors(spark):
    rows = spark.createDataFrame([(i, 0.3) for i in range(5)], "seed long, target double")
    got = layers.masks(rows).collect()
    assert all(0.3 <= r.coverage < 0.7 for r in got) and got == layers.masks(rows).collect()
    p = spark.createDataFrame([(0, [0.0, 1.0], [0.1, 0.9]), (1, [0.5], [0.5])], "id long, a array<double>, b array<double>")
    r = {x.id: x for x in layers.pixel_errors(p).collect()}
    assert r[0].l1 == pytest.approx(10) and r[0].psnr == pytest.approx(20) and r[1].psnr is None


def test_fingerprints(spark):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    x[200] = x[3]
    q[0] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>").repartition(5)
    got = {r.print_id: r for r in layers.fingerprint_match(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "print_id long, vec array<double>"), rows).collect()}
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    assert [got[i].vec_id for i in range(7)] == d.argmin(1).tolist() and got[0].distance == 0


def test_audit_tables(spark):
    one = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert {r.rule: r.verdict for r in audit.verdicts(one, {"x": "a > 0", "y": "a > 2", "z": "b > 0"}).collect()} == {"x": "pass", "y": "fail", "z": "not_tested"}
    real = spark.createDataFrame([(3, 4), (5, 1)], "size long, cliques long")
    nulls = spark.createDataFrame([(0, 3, 2), (1, 3, 4), (1, 4, 2)], "null_id long, size long, cliques long")
    r = {x["size"]: x for x in audit.enrichment(real, nulls).collect()}
    assert r[3].ratio == pytest.approx(4 / 3) and r[3].z == pytest.approx(1 / math.sqrt(2)) and r[4].ratio == 0 and r[5].ratio == math.inf
    h = spark.createDataFrame([(1, 5), (2, 3), (4, 6), (5, 1)], "k long, n long")
    assert {x.k for x in audit.peaks(h, "k", "n").collect()} == {1, 4}
    assert audit.small_world(0.5, 2.0, 0.1, 2.0) == pytest.approx(5)
    t = spark.createDataFrame([(2.0, 4.0)], "p double, q double")
    assert scalars.mean_deviation(spark.createDataFrame([(1.0, 4.0)], "p double, q double"), t, ["p", "q"]).first().deviation == 0.25


def test_formats(spark, tmp_path):
    edges = [(0, 1), (0, 2), (1, 9), (8, 9)]
    head = b"c x\np edge 10 4\n"
    bits = b""
    for row in range(10):
        near = np.zeros((row // 8 + 1) * 8, np.uint8)
        near[[a for a, b in edges if b == row]] = 1
        bits += np.packbits(near).tobytes()
    (tmp_path / "g.clq.b").write_bytes(b"%d\n" % len(head) + head + bits)
    assert {tuple(r) for r in formats.bit_matrix(spark, str(tmp_path / "g.clq.b")).collect()} == set(edges)
    (tmp_path / "bad.b").write_bytes(b"%d\n" % len(head) + head + bits + b"\0")
    with pytest.raises(Exception, match="preamble"):
        formats.bit_matrix(spark, str(tmp_path / "bad.b")).collect()
    (tmp_path / "g.graphml").write_text('<graph><node id="n1"/><edge id="e" source="n2" target="n1"><data/></edge><edge source="n1" target="n1"/></graph>')
    assert [tuple(r) for r in formats.graphml(spark, str(tmp_path / "g.graphml")).collect()] == [("n1", "n2")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("big.edges", "% c\n1,2\n2 3 0.5\nx y\n")
    assert {tuple(r) for r in formats.pairs_of(formats.packed_lines(spark, str(tmp_path / "a.zip"))).collect()} == {(1, 2), (2, 3)}
    text = b"%%MatrixMarket matrix coordinate pattern symmetric\n% c\n4 5 2\n2 1\n3 2\n"
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d/m.mtx")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text))
    assert {tuple(r) for r in formats.pairs_of(formats.packed_lines(spark, str(tmp_path / "a.tar.gz"))).collect()} == {(1, 2), (2, 3)}
    (tmp_path / "n.csv").write_text("from,to,type\nB,A,S\nA,C,S\nA,B,EJ\nC,D,NMJ\n")
    e, names = formats.named_pairs(spark, str(tmp_path / "n.csv"), "from", "to", "type", ("NMJ",))
    assert {tuple(r) for r in e.collect()} == {(0, 1), (0, 2)} and {tuple(r) for r in names.collect()} == {(0, "A"), (1, "B"), (2, "C")}
    (tmp_path / "w.txt").write_text("<p>\nCUE,TARGET,S\na,b,0.5\nb,a,0.25\na,c,1\n")
    assert {tuple(r) for r in formats.associations(spark, str(tmp_path / "w.txt")).collect()} == {("a", "b", 0.75), ("a", "c", 1.0)}


def test_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k long, x double")
    assert formats.append_lines(rows, str(tmp_path / "log"), "k").count() == 2
    more = spark.createDataFrame([(2, 9.0), (3, 1.0)], "k long, x double")
    got = {r.k: r.x for r in formats.append_lines(more, str(tmp_path / "log"), "k").collect()}
    assert got == {1: 0.5, 2: None, 3: 1.0}
    assert formats.same_content(rows, rows) and not formats.same_content(rows, rows.unionByName(rows))


def test_streams_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k":1,"v":"a"}\n{"k":1,"v":"a"}\n{"k":2,"v":"b"}\n')
    run = lambda: sorted(r.k for r in tables.log(spark, str(tmp_path / "in"), "k long, v string", "k", str(tmp_path / "log")).collect())
    assert run() == [1, 2] == run()
    (tmp_path / "in" / "b.json").write_text('{"k":2,"v":"b"}\n{"k":3,"v":"c"}\n')
    assert run() == [1, 2, 3]
    src = tmp_path / "e"
    schema = "src long, dst long"
    spark.createDataFrame([(0, 1), (1, 2)], schema).coalesce(1).write.mode("append").parquet(str(src))
    grow = lambda: {r.id: r.degree for r in tables.degrees(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "deg")).collect()}
    assert grow() == {0: 1, 1: 2, 2: 1}
    spark.createDataFrame([(1, 3)], schema).coalesce(1).write.mode("append").parquet(str(src))
    assert grow() == {0: 1, 1: 3, 2: 1, 3: 1}


def test_streamed_weights_hold_no_state(spark, tmp_path):
    src, where = tmp_path / "in", tmp_path / "out"
    schema = "src long, dst long"
    for pairs, want in (([(1, 2), (2, 1), (3, 3)], {(1, 2): 2}), ([(2, 1), (1, 4)], {(1, 2): 3, (1, 4): 1})):
        spark.createDataFrame(pairs, schema).coalesce(1).write.mode("append").parquet(str(src))
        got = tables.edge_weights(spark.readStream.schema(schema).parquet(str(src)), str(where)).collect()
        assert {(r.src, r.dst): r.weight for r in got} == want
    assert not (where / "state" / "state").exists()


def test_baselines_above_the_kernels(spark, monkeypatch):
    monkeypatch.setattr(structure, "MOST_EDGES", 100)
    rng = np.random.default_rng(1)
    e = frame(spark, rng.integers(0, 200, (900, 2)).tolist())
    old = {(r.src, r.dst) for r in e.collect()}
    n, m = len({v for x in old for v in x}), len(old)
    degree = np.bincount([sorted({v for x in old for v in x}).index(v) for x in old for v in x], minlength=n)
    rows = structure.baselines(e).collect()
    for kind in generate.KINDS:
        got = [(r.src, r.dst) for r in rows if r.kind == kind]
        assert all(0 <= a < b < n for a, b in got) and len(set(got)) == len(got)
        assert len(got) == m if kind in ("uniform", "geometric", "blocks", "rewired") else 0.7 * m < len(got) < 1.25 * m
        own = np.bincount(np.array(got).ravel(), minlength=n)
        if kind == "rewired":
            assert (own == degree).all()
        if kind in ("configuration", "chung_lu", "block_degrees"):
            assert np.corrcoef(own, degree)[0, 1] > 0.5
        if kind == "blocks":
            assert 0.7 < np.mean([a * 4 // n == b * 4 // n for a, b in got]) < 0.9
    assert len([r for r in structure.baselines(frame(spark, [(i, j) for i in range(20) for j in range(i)]), ("uniform", "geometric")).collect()]) == 2 * 190
