"""Table forms of partitions, forests, rewirings, colourings, covers, matchings and spectra
against brute force and their laws on small graphs."""

import io
import struct
import zlib

import numpy as np
import pytest

from tallygraph.kernels import graphs
from tallygraph.kernels import structure as kernel
from tallygraph.operators import closure, colouring, communities, forests, lanczos, matching, partition, paths, rewiring, sketches, triangles
from tallygraph.sources import matlab


def random_edges(n, p, seed, blocks=1, inside=None):
    """Seeded pairs; with blocks more of them inside."""
    rng = np.random.default_rng(seed)
    a, b = np.triu_indices(n, 1)
    same = a % blocks == b % blocks
    keep = rng.random(len(a)) < np.where(same, inside if inside is not None else p, p)
    return [(int(x) * 3 + 1, int(y) * 3 + 1) for x, y in zip(a[keep], b[keep])]


def frame(spark, edges, extra=()):
    return spark.createDataFrame(edges, "src long, dst long" + "".join(f", {x}" for x in extra)).repartition(3)


def pieces(edges, ids):
    """Components of the ids by the edges among them."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            root[find(a)] = find(b)
    return len({find(i) for i in ids})


RINGS = [(10 * r + i, 10 * r + j) for r in range(6) for i in range(6) for j in range(i)] + [(10 * r, 10 * ((r + 1) % 6)) for r in range(6)]
RINGS = [(min(e), max(e)) for e in RINGS]


@pytest.mark.parametrize("form, quality, gamma", [("leiden", "potts", 0.3), ("louvain", "modularity", 1.0)])
def test_partitions_find_cliques_in_a_ring(spark, form, quality, gamma):
    by = {}
    for r in getattr(partition, form)(frame(spark, RINGS), gamma, quality).collect():
        by.setdefault(r.label, set()).add(r.id)
    assert sorted(map(sorted, by.values())) == [[10 * r + i for i in range(6)] for r in range(6)]


def test_partitions_against_the_kernel(spark):
    edges = random_edges(150, 0.02, 5, 6, 0.35)
    e = frame(spark, edges)
    ids = sorted({x for p in edges for x in p})
    place = {v: i for i, v in enumerate(ids)}
    s, t = np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges])
    label = graphs.louvain(len(ids), s, t, 1.0, 42, False)
    deg = np.bincount(np.concatenate([s, t]))
    best = (label[s] == label[t]).mean() - (np.bincount(label, deg) ** 2).sum() / (4.0 * len(s) ** 2)
    levels = partition.levels(e)
    got = [communities.modularity(e, x).first()[0] for x, _ in levels]
    assert all(abs(x - q / len(edges)) < 1e-9 for x, (_, q) in zip(got, levels))
    assert all(y >= x - 1e-9 for x, y in zip(got, got[1:])) and got[-1] >= 0.98 * best
    held = {r.id: r.label for r in partition.leiden(e).collect()}
    assert sorted(held) == ids
    for c in set(held.values()):
        assert pieces(edges, [i for i in ids if held[i] == c]) == 1


def test_refined_parts_are_connected(spark):
    """Inside one community that the whole graph forms."""
    edges = random_edges(60, 0.05, 3, 4, 0.5)
    e = frame(spark, edges)
    nodes, near = partition.start(e, 1.0, "modularity")
    from pyspark.sql import functions as F

    parts = {r.id: r.part for r in partition.refine(near, nodes.withColumn("label", F.col("id") % 2)).collect()}
    assert len(parts) == nodes.count() and len(set(parts.values())) < len(parts)
    for p in set(parts.values()):
        ids = [i for i, q in parts.items() if q == p]
        assert len({i % 2 for i in ids}) == 1 and pieces(edges, ids) == 1


def test_blocks_are_parted_by_themselves(spark):
    edges = random_edges(40, 0.2, 8)
    ids = sorted({x for p in edges for x in p})
    block = spark.createDataFrame([(i, i // 60) for i in ids], "id long, block long")
    held = {r.id: r.label for r in partition.louvain(frame(spark, edges), blocks=block).collect()}
    assert sorted(held) == ids and all(i // 60 == c // 60 for i, c in held.items())
    nodes = {r.id: r.rate for r in partition.start(frame(spark, edges), 1.0, "modularity", block)[0].collect()}
    for b in {i // 60 for i in ids}:  # each block has a rate of its own
        m = sum(x // 60 == y // 60 == b for x, y in edges)
        assert all(abs(nodes[i] - (1 / (2 * m) if m else 0)) < 1e-12 for i in ids if i // 60 == b)


@pytest.mark.parametrize("largest", [True, False])
def test_spanning_forest(spark, largest):
    seed = 1 + largest
    rng = np.random.default_rng(seed)
    edges = [(a, b, float(rng.integers(1, 5))) for a, b in random_edges(60, 0.06, seed)]
    got = sorted((r.src, r.dst, r.weight) for r in forests.spanning_forest(frame(spark, edges, ["w double"]), "w", largest).collect())
    root, want = {x: x for a, b, _ in edges for x in (a, b)}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: (-e[2] if largest else e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert got == sorted(want)


def test_bridges_and_odd_cycles(spark):
    edges = random_edges(50, 0.04, 1) + [(1000, 1001), (1001, 1002), (1002, 1003), (1003, 1004)]
    e = frame(spark, edges)
    ids = sorted({x for p in edges for x in p})
    want = sorted(p for p in edges if pieces([q for q in edges if q != p], ids) > pieces(edges, ids))
    assert sorted(tuple(r) for r in forests.bridges(e).collect()) == want and want
    ring = [r.vertex for r in forests.odd_cycle(e).orderBy("at").collect()]
    assert len(ring) % 2 == 1 and len(set(ring)) == len(ring)
    assert all((min(a, b), max(a, b)) in edges for a, b in zip(ring, ring[1:] + ring[:1]))
    assert forests.odd_cycle(frame(spark, [(a, b + 10_000) for a, b in edges])).count() == 0


def test_below_xors_subtrees(spark):
    """A path of many steps: doubling takes few rounds."""
    n = 20
    tree = spark.createDataFrame([(i, 0, max(0, i - 1), i) for i in range(n)], "id long, root long, parent long, depth int")
    values = spark.createDataFrame([(i, 1 << i) for i in range(n)], "id long, x long")
    assert {r.id: r.x for r in forests.below(tree, values).collect()} == {i: sum(1 << j for j in range(i, n)) for i in range(n)}


def test_rewiring(spark):
    edges = random_edges(80, 0.15, 4)
    e = frame(spark, edges)
    nulls = paths._cut(rewiring.rewired(e, 3, rounds=4))
    for r in rewiring.check(e, nulls).collect():
        assert (r.edges, r.loops, r.repeated, r.off_degree) == (len(edges), 0, 0, 0) and r.kept < 0.5 * len(edges)
    sets = [frozenset((r.src, r.dst) for r in nulls.where(f"null_id = {i}").collect()) for i in range(3)]
    assert len(set(sets)) == 3
    deg = np.bincount([x for p in edges for x in p])
    for i, s in enumerate(sets):
        got = {r.k: r.phi for r in rewiring.rich_clubs(e, nulls).where(f"null_id = {i}").collect()}
        for k, x in got.items():
            big = set(np.flatnonzero(deg > k))
            inside = sum(a in big and b in big for a, b in s)
            assert abs(x - 2 * inside / (len(big) * (len(big) - 1))) < 1e-12
    layer = spark.createDataFrame([(x, x % 4) for x in sorted({x for p in edges for x in p})], "id long, layer long")
    kept = rewiring.rewired(e, 2, rounds=3, layer=layer)
    assert all((r.loops, r.repeated, r.off_degree) == (0, 0, 0) and r.kept < len(edges) for r in rewiring.check(e, kept, layer).collect())


def test_priority_colouring(spark):
    edges = random_edges(70, 0.2, 6)
    got = {r.id: r.colour for r in colouring.priority_colouring(frame(spark, edges)).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert set(got) == set(near)
    for v, o in near.items():
        held = {got[x] for x in o}
        assert got[v] not in held and set(range(got[v])) <= held
    assert max(got.values()) <= max(map(len, near.values()))


def all_distances(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        seen, front, d = {s: 0}, [s], 0
        while front:
            d += 1
            front = [x for x in {y for v in front for y in near[v]} if x not in seen]
            seen |= dict.fromkeys(front, d)
        out[s] = seen
    return out


def test_sketches(spark):
    edges = random_edges(120, 0.03, 9)
    e, dist = frame(spark, edges), all_distances(edges)
    want = {}
    for seen in dist.values():
        for d in seen.values():
            want[d] = want.get(d, 0) + (d > 0)
    want.pop(0)
    exact = {r.d: r.pairs for r in sketches.neighbourhood(e, exact=1_000).collect()}
    near = {r.d: r.pairs for r in sketches.neighbourhood(e).collect()}
    assert exact == want
    run = lambda h: np.cumsum([h.get(d, 0) for d in range(1, max(want) + 1)])
    assert (np.abs(run(near) - run(want)) <= 3 * sketches.error(10) * run(want)).all()
    for r in (1, 2):
        boxes = sketches.box_cover(e, r).collect()
        centres = {b.centre for b in boxes}
        assert {b.id for b in boxes} == set(dist) and len(boxes) == len(dist)
        assert all(dist[b.centre][b.id] == b.distance <= r for b in boxes)
        assert all(y not in dist[x] or dist[x][y] > r for x in centres for y in centres if x != y)


def test_fractional_matching(spark):
    edges = random_edges(40, 0.06, 1)
    ids = sorted({x for p in edges for x in p})
    near = [[] for _ in ids]
    for a, b in edges:
        near[ids.index(a)].append(ids.index(b))
        near[ids.index(b)].append(ids.index(a))
    x, y = matching.fractional(frame(spark, edges))
    x, y = {(r.src, r.dst): r.x for r in x.collect()}, {r.id: r.y for r in y.collect()}
    assert sum(x.values()) == sum(y.values()) == graphs.matching(len(ids), len(ids), near) / 2
    assert set(x) <= set(edges) and all(y[a] + y[b] >= 1 for a, b in edges)
    assert all(sum(w for e, w in x.items() if v in e) <= 1 for v in ids)


def dense(edges, kind):
    ids = sorted({x for p in edges for x in p})
    a = np.zeros((len(ids), len(ids)))
    for x, y in edges:
        a[ids.index(x), ids.index(y)] = a[ids.index(y), ids.index(x)] = 1
    d = a.sum(1)
    return ids, {"adjacency": a, "laplacian": np.diag(d) - a, "walk": a / np.sqrt(np.outer(d, d))}[kind]


@pytest.mark.parametrize("kind", lanczos.KINDS)
def test_lanczos(spark, kind):
    edges = random_edges(14, 0.4, 2)
    ids, m = dense(edges, kind)
    want = np.linalg.eigvalsh(m)
    got = lanczos.lanczos(lanczos.Matrix(frame(spark, edges), kind), 14)
    assert got.residuals.max() < 1e-6
    for x in (0, -1):
        assert abs(got.values[x] - want[x]) < 1e-8
    v = {r.id: r.value for r in got.vectors([len(got.values) - 1]).collect()}
    v = np.array([v[i] for i in ids])
    assert np.abs(m @ v - want[-1] * v).max() < 1e-6 and abs(v @ v - 1) < 1e-9


def test_traces(spark):
    edges = random_edges(40, 0.2, 3) + [(1000, 1001), (1001, 1002), (1000, 1002)]
    e = frame(spark, edges)
    _, a = dense(edges, "adjacency")
    x = np.linalg.eigvalsh(a)
    m = lanczos.moments(lanczos.Matrix(e), x[0], x[-1], 2, 24)
    for f in (np.square, lambda y: y**3, lambda y: y**4):
        near, off = m.trace(f)
        assert abs(near - f(x).sum()) <= 4 * off + 1e-6
    mu = np.linalg.eigvalsh(dense(edges, "laplacian")[1])
    up = mu[mu > 1e-9]
    ml = lanczos.moments(lanczos.Matrix(e, "laplacian"), up[0], up[-1], 10, 12, deflate=True)
    assert ml.size == len(up)
    for f in (np.log, lambda y: 1 / y):
        near, off = ml.trace(f)
        assert abs(near - f(up).sum()) <= 4 * off + 0.04 * abs(f(up).sum())
    walks = {r.power: r.walks for r in triangles.closed_walks(e).collect()}
    assert walks == {p: round((x**p).sum()) for p in (2, 3, 4)}


def element(kind, body, order):
    return struct.pack(order + "II", kind, len(body)) + body + bytes(-len(body) % 8)


def mat_file(name, matrix, sparse, packed, order="<", kind="f8"):
    """A level-5 file with another variable before the matrix."""
    tag = lambda x: {"f8": 9, "u1": 2, "i4": 5}[x]

    def variable(name, m, sparse):
        flags = element(6, struct.pack(order + "II", 5 if sparse else {"f8": 6, "u1": 9}[kind], int((m != 0).sum())), order)
        head = flags + element(5, struct.pack(order + "ii", *m.shape), order)
        small = name.encode()
        head += struct.pack(order + "I", len(small) << 16 | 1) + small.ljust(4, b"\0") if len(small) <= 4 else element(1, small, order)
        if sparse:
            rows, cols = np.nonzero(m.T)[1], np.concatenate([[0], np.cumsum((m != 0).sum(0))])
            body = element(5, rows.astype(order + "i4").tobytes(), order) + element(5, cols.astype(order + "i4").tobytes(), order)
            body += element(9, m.T[m.T != 0].astype(order + "f8").tobytes(), order)
        else:
            body = element(tag(kind), m.T.astype(order + kind).tobytes(), order)
        out = element(14, head + body, order)
        return struct.pack(order + "II", 15, len(z := zlib.compress(out))) + z if packed else out

    out = io.BytesIO()
    out.write(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI"))
    out.write(variable("other_thing", np.ones((1, 3)), False) + variable(name, matrix, sparse))
    return out.getvalue()


FILES = [(True, True, "<", "f8"), (False, True, "<", "u1"), (True, False, ">", "f8"), (False, False, ">", "f8")]


@pytest.mark.parametrize("sparse, packed, order, kind", FILES)
def test_matlab(spark, tmp_path, sparse, packed, order, kind):
    rng = np.random.default_rng(1)
    m = (rng.random((20, 20)) < 0.06).astype(float)
    m[3, 3] = 2
    m[18], m[:, 18] = 0, 0
    (tmp_path / "g.mat").write_bytes(mat_file("A", m, sparse, packed, order, kind))
    e = matlab.entries(spark, str(tmp_path / "g.mat"), "A")
    assert {(r.row, r.col) for r in e.collect()} == set(zip(*map(lambda x: x.tolist(), np.nonzero(m))))
    s = matlab.summary(e).first()
    assert (s.n_rows, s.n_cols, s.nonzero, s.diagonal, s.one_way) == (20, 20, int((m != 0).sum()), int((np.diag(m) != 0).sum()), int(((m != 0) & (m.T == 0)).sum()))
    if (sparse, packed, order, kind) != FILES[0]:
        return
    both = {(min(a, b), max(a, b)) for a, b in zip(*map(lambda x: x.tolist(), np.nonzero(m))) if a != b}
    ids = sorted({x for p in both for x in p})
    got = {(r.src, r.dst) for r in matlab.adjacency(spark, str(tmp_path / "g.mat"), "A").collect()}
    held = {x for p in got for x in p}
    assert got <= both and got == {p for p in both if p[0] in held} and pieces(both, held) == 1
    assert len(held) >= max(len(c) for c in _components(both, ids))


def _components(edges, ids):
    out = []
    for i in ids:
        if not any(i in c for c in out):
            out.append({j for j in ids if pieces(edges, ids) == pieces([*edges, (i, j)], ids)})
    return out


def test_matlab_refuses(tmp_path):
    m = np.eye(3)
    whole = mat_file("A", m, False, False)
    with pytest.raises(ValueError, match="no matrix"):
        matlab.nonzeros(whole, "B")
    with pytest.raises(ValueError, match="level-5"):
        matlab.nonzeros(b"x" * 200, "A")
    with pytest.raises(ValueError, match="ends inside"):
        matlab.nonzeros(whole[:-8], "A")
    shape, rows, cols = matlab.nonzeros(mat_file("Z", np.zeros((2, 4)), True, True), "Z")
    assert shape == (2, 4) and len(rows) == len(cols) == 0


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert partition.leiden(none).count() == forests.spanning_forest(none).count() == forests.bridges(none).count() == 0
    assert colouring.priority_colouring(none).count() == sketches.box_cover(none, 1).count() == 0
    assert rewiring.rewired(none, 2).count() == 0 and matching.fractional(none)[0].count() == 0


def test_random_closure(spark):
    edges = random_edges(50, 0.12, 7)
    e, colour = frame(spark, edges), {x: x // 3 % 3 for p in edges for x in p}
    new, record = closure.random_closure(e, spark.createDataFrame(list(colour.items()), "id long, colour long"), 40)
    got, rows = [(r.src, r.dst) for r in new.collect()], record.collect()
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert len(got) == len(set(got)) == 40 and not set(got) & set(edges)
    assert all(colour[a] != colour[b] and near[a] & near[b] for a, b in got)
    assert all(r.drawn == r.joined_or_repeated + r.stopped + r.legal and r.taken <= r.legal for r in rows) and rows[0].drawn == 130
    mass = spark.createDataFrame([(i, float(1 + i % 5)) for i in range(200)], "id long, mass double")
    n = {}
    for r in closure.centres(mass, 1_000, 3, 0).collect():
        n[r.id] = n.get(r.id, 0) + 1
    total = sum(1 + i % 5 for i in range(200))
    assert sum(n.values()) == 1_000 and all(abs(n.get(i, 0) - 1_000 * (1 + i % 5) / total) < 1 for i in range(200))


def test_clique_census(spark):
    graphs_ = {0: random_edges(24, 0.45, 1), 1: random_edges(20, 0.6, 2)}
    rows = [(g, a, b) for g, edges in graphs_.items() for a, b in edges]
    got = {(r.g, r.size): r.cliques for r in triangles.clique_census(spark.createDataFrame(rows, "g long, src long, dst long"), "g").collect()}
    want = {}
    for g, edges in graphs_.items():
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

        def extend(r, p, x):
            if not p and not x:
                want[g, len(r)] = want.get((g, len(r)), 0) + 1
            for v in sorted(p):
                extend(r | {v}, p & near[v], x & near[v])
                p, x = p - {v}, x | {v}

        extend(set(), set(near), set())
    assert got == want
