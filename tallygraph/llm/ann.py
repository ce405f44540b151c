"""Approximate nearest neighbours: one hierarchical navigable small-world graph a shard.

Vectors are dealt to cells by their nearest centroid (k-means on a bounded sample),
and a cell's rows to shards of at most about ``SHARD_ROWS``.  A shard's graph has
layers: a node reaches layer l with probability 1 / m^l.  Nodes are inserted in
batches: each searches the graph built so far from the top layer down, and on each
of its layers is linked with those that the search and its batch offer by the
diversity rule (a candidate nearer to a chosen neighbour than to the node is passed
over; spare places are filled with the nearest passed over).  Links run both ways,
and a full list is chosen anew by the same rule.  What a layer's entry cannot reach
in the end is linked to the nearest node with room.  Neighbours are rows of flat
int32 arrays, padded with -1.

Queries scan the top layer, keep a beam on each layer below and one of ``EF`` nodes
on the bottom layer, all queries of a block in step, so that each step is a few
numpy calls.  A query goes to the shards of its nearest ``probes`` cells, the fewest
that hold ``TARGET`` of the exact neighbours of ``PROBED`` queries (found by one
scan of all rows), and the k best of all its shards stay.  On clustered vectors that
is a few cells whatever the table's size; on vectors without clusters most of them.

Inner products order unit vectors as distances do; others get one more coordinate
that makes them so (the root of the largest squared length less their own).  Of
rows with one vector only the k + 1 first by id can be among anyone's k nearest,
so the rest stay out of the index: a mass of copies is one node.

Defined cases: a vector that is null, empty, all zeros, or holds a null, NaN or
infinity takes no part as query or candidate, nor does a null id; vectors of
different length don't meet: each length is searched by itself; repeated rows and rows of one id
are rows of their own, so each query row has its own ranks from 1, and finds others
of its id but never itself; ties go to the smaller id; fewer candidates than k give
fewer rows; an empty table gives none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.llm import common

#: Rows of a cell on average and of a shard; cells at least and at most; rows of the k-means sample a cell, and at least.
CELL_ROWS, SHARD_ROWS, LEAST_CELLS, MOST_CELLS, SAMPLE_CELL, LEAST_SAMPLE = 4_096, 8_192, 16, 16_384, 32, 4_096
#: Links of a new node, beams of search, of insertion and of upper layers.
LINKS, EF, EF_BUILD, EF_UPPER = 16, 128, 96, 16
#: Queries searched in step, nodes inserted at once, queries of one task.
BLOCK, BATCH, TASK_QUERIES = 512, 1_024, 4_096
#: Queries that set the number of cells, and the share of their neighbours that must lie in these.
PROBED, TARGET = 256, 0.985

INDEX = "shard int, part int, kind string, level int, data binary"


def _select(vectors: np.ndarray, cand: np.ndarray, score: np.ndarray, most: int, fill: int) -> np.ndarray:
    """Of candidates (n, c), best first and padded with -1, up to ``most`` by the
    diversity rule, then the nearest passed over up to ``fill``; (n, most)."""
    out = np.full((len(cand), most), -1, np.int32)
    for lo in range(0, len(cand), BLOCK):
        c, s = cand[lo : lo + BLOCK], score[lo : lo + BLOCK]
        x = vectors[c]
        between = x @ x.transpose(0, 2, 1)
        keep = np.zeros(c.shape, bool)
        count = np.zeros(len(c), np.int64)
        for i in range(c.shape[1]):
            shadowed = (keep[:, :i] & (between[:, i, :i] > s[:, i : i + 1])).any(1)
            keep[:, i] = ~shadowed & (c[:, i] >= 0) & (count < most)
            count += keep[:, i]
        spare = ~keep & (c >= 0)
        keep |= spare & (np.cumsum(spare, 1) <= np.maximum(fill - count, 0)[:, None])
        order = np.argsort(~keep, axis=1, kind="stable")[:, :most]
        got = np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(c, order, 1), -1)
        out[lo : lo + len(c), : got.shape[1]] = got
    return out


class Graph:
    """``vectors`` (n, d) float32 of unit length and ``layers``: layer l holds the
    first nodes, as many as its flat neighbour array has rows."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, seed: int = 10) -> tuple[Graph, np.ndarray]:
        """The graph and the order its nodes take: higher layers first."""
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(links)).astype(int)
        order = np.argsort(-level, kind="stable")
        sizes = [n]
        while sizes[-1] > 2 * links and (up := int((level >= len(sizes)).sum())) > 1:
            sizes.append(up)
        layers = [np.full((size, 2 * links if l == 0 else links), -1, np.int32) for l, size in enumerate(sizes)]
        graph = cls(np.ascontiguousarray(vectors[order], np.float32), layers)
        lo = 0
        while lo < n:
            hi = min(n, lo + min(BATCH, max(2 * links, lo)))
            graph._insert(lo, hi, links)
            lo = hi
        graph.layers = [graph._connected(flat) for flat in layers]
        return graph, order

    def _insert(self, lo: int, hi: int, links: int) -> None:
        v = self.vectors
        mine = v[lo:hi]
        near = mine @ mine.T
        np.fill_diagonal(near, -np.inf)
        at = None
        for l in range(len(self.layers) - 1, -1, -1):
            flat = self.layers[l]
            there = min(lo, len(flat))  # nodes already on this layer
            joins = min(hi, len(flat)) - lo  # nodes of the batch that come to it
            if there:
                at = np.arange(there)[None, :].repeat(hi - lo, 0) if at is None else at
                at, found = self._beam(mine, at, l, there, EF_BUILD if joins > 0 else EF_UPPER)
            if joins <= 0:
                continue
            inside = near[:joins, :joins]
            best = np.argpartition(-inside, min(links, joins - 1), axis=1)[:, :links] if joins > links else np.tile(np.arange(joins), (joins, 1))
            cand, score = best + lo, np.take_along_axis(inside, best, 1)
            cand = np.where(np.isfinite(score), cand, -1)
            if there:
                cand, score = np.concatenate([at[:joins], cand], 1), np.concatenate([found[:joins], score], 1)
            rank = np.argsort(-score, axis=1, kind="stable")[:, : 4 * links]
            cand, score = np.take_along_axis(cand, rank, 1), np.take_along_axis(score, rank, 1)
            flat[lo : lo + joins, :links] = _select(v, cand, score, links, links // 2)
            self._back(flat, lo, lo + joins)

    def _back(self, flat: np.ndarray, lo: int, hi: int) -> None:
        """Links back from the neighbours of new nodes; full lists are chosen anew."""
        v, width = self.vectors, flat.shape[1]
        src = np.repeat(np.arange(lo, hi, dtype=np.int32), width)
        dst = flat[lo:hi].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        there = (flat[dst] == src[:, None]).any(1)
        src, dst = src[~there], dst[~there]
        score = np.einsum("ed,ed->e", v[src], v[dst])
        order = np.lexsort((-score, dst))
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        some = place < width  # the nearest newcomers
        src, dst, place = src[some], dst[some], place[some]
        have = (flat[dst] >= 0).sum(1)
        full = np.zeros(len(flat), bool)
        full[dst[have + place >= width]] = True
        easy = ~full[dst]
        flat[dst[easy], (have + place)[easy]] = src[easy]
        src, dst, place = src[~easy], dst[~easy], place[~easy]
        nodes, row = np.unique(dst, return_inverse=True)
        for a in range(0, len(nodes), BLOCK):
            part = nodes[a : a + BLOCK]
            of = (row >= a) & (row < a + len(part))
            new = np.full((len(part), int(place[of].max()) + 1), -1, np.int32)
            new[row[of] - a, place[of]] = src[of]
            cand = np.concatenate([flat[part], new], 1)
            score = np.where(cand >= 0, np.einsum("nd,ncd->nc", v[part], v[cand]), -np.inf)
            rank = np.argsort(-score, axis=1, kind="stable")[:, : width + width // 2]
            flat[part] = _select(v, np.take_along_axis(cand, rank, 1), np.take_along_axis(score, rank, 1), width, width)

    def _connected(self, flat: np.ndarray) -> np.ndarray:
        """The layer with links to what its first node could not reach."""
        seen = np.zeros(len(flat), bool)
        start = 0
        while True:
            seen[start] = True
            front = np.array([start])
            while len(front):
                front = np.unique(flat[front])
                front = front[front >= 0]
                front = front[~seen[front]]
                seen[front] = True
            if seen.all():
                return flat
            start = int(np.argmin(seen))
            room = np.flatnonzero(seen & (flat < 0).any(1))
            if not len(room):
                flat = np.concatenate([flat, np.full((len(flat), 1), -1, np.int32)], 1)
                room = np.flatnonzero(seen)
            near = int(room[np.argmax(self.vectors[room] @ self.vectors[start])])
            flat[near, int(np.argmax(flat[near] < 0))] = start

    def search(self, queries: np.ndarray, k: int, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (q, k) and float32 scores, best first; -1 and -inf where there are no more."""
        at = np.arange(len(self.layers[-1]))[None, :].repeat(len(queries), 0)
        for l in range(len(self.layers) - 1, -1, -1):
            at, scores = self._beam(queries, at, l, len(self.layers[l]), EF_UPPER if l else max(ef, k))
        return at[:, :k], scores[:, :k]

    def _beam(self, queries: np.ndarray, start: np.ndarray, l: int, n: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes (q, ef) found among the first n of a layer, and their
        scores, from start nodes (q, w) padded with -1 and without repeats."""
        flat, v, q = self.layers[l], self.vectors, len(queries)
        seen = np.zeros(q * n, bool)
        stamp = np.empty(q * n, np.int32)
        rows = np.arange(q)[:, None]
        first = np.where(start >= 0, np.einsum("qd,qkd->qk", queries, v[start]), -np.inf).astype(np.float32)
        keys = (rows * n + start)[start >= 0]
        seen[keys] = True
        if start.shape[1] > ef:
            best = np.argpartition(-first, ef - 1, axis=1)[:, :ef]
            start, first = np.take_along_axis(start, best, 1), np.take_along_axis(first, best, 1)
        beam = np.full((q, ef), -1, np.int64)
        score = np.full((q, ef), -np.inf, np.float32)
        beam[:, : start.shape[1]], score[:, : start.shape[1]] = start, first
        open_ = beam >= 0
        step = max(4, ef // 12)
        live = np.flatnonzero(open_.any(1))
        while len(live):
            waiting = np.where(open_[live], score[live], -np.inf)
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step] if step < ef else np.tile(np.arange(ef), (len(live), 1))
            ok = np.take_along_axis(open_[live], pick, 1)
            open_[live[:, None], pick] = False
            cur = np.take_along_axis(beam[live], pick, 1)
            near = np.where(ok[:, :, None], flat[np.where(ok, cur, 0)], -1).reshape(len(live), -1)
            r, c = np.nonzero(near >= 0)
            to = near[r, c].astype(np.int64)
            keys = live[r] * n + to
            new = ~seen[keys]
            r, to, keys = r[new], to[new], keys[new]
            stamp[keys] = np.arange(len(keys), dtype=np.int32)
            new = stamp[keys] == np.arange(len(keys))  # one of equal keys
            r, to, keys = r[new], to[new], keys[new]
            seen[keys] = True
            s = np.einsum("ed,ed->e", queries[live[r]], v[to])
            better = s > score[live].min(1)[r]
            r, to, s = r[better], to[better], s[better]
            if len(r):
                count = np.bincount(r, minlength=len(live))
                col = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                add = np.full((len(live), int(count.max())), -1, np.int64)
                adds = np.full(add.shape, -np.inf, np.float32)
                add[r, col], adds[r, col] = to, s
                alls = np.concatenate([score[live], adds], 1)
                best = np.argpartition(-alls, ef - 1, axis=1)[:, :ef]
                score[live] = np.take_along_axis(alls, best, 1)
                beam[live] = np.take_along_axis(np.concatenate([beam[live], add], 1), best, 1)
                open_[live] = np.take_along_axis(np.concatenate([open_[live], add >= 0], 1), best, 1)
            live = live[open_[live].any(1)]
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(beam, order, 1), np.take_along_axis(score, order, 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors on the unit sphere of one more dimension: products with a query
    (unit itself, 0 there) keep their order."""
    square = np.einsum("nd,nd->n", vectors, vectors)
    top = square.max(initial=1e-300)
    return (np.concatenate([vectors, np.sqrt(np.maximum(top - square, 0))[:, None]], 1) / math.sqrt(top)).astype(np.float32)


def asked(queries: np.ndarray) -> np.ndarray:
    """Queries for a graph of ``unit`` vectors."""
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    return np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)


def clean(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows that take part: vec_id, vec, an array of doubles, and a number for the row, fixed when written."""
    fine = F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("row", F.monotonically_increasing_id())


def _matrix(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


class Cells:
    """Centroids in two levels: a vector's cell is the nearest centroid among those
    under its nearest top; cells of one top stand together."""

    def __init__(self, tops: np.ndarray, first: np.ndarray, centroids: np.ndarray):
        self.tops, self.first, self.centroids = tops, first, centroids

    @staticmethod
    def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
        """At most k centroids of the rows of x, none of them empty."""
        c = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
        for _ in range(rounds):
            at = Cells._nearest(x, c)
            n = np.bincount(at, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            c = sums[n > 0] / n[n > 0, None]
        return c

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        half = np.einsum("kd,kd->k", c, c) / 2
        return np.concatenate([(x[lo : lo + 4096] @ c.T - half).argmax(1) for lo in range(0, len(x), 4096)] or [np.zeros(0, int)])

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, seed: int = 10) -> Cells:
        rng = np.random.default_rng(seed)
        tops = cls._means(x, 1 if cells <= 256 else math.isqrt(cells), rng)
        at = cls._nearest(x, tops)
        share = [x[at == t] for t in range(len(tops))]
        leaves = [cls._means(s, max(1, round(cells * len(s) / len(x))), rng) if len(s) else tops[t : t + 1] for t, s in enumerate(share)]
        return cls(tops, np.cumsum([0, *map(len, leaves)]), np.concatenate(leaves))

    def cell(self, x: np.ndarray) -> np.ndarray:
        top = self._nearest(x, self.tops)
        out = np.zeros(len(x), np.int32)
        for t in np.unique(top):
            of = top == t
            out[of] = self.first[t] + self._nearest(x[of], self.centroids[self.first[t] : self.first[t + 1]])
        return out

    def ranks(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query, nearest first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")


def fit_cells(rows: DataFrame, n: int) -> Cells:
    """Centroids from a bounded random sample, by one task."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, -(-n // CELL_ROWS)))
    most = max(LEAST_SAMPLE, SAMPLE_CELL * cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [_matrix(b) for b in batches if b.num_rows]
        if x:
            got = Cells.fit(np.concatenate(x)[: 2 * most], cells)
            yield pa.RecordBatch.from_pydict({"tops": [got.tops.tobytes()], "first": [got.first.tolist()], "centroids": [got.centroids.tobytes()], "dim": [got.tops.shape[1]]})

    some = rows.select("vec").where(F.rand(10) < most / n) if n > most else rows.select("vec")
    got = some.repartition(1).mapInArrow(run, "tops binary, first array<long>, centroids binary, dim long").collect()
    if not got:  # the sample may miss a small table
        got = rows.select("vec").limit(most).repartition(1).mapInArrow(run, "tops binary, first array<long>, centroids binary, dim long").collect()
    r = got[0]
    return Cells(np.frombuffer(r.tops).reshape(-1, r.dim), np.array(r.first), np.frombuffer(r.centroids).reshape(-1, r.dim))


def probes(rows: DataFrame, queries: DataFrame, cells: Cells, k: int) -> int:
    """The fewest nearest cells that hold TARGET of the exact k nearest of PROBED
    queries: one scan of all rows in blocks, of which a task keeps k a query."""
    few = queries.select("row", "vec", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(PROBED).toArrow().combine_chunks()
    few = few.to_batches()[0] if few.num_rows else None
    if few is None:
        return len(cells.centroids)
    ids, q = few.column(0).to_numpy(), _matrix(few)
    rank_of = np.argsort(cells.ranks(q), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(q), 0), -np.inf)
        found = at = np.zeros((len(q), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, vec_id = _matrix(batch), batch.column(batch.schema.get_field_index("row")).to_numpy()
            s = np.where(vec_id[None, :] == ids[:, None], -np.inf, q @ x.T)
            best = np.concatenate([best, s], 1)
            found = np.concatenate([found, np.tile(vec_id, (len(q), 1))], 1)
            at = np.concatenate([at, rank_of[:, cells.cell(x)]], 1)
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, found, at = (np.take_along_axis(y, top, 1) for y in (best, found, at))
        row, col = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_pydict({"query": pa.array(row, pa.int32()), "score": best[row, col], "vec_id": found[row, col], "at": pa.array(at[row, col].astype(np.int32))})

    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    near = rows.mapInArrow(run, "query int, score double, vec_id long, at int").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    got = common.fetch(near.groupBy("at").agg(F.count("*").alias("n")))
    held = np.bincount(got["at"], got["n"], len(cells.centroids)).cumsum()
    return int(np.searchsorted(held, TARGET * held[-1] - 1e-9)) + 1 if held[-1] else len(held)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of one shard in each batch of rows sorted by shard."""
    for batch in batches:
        s = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(s)) + 1), len(s)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(s[a]), batch.slice(a, b - a)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, row = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (1, 2))
        exact = np.concatenate([_matrix(p) for p in parts])
        order = np.lexsort((row, ids))
        ids, row, exact = ids[order], row[order], exact[order]
        _, first, node = np.unique(exact, axis=0, return_index=True, return_inverse=True)
        graph, order = Graph.build(unit(exact[first]))
        place = np.argsort(order)
        out = [("ids", 0, ids.astype("<i8")), ("rows", 0, row.astype("<i8")), ("node", 0, place[node.ravel()].astype("<i4")), ("vectors", exact.shape[1], exact[first][order].astype("<f8"))]
        out += [("links", flat.shape[1], flat.astype("<i4")) for flat in graph.layers]
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(out), pa.int32()), "part": pa.array(range(len(out)), pa.int32()), "kind": [k for k, _, _ in out], "level": pa.array([l for _, l, _ in out], pa.int32()), "data": [a.tobytes() for _, _, a in out]})

    now, held = None, []
    for shard, part in _by_shard(batches):
        if now is not None and shard != now:
            yield rows(now, held)
            held = []
        now = shard
        held.append(part)
    if held:
        yield rows(now, held)


class Shard:
    """One shard's index, from its rows in order of ``part``."""

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        layers = []
        for kind, width, data in rows:
            if kind == "ids":
                self.ids = np.frombuffer(data, "<i8")
            elif kind == "rows":
                self.rows = np.frombuffer(data, "<i8")
            elif kind == "node":
                self.node = np.frombuffer(data, "<i4")
            elif kind == "vectors":
                self.vectors = np.frombuffer(data, "<f8").reshape(-1, width)
            else:
                layers.append(np.frombuffer(data, "<i4").reshape(-1, width))
        self.graph = Graph(unit(self.vectors), layers)
        self.order = np.argsort(self.node, kind="stable")  # ids of a node in id order
        self.first = np.searchsorted(self.node[self.order], np.arange(len(self.vectors) + 1))

    def answer(self, qrows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, vec_id, row and exact score of up to k candidates a query."""
        nodes, _ = self.graph.search(asked(queries), k + 1)
        r, c = np.nonzero(nodes >= 0)
        v = nodes[r, c]
        most = np.minimum(self.first[v + 1] - self.first[v], k + 1)  # k others at most
        r, start, v = np.repeat(r, most), np.repeat(self.first[v], most), np.repeat(v, most)
        at = self.order[start + np.arange(len(start)) - np.repeat(np.cumsum(most) - most, most)]
        ids, rows = self.ids[at], self.rows[at]
        score = np.zeros(len(r))
        for lo in range(0, len(r), 1 << 16):
            score[lo : lo + (1 << 16)] = np.einsum("ed,ed->e", queries[r[lo : lo + (1 << 16)]], self.vectors[v[lo : lo + (1 << 16)]])
        other = rows != qrows[r]
        r, ids, rows, score = r[other], ids[other], rows[other], score[other]
        order = np.lexsort((rows, ids, -score, r))
        r, ids, rows, score = r[order], ids[order], rows[order], score[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[best], ids[best], rows[best], score[best]


def _answers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, shard = None, [], None
        for number, part in _by_shard(batches):
            if number != now:
                now, rows, shard = number, [], None
            ids = part.column(1)
            graph = np.asarray(pa.compute.is_null(ids))
            for x in part.filter(pa.array(graph)).to_pylist():
                rows.append((x["kind"], x["level"], x["data"]))
            block = part.filter(pa.array(~graph))
            for lo in range(0, block.num_rows if rows else 0, BLOCK):
                shard = shard or Shard(rows)
                some = block.slice(lo, BLOCK)
                q, v, w, s = shard.answer(some.column(2).to_numpy(), _matrix(some), k)
                yield pa.RecordBatch.from_pydict({"query_id": some.column(1).to_numpy()[q], "query": some.column(2).to_numpy()[q], "vec_id": v, "row": w, "score": s})

    return run


def neighbours(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of df found for each of
    its rows where ``is_query`` (an expression on vec_id) holds."""
    spark = df.sparkSession
    common.ship(spark)
    rows = common.cut(clean(df, id_col, vector), "vectors")
    n, least, most = rows.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if not n:
        none = rows.limit(0)
        return none.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    if least != most:  # vectors of different length don't meet
        each = [r.d for r in rows.select(F.size("vec").alias("d")).distinct().collect()]
        found = [neighbours(rows.where(F.size("vec") == d), is_query, k, "vec_id", "vec") for d in sorted(each)]
        return functools.reduce(DataFrame.unionByName, found)
    queries = rows.where(is_query)
    cells = fit_cells(rows, n)
    near = probes(rows, queries, cells, k)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(cells.cell(_matrix(b))), b.column(0), b.column(1), b.column(2)], ["cell", "vec_id", "vec", "row"])

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                to = cells.ranks(_matrix(part))[:, :near]
                yield part.append_column("cells", pa.array(list(to.astype(np.int32)), pa.list_(pa.int32())))

    # Of one vector's rows the k + 1 smallest ids: partial limits run before the exchange.
    same = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("vec_id", "row")
    held = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).select("vec_id", "vec", "row")
    dealt = common.cut(held.mapInArrow(cell, "cell int, vec_id long, vec array<double>, row long"), "cells")
    sizes = common.fetch(dealt.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell"))  # a row a cell
    parts = np.ones(len(cells.centroids), np.int64)
    parts[sizes["cell"]] = -(-sizes["n"] // SHARD_ROWS)
    first = np.cumsum(parts) - parts
    of = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(len(parts))], "cell int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("vec"), F.col("parts"))).cast("int").alias("shard")
    dealt = dealt.join(F.broadcast(of), "cell").select(shard, "vec_id", "row", "vec")  # at most MOST_CELLS rows
    index = common.cut(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, INDEX), "graph")

    asks = queries.mapInArrow(routes, "vec_id long, vec array<double>, row long, cells array<int>")
    asks = asks.select("vec_id", "row", "vec", F.explode("cells").alias("cell")).join(F.broadcast(of), "cell")
    asks = asks.select(F.explode(F.expr("sequence(first, first + parts - 1)")).alias("shard"), "vec_id", "row", "vec")
    # A shard that many queries ask is read by several tasks.
    blocks = asks.groupBy("shard").agg(F.ceil(F.count("*") / TASK_QUERIES).cast("int").alias("blocks"))
    asks = asks.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.col("blocks")).cast("int"))
    graphs = index.join(blocks, "shard").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    none = lambda kind: F.lit(None).cast(kind)
    left = graphs.select("shard", none("long").alias("vec_id"), none("long").alias("row"), none("array<double>").alias("vec"), "part", "kind", "level", "data", "block")
    right = asks.select("shard", "vec_id", "row", "vec", none("int").alias("part"), none("string").alias("kind"), none("int").alias("level"), none("binary").alias("data"), "block")
    # Nulls come first: a shard's arrays stand before its queries.
    both = left.unionByName(right).repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("vec_id").asc_nulls_first(), "part")
    found = both.withColumn("shard", F.expr("cast(shard as long) * 1048576 + block")).mapInArrow(_answers(k), "query_id long, query long, vec_id long, row long, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
