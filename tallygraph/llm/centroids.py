"""Centroid clustering in exact integers by kd-tree filtering.

Vectors of ``dim`` components become integers floor(256 * x).  Each scan partition
builds kd-trees once, of at most BLOCK vectors, and writes them; a round sends the
centroids to all trees (k rows, a parameter) and gets from each task one row a
centroid: a count and integer sums, which one more aggregation adds up.  Inside a tree
all nodes of a level are filtered at once: of a node's candidates, the one nearest to
the middle of its box strictly dominates another if it is nearer at every corner of the
box, for which the corner farthest towards the other speaks; a node left with one
candidate is assigned whole, from its count and sum; a leaf with several is resolved
point by point, ties to the smaller number.  No float decides anything.

Defined cases: a vector that is null, of another length, or holds a null or non-finite
component is left out, and so is one with a component of 2^18 or more in size, whose
squared distances would not fit a long; with fewer than k vectors each is a centroid;
repeated rows are rows of their own; null ids never start as centroids before others
(their hash is null and sorts last) and are returned as null; among equal ids the
smaller vector starts first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common, trees

#: Vectors of one tree.
BLOCK = 8_192
#: Nodes filtered at once: bounds the (node, centroid, component) arrays.
NODES = 128
#: Size of a component; corners of boxes, differences and squares stay below 2^62.
MOST = 1 << 26
ROWS = "vec_id long, cluster int, distance long"


def _filtered(tree: trees.Tree, centroids: np.ndarray):
    """Yields (nodes, cluster) assigned whole, then (nodes, candidates) of open leaves:
    candidates is a boolean row a node."""
    k = len(centroids)
    norm = (centroids * centroids).sum(1)
    nodes, live = np.zeros(1, np.int64), np.ones((1, k), bool)
    while len(nodes):
        after, kept = [], []
        for at in range(0, len(nodes), NODES):
            node, may = nodes[at : at + NODES], live[at : at + NODES].copy()
            low, high = tree.low[node], tree.high[node]
            # Twice the distance from the box's middle, up to what all candidates share.
            near = 4 * norm[None] - 4 * trees.products(low + high, centroids)
            best = np.where(may, near, np.iinfo(np.int64).max).argmin(1)
            toward = centroids[best][:, None, :] - centroids[None]
            corner = np.where(toward < 0, high[:, None, :], low[:, None, :])
            # Least lead of the best over each other one, over the whole box.
            lead = 2 * (toward * corner).sum(2) + norm[None] - norm[best][:, None]
            may &= lead <= 0
            may[np.arange(len(node)), best] = True
            one = may.sum(1) == 1
            if one.any():
                yield node[one], best[one], None
            leaf = ~one & (tree.child[node] == 0)
            if leaf.any():
                yield node[leaf], None, may[leaf]
            more = ~one & ~leaf
            left = tree.child[node[more]]
            after.append(np.stack([left, left + 1], 1).ravel())
            kept.append(np.repeat(may[more], 2, 0))
        nodes, live = np.concatenate(after), np.concatenate(kept)


def _resolved(tree: trees.Tree, nodes: np.ndarray, may: np.ndarray, centroids: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the tree's order of all points of open leaves, and their clusters."""
    size = tree.count[nodes]
    place = np.repeat(tree.start[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    cluster = np.zeros(len(place), np.int64)
    allowed = np.repeat(may, size, 0)
    for at in range(0, len(place), BLOCK):
        d = norm[None] - 2 * trees.products(tree.points[place[at : at + BLOCK]], centroids)
        cluster[at : at + BLOCK] = np.where(allowed[at : at + BLOCK], d, np.iinfo(np.int64).max).argmin(1)
    return place, cluster


def sums(tree: trees.Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and component sums of each centroid's points of a tree."""
    n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    norm = (centroids * centroids).sum(1)
    for nodes, cluster, may in _filtered(tree, centroids):
        if may is None:
            np.add.at(n, cluster, tree.count[nodes])
            np.add.at(total, cluster, tree.sum[nodes])
        else:
            place, cluster = _resolved(tree, nodes, may, centroids, norm)
            np.add.at(n, cluster, 1)
            np.add.at(total, cluster, tree.points[place])
    return n, total


def assigned(tree: trees.Tree, centroids: np.ndarray) -> np.ndarray:
    """Cluster of each point, in the tree's order."""
    out = np.zeros(len(tree.points), np.int64)
    norm = (centroids * centroids).sum(1)
    for nodes, cluster, may in _filtered(tree, centroids):
        if may is None:
            for i, c in zip(nodes, cluster):
                out[tree.start[i] : tree.end[i]] = c
        else:
            place, cluster = _resolved(tree, nodes, may, centroids, norm)
            out[place] = cluster
    return out


def _pack(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
    """A block as one row: ids, points and the arrays of its tree."""
    tree = trees.Tree(points)
    held = {x: getattr(tree, x).astype("<i8").tobytes() for x in ("points", "start", "end", "child", "low", "high", "sum")}
    return pa.RecordBatch.from_pydict({"ids": pa.array([ids.take(pa.array(tree.order)).to_pylist()], pa.list_(pa.int64())), **{k: pa.array([v], pa.large_binary()).cast(pa.binary()) for k, v in held.items()}})


PACKED = "ids array<long>, points binary, start binary, end binary, child binary, low binary, high binary, sum binary"


def _unpack(row: dict, dim: int) -> trees.Tree:
    tree = trees.Tree.__new__(trees.Tree)
    for k in ("start", "end", "child"):
        setattr(tree, k, np.frombuffer(row[k], "<i8"))
    for k in ("points", "low", "high", "sum"):
        setattr(tree, k, np.frombuffer(row[k], "<i8").reshape(-1, dim))
    return tree


def build(rows: DataFrame) -> DataFrame:
    """Trees over the rows (vec_id, v) of each partition, in blocks."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                some, rest = whole.slice(0, BLOCK), whole.slice(BLOCK)
                yield _pack(some.column(0), trees.matrix(some.column(1)))
                held, n = [rest], rest.num_rows
        if n:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield _pack(whole.column(0), trees.matrix(whole.column(1)))

    return rows.mapInArrow(run, PACKED)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared) to its centroid, cluster_inertia, inertia and
    centroid_sha256 of each vector that takes part, after ``rounds`` rounds from the k
    vectors whose ids have the smallest sha256 of ``seed:id``."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), trees.whole(vector, MOST).alias("v")).where(F.size("v") == dim)
    packed = common.cut(build(rows), "trees")
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k)
    centroids = np.array([r.v for r in first.collect()], np.int64).reshape(-1, dim)  # k rows
    if not len(centroids):
        return spark.createDataFrame([], f"{ROWS}, cluster_inertia long, inertia long, centroid_sha256 string")

    def counted(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    got = sums(_unpack(batch.slice(i, 1).to_pylist()[0], dim), now)
                    n, total = n + got[0], total + got[1]
            some = np.flatnonzero(n)
            values = np.concatenate([n[some, None], total[some]], 1)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(some.astype(np.int32)), "x": pa.array(values.tolist(), pa.list_(pa.int64()))})

        return run

    for _ in range(rounds):
        parts = packed.drop("ids").mapInArrow(counted(centroids), "cluster int, x array<long>").select("cluster", F.posexplode("x").alias("j", "x"))
        got = common.fetch(parts.groupBy("cluster", "j").agg(F.sum("x").alias("x")))  # k * (dim + 1) rows
        total = np.zeros((len(centroids), dim + 1), np.int64)
        total[got["cluster"], got["j"]] = got["x"]
        some = total[:, 0] > 0
        centroids = centroids.copy()
        centroids[some] = total[some, 1:] // total[some, :1]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tree = _unpack(row.drop_columns(["ids"]).to_pylist()[0], dim)
                at = assigned(tree, centroids)
                off = tree.points - centroids[at]
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), pa.array(at.astype(np.int32)), pa.array((off * off).sum(1))], ["vec_id", "cluster", "distance"])

    out = common.cut(packed.mapInArrow(last, ROWS), "assigned")
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    total = sum(r.s for r in inertia)
    of = spark.createDataFrame([(r.cluster, r.s, total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
