"""Kd-trees over integer vectors, as flat arrays: what operators 11 and 12 share.

A tree orders its points so that every node holds a run of them.  Nodes carry their
run, children, bounding box, count and the sum of their points, all exact integers.
Nodes stand parents first, so a pass over levels needs no recursion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a leaf; a node whose points are all equal is a leaf of any size.
LEAF = 32
#: A node is cut at the middle of its box if the smaller side gets one in so many points, else at their median.
SIDE = 16
#: Whole numbers below this stand in a double exactly.
EXACT = 1 << 53


def whole(vector: str, most: int) -> Column:
    """floor(256 * x) of each component as array<long>; null where the vector is null
    or empty, holds a null or non-finite component, or one of at least ``most`` in
    size, whose products would not fit a long."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(most / 256.0)))
    return F.when((F.size(x) > 0) & fine, F.transform(x, lambda v: F.floor(v * 256.0).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in doubles where no partial sum can be rounded."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Tree:
    """``order`` lists the rows of ``points`` by node; node i holds ``order[start[i]:end[i]]``,
    its children are ``child[i]`` and ``child[i] + 1`` (0 marks a leaf)."""

    def __init__(self, points: np.ndarray, label: np.ndarray | None = None, leaf: int = LEAF):
        """With labels, nodes of several labels are cut between labels first."""
        n = len(points)
        order = np.arange(n)
        if label is not None:
            order = np.argsort(label, kind="stable")
        start, end, child, low, high = [0], [n], [0], [], []
        i = 0
        while i < len(start):
            a, b = start[i], end[i]
            held = points[order[a:b]]
            lo, hi = held.min(0), held.max(0)
            low.append(lo)
            high.append(hi)
            cut = 0
            if label is not None and label[order[a]] != label[order[b - 1]]:
                edges = a + 1 + np.flatnonzero(np.diff(label[order[a:b]]))
                cut = int(edges[np.abs(edges - (a + b) // 2).argmin()])
            elif b - a > leaf and (hi > lo).any():
                axis = int((hi - lo).argmax())
                right = held[:, axis] > (lo[axis] + hi[axis]) // 2
                few = int(right.sum())
                if min(few, b - a - few) * SIDE >= b - a:  # the box's middle parts clusters
                    order[a:b] = np.concatenate([order[a:b][~right], order[a:b][right]])
                    cut = b - few
                else:
                    cut = (a + b) // 2
                    order[a:b] = order[a:b][np.argpartition(held[:, axis], cut - a)]
            if cut:
                child[i] = len(start)
                start += [a, cut]
                end += [cut, b]
                child += [0, 0]
            i += 1
        self.order, self.points = order, points[order]
        self.start, self.end, self.child = (np.array(x, np.int64) for x in (start, end, child))
        self.low, self.high = np.array(low), np.array(high)
        run = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, 0)])
        self.sum = run[self.end] - run[self.start]
        if label is not None:
            self.label = label[order]
            self.first_label, self.last_label = self.label[self.start], self.label[self.end - 1]

    @property
    def count(self) -> np.ndarray:
        return self.end - self.start
