"""numpy kernels for what is sequential or dense: each runs inside one task on one
graph of bounded size, and the ensemble (seed, resolution, source) is the rows."""

from __future__ import annotations

import numpy as np


class Csr:
    """Neighbours of vertex v: near[first[v] : first[v + 1]], vertices 0..n-1."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
        order = np.lexsort((b, a))
        self.n, self.near = n, b[order]
        self.first = np.searchsorted(a[order], np.arange(n + 1))
        self.degree = np.diff(self.first)

    def of(self, v: int) -> np.ndarray:
        return self.near[self.first[v] : self.first[v + 1]]

    def spread(self, vs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in vs, neighbour) of all neighbours of vs."""
        size = self.degree[vs]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[vs], size)
        return np.repeat(np.arange(len(vs)), size), self.near[at]


def bfs(g: Csr, source: int) -> np.ndarray:
    """Distances, -1 where unreachable."""
    d = np.full(g.n, -1)
    d[source], level, step = 0, np.array([source]), 0
    while len(level):
        step += 1
        near = np.unique(g.spread(level)[1])
        level = near[d[near] < 0]
        d[level] = step
    return d


def waves(g: Csr, sources: np.ndarray):
    """For each distance 1, 2, ...: a word for each vertex whose bit j tells that the
    j-th of at most 64 sources reaches it first there. All sources walk in one pass over
    the edges a step."""
    some = np.flatnonzero(g.degree)
    seen = np.zeros(g.n, np.uint64)
    np.bitwise_or.at(seen, sources, np.uint64(1) << np.arange(len(sources), dtype=np.uint64))
    front = seen.copy()
    while len(some):
        got = np.zeros(g.n, np.uint64)
        got[some] = np.bitwise_or.reduceat(front[g.near], g.first[some])
        front = got & ~seen
        if not front.any():
            return
        seen |= front
        yield front


def reach_counts(g: Csr, sources: np.ndarray) -> np.ndarray:
    """Ordered pairs from the sources by distance, 0 at distance 0."""
    out = [0]
    for lo in range(0, len(sources), 64):
        for d, front in enumerate(waves(g, sources[lo : lo + 64]), 1):
            if d == len(out):
                out.append(0)
            out[d] += int(np.bitwise_count(front).sum())
    return np.array(out, np.int64)


def balls(g: Csr, radius: int) -> np.ndarray:
    """Booleans (n, n): is the column within ``radius`` of the row?"""
    out = np.eye(g.n, dtype=bool)
    for lo in range(0, g.n, 64):
        sources = np.arange(lo, min(g.n, lo + 64))
        for d, front in enumerate(waves(g, sources), 1):
            if d > radius:
                break
            out[sources] |= (front[None, :] >> np.arange(len(sources), dtype=np.uint64)[:, None] & np.uint64(1)).astype(bool)
    return out


def brandes(g: Csr, sources: np.ndarray) -> np.ndarray:
    """Dependencies of every vertex summed over the sources (unweighted)."""
    total = np.zeros(g.n)
    for s in sources:
        d, sigma = np.full(g.n, -1), np.zeros(g.n)
        d[s], sigma[s] = 0, 1.0
        levels = [np.array([s])]
        while len(levels[-1]):
            at, near = g.spread(levels[-1])
            fresh = np.unique(near[d[near] < 0])
            d[fresh] = len(levels)
            on = d[near] == len(levels)
            np.add.at(sigma, near[on], sigma[levels[-1][at[on]]])
            levels.append(fresh)
        delta = np.zeros(g.n)
        for level in reversed(levels[:-1]):
            at, near = g.spread(level)
            on = d[near] == d[level[at]] + 1
            np.add.at(delta, level[at[on]], sigma[level[at[on]]] / sigma[near[on]] * (1 + delta[near[on]]))
        delta[s] = 0
        total += delta
    return total


def louvain(n: int, src: np.ndarray, dst: np.ndarray, gamma: float = 1.0, seed: int = 0, potts: bool = False) -> np.ndarray:
    """Labels 0..k-1 by local moves and aggregation until the objective stops growing:
    modularity, or with ``potts`` the constant Potts model, in which a label of s
    vertices pays gamma s^2 / 2 whatever its degrees."""
    rng = np.random.default_rng(seed)
    member = np.arange(n)
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    w, size = np.ones(len(a)), np.ones(n)
    total = w.sum()
    while total:
        order = np.argsort(a, kind="stable")
        a, b, w = a[order], b[order], w[order]
        k = int(max(member.max() + 1, 1))
        first = np.searchsorted(a, np.arange(k + 1))
        strength = size if potts else np.bincount(a, w, k)
        scale = gamma if potts else gamma / total
        label, mass = np.arange(k), strength.copy()
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in rng.permutation(k):
                near, weight = b[first[v] : first[v + 1]], w[first[v] : first[v + 1]]
                other = near != v
                if not other.any():
                    continue
                old = label[v]
                mass[old] -= strength[v]
                labels, inverse = np.unique(np.append(label[near[other]], old), return_inverse=True)
                links = np.bincount(inverse, np.append(weight[other], 0.0))
                gain = links - scale * strength[v] * mass[labels]
                best = labels[np.argmax(gain)]
                if gain.max() <= gain[np.searchsorted(labels, old)] + 1e-12:
                    best = old
                mass[best] += strength[v]
                if best != old:
                    label[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        label = np.unique(label, return_inverse=True)[1]
        member, size = label[member], np.bincount(label, size)
        key = label[a] * (label.max() + 1) + label[b]
        keys, inverse = np.unique(key, return_inverse=True)
        w = np.bincount(inverse, w)
        a, b = keys // (label.max() + 1), keys % (label.max() + 1)
    return np.unique(member, return_inverse=True)[1]


def swaps(n: int, src: np.ndarray, dst: np.ndarray, seed: int, times: int = 10, tries: int = 25, turns: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Degree-preserving rewiring: pairs of edges exchange ends, ``times`` successes
    an edge, in at most ``tries`` attempts an edge; simple graphs stay simple. A round
    pairs all edges at random; a pair stays as it is if it would make a loop, an edge
    there was before the round, or one that another pair makes too. Without ``turns`` an
    edge's first end stays a first end."""
    rng = np.random.default_rng(seed)
    u, v, m = src.astype(np.int64).copy(), dst.astype(np.int64).copy(), len(src)
    half, done, width = m // 2, 0, np.int64(max(n, 1))
    code = lambda p, q: np.minimum(p, q) * width + np.maximum(p, q)
    keys = code(u, v)
    for _ in range(2 * tries if half else 0):
        if done >= times * m:
            break
        order = rng.permutation(m)
        x, y = order[:half], order[half : 2 * half]
        turn = rng.integers(0, 2, half).astype(bool) & turns
        a, b, c, d = u[x], v[x], np.where(turn, v[y], u[y]), np.where(turn, u[y], v[y])
        p, q = code(a, d), code(c, b)
        held = np.sort(keys)
        new = lambda k: held[np.minimum(np.searchsorted(held, k), m - 1)] != k
        ok = np.flatnonzero((a != d) & (c != b) & (p != q) & new(p) & new(q))
        _, at, count = np.unique(np.concatenate([p[ok], q[ok]]), return_inverse=True, return_counts=True)
        alone = count[at] == 1
        ok = ok[alone[: len(ok)] & alone[len(ok) :]][: times * m - done]
        u[x[ok]], v[x[ok]], u[y[ok]], v[y[ok]] = a[ok], d[ok], c[ok], b[ok]
        keys[x[ok]], keys[y[ok]] = p[ok], q[ok]
        done += len(ok)
    return np.minimum(u, v), np.maximum(u, v)


def rich_club(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """phi(k) for k = 0, 1, ... while two vertices have more than k."""
    degree = np.bincount(np.concatenate([src, dst]), minlength=n)
    low = np.minimum(degree[src], degree[dst])
    k = np.arange(degree.max() + 1 if n else 0)
    above = n - np.searchsorted(np.sort(degree), k, "right")
    inside = len(low) - np.searchsorted(np.sort(low), k, "right")
    on = above >= 2
    return 2 * inside[on] / (above[on] * (above[on] - 1))


def weighted_rich_club(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """phi(k) by weight: that among vertices of degree above k over that of as many
    heaviest edges, while two vertices have more than k."""
    degree = np.bincount(np.concatenate([src, dst]), minlength=n)
    low = np.minimum(degree[src], degree[dst])
    order = np.argsort(-low, kind="stable")
    inside = np.concatenate([[0.0], np.cumsum(weight[order])])
    top = np.concatenate([[0.0], np.cumsum(np.sort(weight)[::-1])])
    k = np.arange(degree.max() + 1 if n else 0)
    count = np.searchsorted(-low[order], -k, "left")
    above = n - np.searchsorted(np.sort(degree), k, "right")
    count = count[above >= 2]
    return np.where(count > 0, inside[count] / np.maximum(top[count], 1e-300), 0.0)


def cliques(g: Csr, root: int, rank: np.ndarray):
    """The maximal cliques whose first vertex in rank order is root, as lists."""
    if not hasattr(g, "sets"):
        g.sets = [set(g.of(v).tolist()) for v in range(g.n)]
    near = g.sets
    later = {v for v in near[root] if rank[v] > rank[root]}
    stack = [([root], later, near[root] - later)]
    while stack:
        members, cand, gone = stack.pop()
        if not cand:
            if not gone:
                yield members
            continue
        pivot = max(cand | gone, key=lambda x: len(near[x] & cand))
        for v in list(cand - near[pivot]):
            stack.append(([*members, v], cand & near[v], gone & near[v]))
            cand.discard(v)
            gone.add(v)


def by_degree(g: Csr) -> np.ndarray:
    """Rank of each vertex by degree, then id."""
    rank = np.empty(g.n, np.int64)
    rank[np.lexsort((np.arange(g.n), g.degree))] = np.arange(g.n)
    return rank


def matching(left: int, right: int, edges: list[list[int]]) -> int:
    """Largest matching of a bipartite graph by augmenting paths, without recursion."""
    mate = [-1] * right
    size = 0
    for s in range(left):
        seen, stack, came = set(), [(s, iter(edges[s]))], {}
        found = None
        while stack and found is None:
            u, it = stack[-1]
            for v in it:
                if v in seen:
                    continue
                seen.add(v)
                came[v] = u
                if mate[v] < 0:
                    found = v
                else:
                    stack.append((mate[v], iter(edges[mate[v]])))
                break
            else:
                stack.pop()
        if found is None:
            continue
        size += 1
        held = {v: u for v, u in enumerate(mate) if u >= 0 and v in came}
        v = found
        while True:
            u = came[v]
            previous = next((x for x, y in held.items() if y == u), None) if u != s else None
            mate[v] = u
            if u == s:
                break
            v = previous
    return size


def boxes(g: Csr, radius: int) -> int:
    """Boxes of the maximal-excluded-mass cover: centres in order of uncovered mass."""
    ball = balls(g, radius)
    open_, count = np.ones(g.n, bool), 0
    mass = ball.sum(1)
    while open_.any():
        gone = ball[int(np.argmax(mass))] & open_
        open_ &= ~gone
        mass -= ball[:, gone].sum(1)
        count += 1
    return count
