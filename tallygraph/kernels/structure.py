"""numpy kernels of one graph: bridges, odd cycles, matchings, colourings, symmetry,
edge betweenness, covers, layered rewiring."""

from __future__ import annotations

import heapq

import numpy as np

from tallygraph.kernels.graphs import Csr, balls, bfs, swaps


class Sets:
    """Union-find with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, v: int) -> int:
        up = self.up
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def lists(g: Csr) -> list[list[int]]:
    return [g.of(v).tolist() for v in range(g.n)]


def bridges(g: Csr) -> list[tuple[int, int]]:
    """Edges on no cycle, by depth-first low points, without recursion."""
    near, seen, low, out, clock = lists(g), [-1] * g.n, [0] * g.n, [], 0
    for root in range(g.n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            v, up, it = stack[-1]
            for w in it:
                if w == up:
                    continue
                if seen[w] < 0:
                    seen[w] = low[w] = clock
                    clock += 1
                    stack.append((w, v, iter(near[w])))
                    break
                low[v] = min(low[v], seen[w])
            else:
                stack.pop()
                if up >= 0:
                    low[up] = min(low[up], low[v])
                    if low[v] > seen[up]:
                        out.append((min(up, v), max(up, v)))
    return sorted(out)


def odd_cycle(g: Csr) -> list[int]:
    """Vertices of an odd cycle in order, or none if the graph is bipartite: the first
    edge inside a breadth-first level, closed over its ends' nearest common ancestor."""
    near, depth, up = lists(g), [-1] * g.n, [-1] * g.n
    for root in range(g.n):
        if depth[root] >= 0:
            continue
        depth[root], queue = 0, [root]
        for v in queue:
            for w in near[v]:
                if depth[w] < 0:
                    depth[w], up[w] = depth[v] + 1, v
                    queue.append(w)
                elif depth[w] == depth[v]:
                    a, b = [v], [w]
                    while a[-1] != b[-1]:
                        a.append(up[a[-1]])
                        b.append(up[b[-1]])
                    return a + b[-2::-1]
    return []


def blossom(g: Csr) -> list[tuple[int, int]]:
    """A largest matching of any graph (Edmonds): greedy pairs, then alternating trees
    in which odd cycles shrink to their base."""
    near, mate = lists(g), [-1] * g.n
    for v in range(g.n):
        w = next((w for w in near[v] if mate[v] < 0 and mate[w] < 0), -1)
        if w >= 0:
            mate[v], mate[w] = w, v

    def grow(root: int) -> tuple[int, dict[int, int]]:
        came: dict[int, int] = {}
        base: dict[int, int] = {}
        even, queue = {root}, [root]
        top = lambda v: base.get(v, v)

        def meet(a: int, b: int) -> int:
            passed = set()
            while True:
                a = top(a)
                passed.add(a)
                if mate[a] < 0:
                    break
                a = came[mate[a]]
            while top(b) not in passed:
                b = came[mate[top(b)]]
            return top(b)

        def mark(v: int, stem: int, child: int, inside: set) -> None:
            while top(v) != stem:
                inside |= {top(v), top(mate[v])}
                came[v] = child
                child = mate[v]
                v = came[mate[v]]

        for v in queue:
            for w in near[v]:
                if top(v) == top(w) or mate[v] == w:
                    continue
                if w == root or (mate[w] >= 0 and mate[w] in came):
                    stem, inside = meet(v, w), set()
                    mark(v, stem, w, inside)
                    mark(w, stem, v, inside)
                    for x in set(came) | even:
                        if top(x) in inside:
                            base[x] = stem
                            if x not in even:
                                even.add(x)
                                queue.append(x)
                elif w not in came:
                    came[w] = v
                    if mate[w] < 0:
                        return w, came
                    even.add(mate[w])
                    queue.append(mate[w])
        return -1, came

    for root in range(g.n):
        if mate[root] >= 0:
            continue
        v, came = grow(root)
        while v >= 0:
            u = came[v]
            further = mate[u]
            mate[v], mate[u] = u, v
            v = further
    return [(v, w) for v, w in enumerate(mate) if v < w]


def dsatur(g: Csr) -> list[int]:
    """Greedy colours, the most constrained vertex first (ties: degree, then id)."""
    near, colour = lists(g), [-1] * g.n
    barred: list[set] = [set() for _ in range(g.n)]
    # A vertex stands in the heap once for each number of barred colours it had; only the last counts.
    heap = [(0, -len(near[x]), x) for x in range(g.n)]
    heapq.heapify(heap)
    while heap:
        bars, _, v = heapq.heappop(heap)
        if colour[v] >= 0 or -bars != len(barred[v]):
            continue
        colour[v] = c = next(c for c in range(g.n) if c not in barred[v])
        for w in near[v]:
            if colour[w] < 0 and c not in barred[w]:
                barred[w].add(c)
                heapq.heappush(heap, (-len(barred[w]), -len(near[w]), w))
    return colour


def chromatic(g: Csr, most: int = 8) -> int:
    """The fewest colours of a small graph by backtracking, a new colour at each level
    tried once; ``most`` + 1 if more are needed than ``most``."""
    near, greedy = [set(x) for x in lists(g)], dsatur(g)
    upper = max(greedy, default=-1) + 1

    def fits(k: int) -> bool:
        colour: dict[int, int] = {}

        def go(used: int) -> bool:
            if len(colour) == g.n:
                return True
            bar = lambda x: {colour[w] for w in near[x] if w in colour}
            v = max((x for x in range(g.n) if x not in colour), key=lambda x: (len(bar(x)), len(near[x]), -x))
            for c in range(min(used + 1, k)):
                if c not in bar(v):
                    colour[v] = c
                    if go(max(used, c + 1)):
                        return True
                    del colour[v]
            return False

        return go(0)

    for k in range(0, min(upper, most + 1)):
        if fits(k):
            return k
    return min(upper, most + 1)


def refine(near: list[list[int]], colour: list) -> list[int]:
    """Stable colours: split by own and neighbours' colours until nothing splits. Numbers
    come from the sorted splits, so equal structures get equal numbers."""
    count = len(set(colour))
    while True:
        key = [(colour[v], tuple(sorted(colour[w] for w in near[v]))) for v in range(len(near))]
        rank = {k: i for i, k in enumerate(sorted(set(key)))}
        colour = [rank[k] for k in key]
        if len(rank) == count:
            return colour
        count = len(rank)


def maps(near: list[list[int]], adjacent: list[set], a: list, b: list) -> bool:
    """Whether an automorphism takes colours a to colours b."""
    a, b = refine(near, a), refine(near, b)
    if sorted(a) != sorted(b):
        return False
    cells: dict[int, list[int]] = {}
    for v, c in enumerate(a):
        cells.setdefault(c, []).append(v)
    wide = next((c for c in sorted(cells) if len(cells[c]) > 1), None)
    if wide is None:
        to = {c: v for v, c in enumerate(b)}
        image = [to[c] for c in a]
        return all(image[w] in adjacent[image[v]] for v in range(len(near)) for w in near[v])
    x = pinned(a, cells[wide][0])
    return any(maps(near, adjacent, x, pinned(b, v)) for v, c in enumerate(b) if c == wide)


def pinned(colour: list, v: int) -> list:
    """The colours with one of v alone."""
    out = [2 * c for c in colour]
    out[v] += 1
    return out


def symmetry(g: Csr) -> tuple[int, list[int]]:
    """Order of the automorphism group and each vertex's orbit (its least vertex), for
    small graphs: vertices are fixed one by one, and the order is the product of the
    orbit sizes in the stabilisers."""
    near = lists(g)
    adjacent = [set(x) for x in near]

    def orbit(colour: list, v: int) -> list[int]:
        return [w for w in range(g.n) if colour[w] == colour[v] and (w == v or maps(near, adjacent, pinned(colour, v), pinned(colour, w)))]

    colour, order = refine(near, [0] * g.n), 1
    orbits, start = [-1] * g.n, colour
    for v in range(g.n):
        if orbits[v] < 0:
            for w in orbit(start, v):
                orbits[w] = v
    while len(set(colour)) < g.n:
        v = next(v for v in range(g.n) if colour.count(colour[v]) > 1)
        order *= len(orbit(colour, v))
        colour = refine(near, pinned(colour, v))
    return order, orbits


def edge_orbits(g: Csr) -> list[tuple[int, int, int]]:
    """(u, v, orbit) of each edge u < v: the number of the first edge, in order, that an
    automorphism takes to it."""
    near = lists(g)
    adjacent = [set(x) for x in near]
    start = refine(near, [0] * g.n)
    edges = [(u, v) for u in range(g.n) for v in near[u] if u < v]
    two = lambda u, v: pinned(pinned(start, u), v)
    firsts: list[int] = []
    out = []
    for i, (u, v) in enumerate(edges):
        kind = sorted((start[u], start[v]))
        for j in firsts:
            x, y = edges[j]
            if sorted((start[x], start[y])) == kind and any(maps(near, adjacent, two(x, y), two(p, q)) for p, q in ((u, v), (v, u))):
                out.append((u, v, j))
                break
        else:
            firsts.append(i)
            out.append((u, v, i))
    return out


def edge_brandes(g: Csr, sources) -> np.ndarray:
    """Dependencies of each place of ``g.near`` (an edge from one end), summed over sources."""
    total, owner = np.zeros(len(g.near)), np.repeat(np.arange(g.n), g.degree)
    for s in sources:
        d = bfs(g, s)
        down = (d[owner] >= 0) & (d[g.near] == d[owner] + 1)
        sigma, delta = np.zeros(g.n), np.zeros(g.n)
        sigma[s] = 1
        steps = [np.flatnonzero(down & (d[owner] == i)) for i in range(d.max())]
        for e in steps:
            np.add.at(sigma, g.near[e], sigma[owner[e]])
        for e in reversed(steps):
            part = sigma[owner[e]] / sigma[g.near[e]] * (1 + delta[g.near[e]])
            total[e] += part
            np.add.at(delta, owner[e], part)
    return total


def spanning(n: int, src, dst, weight) -> np.ndarray:
    """Places of the edges of a heaviest spanning forest, ties to the earlier edge."""
    sets = Sets(n)
    order = np.argsort(-np.asarray(weight, float), kind="stable")
    return np.sort(np.array([i for i in order.tolist() if sets.join(int(src[i]), int(dst[i]))], np.int64))


def random_cover(g: Csr, reach: int, seed: int) -> np.ndarray:
    """Box of each vertex: balls of distance up to ``reach`` around vertices in random
    order take what is still uncovered; covered vertices still pass a ball on."""
    box, count = np.full(g.n, -1), 0
    for v in np.random.default_rng(seed).permutation(g.n):
        if box[v] < 0:
            d = bfs(g, int(v))
            box[(d >= 0) & (d <= reach) & (box < 0)] = count
            count += 1
    return box


def random_boxes(g: Csr, length: int, seed: int) -> int:
    """Boxes of a random cover by balls of distance below ``length``."""
    return int(random_cover(g, length - 1, seed).max(initial=-1)) + 1


def mass_cover(g: Csr, radius: int, seed: int) -> tuple[list[int], np.ndarray]:
    """Centres of the maximal-excluded-mass cover, and each vertex's box by its centre:
    outwards from the centres, a vertex takes the box of a random neighbour that is one
    step nearer to the centres than itself."""
    ball, free, centres = balls(g, radius), np.ones(g.n, bool), []
    mass = ball.sum(1)
    while free.any():
        c = int(np.argmax(mass))
        centres.append(c)
        gone = ball[c] & free
        free &= ~gone
        mass -= ball[:, gone].sum(1)
    rng, box, d = np.random.default_rng(seed), np.full(g.n, -1), np.full(g.n, -1)
    box[centres], d[centres], level = centres, 0, np.array(centres, np.int64)
    while len(level):
        near = np.unique(g.spread(level)[1])
        level = near[d[near] < 0]
        d[level] = d[box >= 0].max(initial=0) + 1
        for v in level.tolist():
            from_ = g.of(v)
            box[v] = box[rng.choice(from_[(d[from_] >= 0) & (d[from_] < d[v])])]
    return centres, box


def local_efficiency(g: Csr, v: int) -> float:
    """Mean 1 / d over ordered pairs of v's neighbours inside the graph they induce."""
    near = g.of(v)
    k = len(near)
    if k < 2:
        return 0.0
    at = np.full(g.n, -1)
    at[near] = np.arange(k)
    row, other = g.spread(near)
    inside = at[other] >= 0
    ego = Csr(k, *np.array([(a, b) for a, b in zip(row[inside], at[other[inside]]) if a < b], np.int64).reshape(-1, 2).T)
    total = 0.0
    for x in range(k):
        d = bfs(ego, x)
        total += (1 / d[d > 0]).sum()
    return total / (k * (k - 1))


def ego_paths(v, a, b) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sums of 1 / d over ordered pairs) of graphs side by side: edge (a, b) stands in the graph of v. 64 sources of
    each graph walk at once, a bit each."""
    owner, of = np.unique(v, return_inverse=True)
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = np.concatenate([of, of])
    spot, ends = np.unique(own * len(names) + at, return_inverse=True)
    x, y = np.concatenate([ends[: len(a)], ends[len(a) :]]), np.concatenate([ends[len(a) :], ends[: len(a)]])
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    graph = spot // max(1, len(names))
    first = np.searchsorted(graph, np.arange(len(owner)))
    local, size = np.arange(len(spot)) - first[graph], np.bincount(graph, minlength=len(owner))
    total = np.zeros(len(owner))
    for p in range(0, int(size.max(initial=0)), 64):
        on = size[graph] > p  # graphs without so many vertices are done
        rename = np.cumsum(on) - 1
        ex, ey = rename[x[on[x]]], rename[y[on[x]]]
        begin = np.flatnonzero(np.r_[True, ex[1:] != ex[:-1]])  # each vertex has an edge
        place, g = local[on], graph[on]
        seen = np.where((place >= p) & (place < p + 64), np.uint64(1) << (place - p).clip(0, 63).astype(np.uint64), np.uint64(0))
        front, d = seen, 0
        while front.any():
            d += 1
            front = np.bitwise_or.reduceat(front[ey], begin) & ~seen
            seen = seen | front
            total += np.bincount(g, np.bitwise_count(front), len(owner)) / d
    return owner, total


def layer_swaps(n: int, src, dst, colour, seed: int, times: int = 10, tries: int = 25):
    """Rewiring inside each pair of colours, which keeps every vertex's degree towards
    every colour: the ends of one colour stay where they are, the others change."""
    low, high = np.minimum(colour[src], colour[dst]), np.maximum(colour[src], colour[dst])
    turn = colour[src] > colour[dst]
    a, b = np.where(turn, dst, src), np.where(turn, src, dst)
    out = [np.zeros((0, 2), np.int64)]
    for i, pair in enumerate(sorted(set(zip(low.tolist(), high.tolist())))):
        on = (low == pair[0]) & (high == pair[1])
        out.append(np.stack(swaps(n, a[on], b[on], seed + i, times, tries, pair[0] == pair[1]), 1))
    e = np.concatenate(out)
    e = e[np.lexsort((e[:, 1], e[:, 0]))]
    return e[:, 0], e[:, 1]


def connected_swaps(n: int, src, dst, seed: int, attempts: int = 8):
    """The first connected of some rewirings, else the one of the largest component."""
    best, size = None, -1
    for i in range(attempts):
        a, b = swaps(n, src, dst, seed * attempts + i)
        sets = Sets(n)
        for x, y in zip(a.tolist(), b.tolist()):
            sets.join(x, y)
        largest = int(np.bincount([sets.find(v) for v in range(n)], minlength=1).max()) if n else 0
        if largest > size:
            best, size = (a, b), largest
        if size == n:
            break
    return best


def closure(n: int, src, dst, colour, quota: int, beta: float, seed: int, loose: float = 0.0, rounds: int = 24, block=None):
    """Random legal wedges: a centre in proportion to degree ^ beta, two of its
    neighbours; pairs that are joined already or drawn before are dropped, as are those
    of two blocks, and those of one colour but for a share ``loose``. Returns the new
    edges and, for each round, how many were drawn, legal, stopped by colour alone, and
    taken."""
    rng, have, taken, record = np.random.default_rng(seed), set(zip(src.tolist(), dst.tolist())), [], []
    g = Csr(n, src, dst)
    mass = np.where(g.degree > 1, g.degree.astype(float) ** beta, 0.0)
    if not mass.sum():
        return np.zeros((0, 2), np.int64), []
    for r in range(rounds):
        rest = quota - len(taken)
        if rest <= 0:
            break
        draws = 3 * rest + 10
        c = rng.choice(n, draws, p=mass / mass.sum())
        i = (rng.random(draws) * g.degree[c]).astype(np.int64)
        j = (rng.random(draws) * (g.degree[c] - 1)).astype(np.int64)
        u, v = g.near[g.first[c] + i], g.near[g.first[c] + j + (j >= i)]
        pass_ = rng.random(draws) < loose
        legal = stopped = before = 0
        before = len(taken)
        for a, b, ok in zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), pass_.tolist()):
            if (a, b) in have or (block is not None and block[a] != block[b]):
                continue
            if colour[a] == colour[b] and not ok:
                stopped += 1
                continue
            legal += 1
            if len(taken) < quota:
                have.add((a, b))
                taken.append((a, b))
        record.append((r, draws, legal, stopped, len(taken) - before))
    return np.array(taken, np.int64).reshape(-1, 2), record


def merge_small(size: dict[int, int], weight: dict[tuple[int, int], float], target: int) -> dict[int, int]:
    """Labels joined until ``target`` are left: the smallest label goes to the partner of
    highest weight over the product of the sizes (ties to smaller labels)."""
    size, into = dict(size), {v: v for v in size}
    links: dict[int, dict[int, float]] = {v: {} for v in size}
    for (a, b), w in weight.items():
        links[a][b] = links[b][a] = links[a].get(b, 0.0) + w
    while len(size) > target:
        some = [v for v in size if links[v]]
        if not some:
            break
        a = min(some, key=lambda v: (size[v], v))
        _absorb(max(links[a], key=lambda v: (links[a][v] / (size[a] * size[v]), -v)), a, size, links, into)
    return _settled(into)


def merge_dense(size: dict[int, int], weight: dict[tuple[int, int], float], target: int) -> dict[int, int]:
    """Labels joined until ``target`` are left: always the pair of highest weight over the
    product of its sizes, from a heap whose stale entries are passed over."""
    import heapq

    size, into = dict(size), {v: v for v in size}
    links: dict[int, dict[int, float]] = {v: {} for v in size}
    for (a, b), w in weight.items():
        links[a][b] = links[b][a] = links[a].get(b, 0.0) + w
    density = lambda a, b: links[a][b] / (size[a] * size[b])
    heap = [(-density(a, b), a, b) for a in links for b in links[a] if a < b]
    heapq.heapify(heap)
    while len(size) > target and heap:
        d, a, b = heapq.heappop(heap)
        if a not in size or b not in size or b not in links[a] or -density(a, b) != d:
            continue
        _absorb(a, b, size, links, into)
        for c in links[a]:
            heapq.heappush(heap, (-density(a, c), min(a, c), max(a, c)))
    return _settled(into)


def _absorb(a: int, b: int, size: dict, links: dict, into: dict) -> None:
    """b becomes part of a."""
    for c, w in links.pop(b).items():
        del links[c][b]
        if c != a:
            links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
    size[a] += size.pop(b)
    into[b] = a


def _settled(into: dict[int, int]) -> dict[int, int]:
    out = {}
    for v in into:
        w = v
        while into[w] != w:
            w = into[w]
        out[v] = w
    return out
