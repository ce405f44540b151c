"""Hard negatives by dual-tree search.

Components become integers floor(256 * x); a score is an integer inner product.  Rows
are range-sorted by (length, label, id) into blocks of about BLOCK rows; anchors
likewise into blocks of ANCHORS.  Every block gets a kd-tree whose upper levels cut
between labels, so most nodes hold one label.  Two searches send each anchor block to
each candidate block: first for the positives, then, when the windows they open are
known, for the negatives.  Both descend the two trees together.  A pair of nodes bounds
all its products by an interval, the narrower of that of the boxes and that of the balls;
if no anchor of the node can use anything in it (nothing above its floor, nothing below
its ceiling, or the wrong label) the whole group of anchors drops the whole group of
candidates.  Leaf pairs that stay are scored exactly, best bound first, while floors rise.
A task holds the candidates' block and one anchor block; it returns the best few of
each anchor, and a window over those merges the blocks.

Positives of an anchor are its ``positives`` first other rows of its label; floors start
at the best leaves.  A negative must lie between ``low`` and ``high`` hundredths of the
positive's score; a floor is that lower end until enough are found, a ceiling the upper.

Of rows equal in label and vector only the first by id can be returned, as many as are asked for
and one more (the anchor itself may be among them), so others leave before blocks are
made: a mass of copies is a few rows.

Defined cases: rows with a null id, label or vector, an empty vector, a null or
non-finite component or one of 2^18 or more in size (products would not fit a long) take
no part; vectors of different length don't meet; repeated rows and rows of one id are rows
of their own, so a row is another's partner even if their ids agree; among rows of one id
order is that of their written place; an anchor without positives, a positive that is not
above zero, save zero itself, has no negatives; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.llm import common, trees

#: Rows of a candidate block, and of an anchor block.
BLOCK, ANCHORS = 16_384, 1_024
#: Size of a component; scores stay below 2^62 for up to 1,024 components.
MOST = 1 << 26
#: Points of an anchor leaf; candidate leaves scored at once.
ANCHOR_LEAF, AT_ONCE = 16, 16
OPEN = np.iinfo(np.int64).min


class Side:
    """A block's tree with what bounds need: middles and radii of its nodes' balls."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, label: np.ndarray, points: np.ndarray, leaf: int):
        self.tree = t = trees.Tree(points, label, leaf)
        self.row, self.id, self.label = rows[t.order], ids[t.order], label[t.order]
        self.points = t.points
        self.mid = (t.low + t.high) / 2.0
        self.half = (t.high - t.low) / 2.0
        far = np.zeros(len(t.start))
        for i, (a, b) in enumerate(zip(t.start, t.end)):
            off = t.points[a:b] - self.mid[i]
            far[i] = np.sqrt((off * off).sum(1).max())
        self.radius = far
        self.length = np.sqrt((self.mid * self.mid).sum(1))
        self.leaf = t.child == 0


def interval(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of any two points of nodes i of a and j of b, rounded outwards."""
    middle = np.einsum("pd,pd->p", a.mid[i], b.mid[j])
    ball = a.length[i] * b.radius[j] + b.length[j] * a.radius[i] + a.radius[i] * b.radius[j]
    box = np.einsum("pd,pd->p", np.abs(a.mid[i]) + a.half[i], b.half[j]) + np.einsum("pd,pd->p", a.half[i], np.abs(b.mid[j]))
    off = np.minimum(ball, box)
    slack = 1e-9 * (np.abs(middle) + (a.length[i] + a.radius[i]) * (b.length[j] + b.radius[j])) + 1
    return middle - off - slack, middle + off + slack


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group: score falling, id and row rising."""
    order = np.lexsort((rows, ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


class Asks:
    """What the anchors of a block ask for: rows (anchor, floor, ceiling, same label?).
    ``anchor`` is a place in the tree's order; an ask keeps its k best."""

    def __init__(self, side: Side, anchor: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, same: bool, k: int):
        order = np.argsort(anchor, kind="stable")
        self.of = order  # the caller's number of each ask
        self.anchor, self.floor, self.ceiling = anchor[order], floor[order].copy(), ceiling[order]
        self.same, self.k, self.side = same, k, side
        self.first = np.searchsorted(self.anchor, side.tree.start)
        self.last = np.searchsorted(self.anchor, side.tree.end)
        self.found = [np.zeros((4, 0), np.int64)]  # ask, score, id, row

    def low(self) -> np.ndarray:
        """Floor of each anchor node: the least of its asks."""
        run = [self.floor[a:b].min() if b > a else np.iinfo(np.int64).max for a, b in zip(self.first, self.last)]
        return np.array(run, np.int64)

    def high(self) -> np.ndarray:
        run = [self.ceiling[a:b].max() if b > a else OPEN for a, b in zip(self.first, self.last)]
        return np.array(run, np.int64)

    def score(self, node: int, other: Side, place: np.ndarray, top: np.ndarray) -> None:
        """Meet the asks of an anchor node with candidates; ``top``: best scores so far, k an ask."""
        a, b = self.first[node], self.last[node]
        asks = np.arange(a, b)
        own = np.unique(self.anchor[a:b])
        s = trees.products(self.side.points[own], other.points[place])[np.searchsorted(own, self.anchor[a:b])]
        fits = (self.side.label[self.anchor[a:b]][:, None] == other.label[place][None]) == self.same
        fits &= self.side.row[self.anchor[a:b]][:, None] != other.row[place][None]
        fits &= (s >= self.floor[a:b, None]) & (s <= self.ceiling[a:b, None])
        s = np.where(fits, s, OPEN)
        if s.shape[1] > self.k:  # those tied with the k-th stay, for their ids decide
            s = np.where(s >= np.partition(s, -self.k, axis=1)[:, -self.k :].min(1)[:, None], s, OPEN)
        r, c = np.nonzero(s > OPEN)
        if not len(r):
            return
        keep = _best(r, s[r, c], other.id[place[c]], other.row[place[c]], self.k)
        r, c = r[keep], c[keep]
        self.found.append(np.stack([asks[r], s[r, c], other.id[place[c]], other.row[place[c]]]))
        new = np.full((b - a, self.k), OPEN)
        new[r, np.arange(len(r)) - np.searchsorted(r, r)] = s[r, c]
        top[a:b] = np.sort(np.concatenate([top[a:b], new], 1), axis=1)[:, : -self.k - 1 : -1]
        self.floor[a:b] = np.maximum(self.floor[a:b], top[a:b, -1])

    def best(self) -> np.ndarray:
        got = np.concatenate(self.found, 1)
        got = got[:, _best(got[0], got[1], got[2], got[3], self.k)]
        self.found = [got]
        return got


def search(asks: Asks, other: Side) -> None:
    """Both trees together: raises the floors of asks and gathers what they find."""
    a, b, t, u = asks.side, other, asks.side.tree, other.tree
    if a.points.shape[1] != b.points.shape[1] or not len(asks.anchor):
        return
    top = np.full((len(asks.anchor), asks.k), OPEN)
    got = asks.best()
    top[got[0], np.arange(got.shape[1]) - np.searchsorted(got[0], got[0])] = got[1]
    leaves, goals = np.flatnonzero(a.leaf & (asks.last > asks.first)), np.flatnonzero(b.leaf)
    done: set[tuple[int, int]] = set()
    places = lambda nodes: np.concatenate([np.arange(u.start[j], u.end[j]) for j in nodes])
    if asks.same:  # floors from the nearest leaf of the label
        wrong = (t.last_label[leaves][:, None] < u.first_label[goals]) | (t.first_label[leaves][:, None] > u.last_label[goals])
        near = np.where(wrong, -np.inf, a.mid[leaves] @ b.mid[goals].T)
        for x, i in enumerate(leaves):
            y = int(near[x].argmax())
            if near[x, y] > -np.inf:
                asks.score(int(i), b, places([goals[y]]), top)
                done.add((int(i), int(goals[y])))
    floor, ceiling = asks.low(), asks.high()
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ends: list[np.ndarray] = []
    while len(i):
        if asks.same:
            ok = (t.last_label[i] >= u.first_label[j]) & (t.first_label[i] <= u.last_label[j])
        else:
            ok = ~((t.first_label[i] == t.last_label[i]) & (u.first_label[j] == u.last_label[j]) & (t.first_label[i] == u.first_label[j]))
        i, j = i[ok], j[ok]
        lo, hi = interval(a, i, b, j)
        ok = (hi >= floor[i]) & (lo <= ceiling[i])
        i, j, hi = i[ok], j[ok], hi[ok]
        both = a.leaf[i] & b.leaf[j]
        ends.append(np.stack([i[both], j[both], hi[both]]))
        i, j = i[~both], j[~both]
        # The wider of the two opens; a leaf cannot.
        one = ~a.leaf[i] & (b.leaf[j] | (t.count[i] * 8 >= u.count[j]))
        down, rest = t.child[i[one]], u.child[j[~one]]
        i, j = np.concatenate([down, down + 1, i[~one], i[~one]]), np.concatenate([j[one], j[one], rest, rest + 1])
    pairs = np.concatenate(ends, 1)
    pairs = pairs[:, np.lexsort((-pairs[2], pairs[0]))]
    edges = np.searchsorted(pairs[0], np.unique(pairs[0])).tolist() + [pairs.shape[1]]
    for x, y in zip(edges, edges[1:]):
        node = int(pairs[0, x])
        for at in range(x, y, AT_ONCE):
            least = asks.floor[asks.first[node] : asks.last[node]].min()
            some = [int(q) for q, h in zip(pairs[1, at : min(y, at + AT_ONCE)], pairs[2, at : min(y, at + AT_ONCE)]) if h >= least and (node, int(q)) not in done]
            if not some and pairs[2, at] < least:
                break
            if some:
                asks.score(node, b, places(some), top)


def clean(df: DataFrame, id_col: str, vector: str, label: Column) -> DataFrame:
    """Rows that take part: vec_id, label, v and a number for the row, fixed when written."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), trees.whole(vector, MOST).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    return rows.withColumn("row", F.monotonically_increasing_id())


def _sides(part: pa.RecordBatch, leaf: int) -> list[Side]:
    """Trees over rows (row, vec_id, label, v), one for each length of vectors."""
    row, ids, label = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    v = part.column(3)
    size = np.asarray(pa.compute.list_value_length(v))
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out.append(Side(row[at], ids[at], label[at], trees.matrix(v.take(pa.array(at))), leaf))
    return out


BOTH = "block int, part int, row long, vec_id long, label long, v array<long>, ask array<struct<ask: long, floor: long, ceiling: long>>"


def _meet(same: bool, k: int):
    """Rows in order of (block, part): a block's candidates (part -1), then anchor blocks."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
        now, held = None, []
        for batch in batches:
            block, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1), len(block)]
            for x, y in zip(cuts, cuts[1:]):
                if y == x:
                    continue
                key = (int(block[x]), int(part[x]))
                if now is not None and key != now:
                    yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                now = key
                held.append(batch.slice(x, y - x))
        if held:
            yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, goals = None, []
        for (block, part), rows in runs(batches):
            if part < 0:
                at, goals = block, _sides(rows.select(["row", "vec_id", "label", "v"]), trees.LEAF)
                continue
            if at != block:
                continue
            asked = rows.column(6)
            flat = asked.flatten()
            number, floor, ceiling = (flat.field(x).to_numpy(zero_copy_only=False) for x in range(3))
            of = dict(zip(rows.column(2).to_pylist(), range(rows.num_rows)))
            owner = np.repeat(np.arange(rows.num_rows), np.asarray(pa.compute.list_value_length(asked)))
            for side in _sides(rows.select(["row", "vec_id", "label", "v"]), ANCHOR_LEAF):
                place = np.full(rows.num_rows, -1)
                place[[of[r] for r in side.row.tolist()]] = np.arange(len(side.row))
                mine = place[owner] >= 0
                asks = Asks(side, place[owner][mine], floor[mine], ceiling[mine], same, k)
                for goal in goals:
                    search(asks, goal)
                ask, score, ids, row = asks.best()
                yield pa.RecordBatch.from_pydict({"ask": number[mine][asks.of][ask], "score": score, "vec_id": ids, "row": row})

    return run


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Rows with the number of their range of (length, label, id): ranges of about ``size``."""
    order = [F.size("v"), "label", "vec_id", "row"]
    return rows.repartitionByRange(max(1, -(-n // size)), *order).withColumn("block", F.spark_partition_id())


def _nearest(candidates: DataFrame, last: int, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """ask, place, score, vec_id: the k best of each ask, over all candidate blocks.
    ``anchors``: part, row, vec_id, label, v, ask."""
    every = F.explode(F.expr(f"sequence(0, {last})")).alias("block")
    sent = anchors.select(every, "part", "row", "vec_id", "label", "v", "ask")
    none = F.lit(None).cast("array<struct<ask: long, floor: long, ceiling: long>>")
    held = candidates.select("block", F.lit(-1).alias("part"), "row", "vec_id", "label", "v", none.alias("ask"))
    both = held.unionByName(sent).repartition("block").sortWithinPartitions("block", "part")
    found = both.mapInArrow(_meet(same, k), "ask long, score long, vec_id long, row long")
    w = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("ask", "place", "score", "vec_id")


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    row where ``is_anchor`` (an expression on vec_id) holds and each of its positives, the
    hardest rows of other labels within ``low`` to ``high`` hundredths of its score."""
    spark = df.sparkSession
    common.ship(spark)
    rows = common.cut(clean(df, id_col, vector, F.col("label") if label is None else label), "rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # Of equal rows the first few by id: partial limits run before the exchange.
    same = Window.partitionBy(F.xxhash64("label", "v"), "label", "v").orderBy("vec_id", "row")
    firsts = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= max(positives, negatives) + 1).drop("_r")
    candidates = common.cut(_blocks(firsts, BLOCK, n), "candidates")
    last = candidates.agg(F.max("block")).first()[0]
    asking = rows.where(is_anchor)
    anchors = common.cut(_blocks(asking, ANCHORS, asking.count()).withColumnRenamed("block", "part"), "anchors")
    ask = lambda *x: F.struct(*[c.cast("long").alias(k) for c, k in zip(x, ("ask", "floor", "ceiling"))])
    first = anchors.withColumn("ask", F.array(ask(F.col("row"), F.lit(OPEN + 1), F.lit(-OPEN - 1))))
    found = common.cut(_nearest(candidates, last, first, True, positives), "positives", narrow=True)
    # Whole hundredths without overflow: 100 q + r splits the score.
    floor = F.expr(f"-((-score div 100) * {low} + floor((-score - (-score div 100) * 100) * {low} / 100.0))")
    ceiling = F.expr(f"(score div 100) * {high} + floor((score - (score div 100) * 100) * {high} / 100.0)")
    # Asks of one row stand in one list; their numbers are (anchor's row, place).
    opened = found.select(F.col("ask").alias("row"), ask(F.col("ask") * positives + F.col("place") - 1, floor, ceiling).alias("a"))
    lists = opened.groupBy("row").agg(F.sort_array(F.collect_list("a")).alias("ask"))  # at most ``positives``
    second = _nearest(candidates, last, anchors.join(lists, "row"), False, negatives)
    positive = found.join(anchors.select(F.col("row").alias("ask"), F.col("vec_id").alias("anchor_id")), "ask")
    positive = positive.select((F.col("ask") * positives + F.col("place") - 1).alias("ask"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.join(positive, "ask")
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
