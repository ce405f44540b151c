"""Values of neighbours, brought to ranges of vertices, round by round.

Edge ends are dealt once to ranges of their vertex that hold about ENDS ends, and kept on the executors'
disks. A round sends a vertex's values only to the ranges that hold a neighbour of it, so the ends are shuffled
once and a vertex's values at most once a range; a join would send them, or the ends, once an edge end. Where
neighbours' ids lie in few ranges, rounds grow with the vertices. Each range has all ends of its vertices, so
what a task finds for one is final.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygraph.model import ship
from tallygraph.operators.paths import _acyclic, _cut, components

#: Ends in a range, and the ids that bounds are drawn from; these change how evenly the ends are dealt, nothing else.
ENDS, DRAWN = 1_000_000, 200_000


class Ranges:
    def __init__(self, edges: DataFrame):
        """``edges`` (src, dst[, w]) are distinct and written; ``w`` goes with both ends."""
        spark, m, more = edges.sparkSession, 2 * edges.count(), [c for c in ("w",) if c in edges.columns]
        self.count = k = max(1, math.ceil(m / ENDS), min(m // 1_000, 2 * spark.sparkContext.defaultParallelism))
        some = edges.sample(min(1.0, DRAWN / max(m, 1)), 42).select(F.explode(F.array("src", "dst")).alias("id"))
        cuts = some.approxQuantile("id", [i / k for i in range(1, k)], 0.25 / k) if k > 1 else []
        bounds = np.unique(np.array(cuts, np.int64))

        def deal(batches):
            for b in batches:
                src, dst = b.column("src").to_numpy(), b.column("dst").to_numpy()
                ids, other = np.concatenate([src, dst]), np.concatenate([dst, src])
                w = [pa.array(np.tile(b.column(c).to_numpy(), 2), pa.float64()) for c in more]
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ids, "right"), pa.int32()), pa.array(ids, pa.int64()), pa.array(other, pa.int64()), *w], names=["tile", "id", "other", *more])

        ship(spark)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *more).mapInArrow(deal, "tile int, id long, other long" + "".join(f", {c} double" for c in more))
        self.near = dealt.repartition(parts, "tile").sortWithinPartitions("tile", "id").persist(StorageLevel.DISK_ONLY)
        self._asked = None

    @property
    def asked(self) -> DataFrame:
        """(other, tiles): distinct inside a range without a shuffle; then the ranges that ask for a vertex."""
        if self._asked is None:
            self._asked = _cut(self.near.select("tile", "other").distinct().groupBy("other").agg(F.collect_list("tile").alias("tiles")))
        return self._asked

    def places(self) -> DataFrame:
        """(id, own, more, weight) of the vertices with an edge: the range that holds its ends, the others
        that ask for it, and the sum of its ends' w. Rows that carry own and more go to their ranges by ``meet``."""

        def f(key, t):
            ids, first, w = _ends(t)
            own = ids[first]
            far = np.setdiff1d(t["other"].to_numpy(), own)
            sums = np.add.reduceat(w, first) if len(first) else np.zeros(0)
            tile = pa.array(np.full(len(own) + len(far), key[0].as_py()), pa.int32())
            here = pa.array(np.r_[np.ones(len(own), bool), np.zeros(len(far), bool)])
            return pa.table({"id": np.concatenate([own, far]), "tile": tile, "here": here, "weight": np.concatenate([sums, np.zeros(len(far))])})

        ship(self.near.sparkSession)
        got = self.near.groupBy("tile").applyInArrow(f, "id long, tile int, here boolean, weight double")
        own, more = F.when(F.col("here"), F.col("tile")), F.when(~F.col("here"), F.col("tile"))
        return got.groupBy("id").agg(F.max(own).alias("own"), F.collect_list(more).alias("more"), F.sum("weight").alias("weight"))

    def meet(self, rows: DataFrame, shown: list[str], f, schema: str) -> DataFrame:
        """f(near, far, own) of each range: ``far`` the rows of its vertices and of those it asks for, in order of id, and
        ``own`` which of them are its own. Only own rows carry more than id and ``shown``."""
        tile = F.explode(F.concat(F.array("own"), "more")).alias("tile")
        sent = rows.select(tile, *rows.columns)
        sent = sent.select("tile", *[F.col(c) if c in ("id", *shown) else F.when(F.col("tile") == F.col("own"), F.col(c)).alias(c) for c in rows.columns])

        def go(near: pa.Table, far: pa.Table) -> pa.Table:
            far = far.drop_columns(["tile"]).take(pa.array(np.argsort(far["id"].to_numpy(), kind="stable")))
            return f(near, far, far["own"].is_valid().to_numpy())

        ship(rows.sparkSession)
        return self.near.groupBy("tile").cogroup(sent.groupBy("tile")).applyInArrow(go, schema)

    def each(self, f, schema: str) -> DataFrame:
        """f(ids, other) of each range, sorted by id, as a table."""

        def go(t: pa.Table) -> pa.Table:
            return f(*_sorted(t))

        ship(self.near.sparkSession)
        return self.near.groupBy("tile").applyInArrow(go, schema)

    def gather(self, values: DataFrame, f, schema: str) -> DataFrame:
        """f(ids, other, far) of each range, ``far`` the rows of ``values`` (id, columns...) of the others."""
        sent = values.join(self.asked, values.id == self.asked.other).select(F.explode("tiles").alias("tile"), *[values[c] for c in values.columns])

        def go(key, near: pa.Table, far: pa.Table) -> pa.Table:
            return f(*_sorted(near), far)

        ship(values.sparkSession)
        return self.near.groupBy("tile").cogroup(sent.groupBy("tile")).applyInArrow(go, schema)

    def met(self, ids: DataFrame) -> DataFrame:
        """(id) of the vertices with a neighbour among ``ids`` (id)."""

        def f(ids, other, far):
            return pa.table({"id": np.unique(ids[np.isin(other, far["id"].to_numpy())])})

        return self.gather(ids.select("id"), f, "id long")

    def best(self, values: DataFrame, most: bool = True) -> DataFrame:
        """(id, columns...): of the neighbours' rows of ``values`` (id, whole-number columns...) the one that comes
        last in order of the columns, or first."""
        names = [c for c in values.columns if c != "id"]
        schema = pa.schema([(c, pa.int64()) for c in ("id", *names)])

        def f(ids, other, far):
            first, at = _matched(ids, other, far["id"].to_numpy())
            if not len(at):
                return schema.empty_table()
            turn = np.lexsort([far[c].to_numpy() for c in reversed(names)])
            rank = np.empty(len(turn), np.int64)
            rank[turn] = np.arange(len(turn))
            got = turn[(np.maximum if most else np.minimum).reduceat(rank[at], first[1])]
            return pa.table([first[0], *[far[c].to_numpy()[got] for c in names]], schema=schema)

        return self.gather(values.select("id", *[F.col(c).cast("long").alias(c) for c in names]), f, ", ".join(f"{c} long" for c in schema.names))

    def components(self) -> DataFrame:
        """(id, component), from a spanning forest of each range."""

        def f(ids, other):
            keep = _acyclic(ids, other)
            return pa.table({"src": ids[keep], "dst": other[keep]})

        return components(self.each(f, "src long, dst long"))

    def close(self) -> None:
        self.near.unpersist()


def _sorted(near: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, other = near["id"].to_numpy(), near["other"].to_numpy()
    if (np.diff(ids) < 0).any():  # dealt in order of id, but nothing downstream promises it
        turn = np.argsort(ids, kind="stable")
        ids, other = ids[turn], other[turn]
    return ids, other


def _ends(near: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids in order, where each begins, and w, ones where edges have none."""
    ids, w = near["id"].to_numpy(), near["w"].to_numpy() if "w" in near.column_names else np.ones(near.num_rows)
    if (np.diff(ids) < 0).any():
        turn = np.argsort(ids, kind="stable")
        ids, w = ids[turn], w[turn]
    return ids, starts(ids), w


def starts(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)


def _matched(ids: np.ndarray, other: np.ndarray, known: np.ndarray):
    """((ids, first ends) of vertices with a known neighbour, places in ``known`` of their ends' others)."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not len(known):
        return (none, none), none
    turn = np.argsort(known)
    at = turn[np.minimum(np.searchsorted(known, other, sorter=turn), len(turn) - 1)]
    on = known[at] == other
    ids, at = ids[on], at[on]
    first = starts(ids)
    return (ids[first], first), at
