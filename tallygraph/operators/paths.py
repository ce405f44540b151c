"""Components and distances by joins, each round written out."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.model import both_ways, ship

_own: list[tempfile.TemporaryDirectory] = []
_written: list[tuple] = []


def scratch(spark) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, local mode makes its
    own, and a cluster, whose machines share none, raises. Removed when Python exits."""
    conf = spark.sparkContext.getConf()
    where, master = conf.get("spark.checkpoint.dir", None), conf.get("spark.master", "local")
    if not where:
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="rounds-"))
        where = f"file://{_own[0].name}"
    path = f"{where.rstrip('/')}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its folder goes with it
            return


def _cut(df: DataFrame) -> DataFrame:
    """Write to a folder of its own and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffle: files of a row a vertex can be small enough for Spark to send them through the driver, round by round."""
    return a.join(b.hint("merge"), on, how)


#: Edges a task holds before it thins them.
HELD = 1_000_000


def _acyclic(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which edges, taken in order, join two trees."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    up, keep = list(range(len(ids))), np.zeros(len(src), bool)
    for i, (a, b) in enumerate(zip(ends[: len(src)].tolist(), ends[len(src) :].tolist())):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
            keep[i] = True
    return keep


def thinned(edges: DataFrame, forests: int = 1) -> DataFrame:
    """(src, dst, cost) without edges that a range of ``src`` can spare: each range keeps, of its
    distinct edges, a spanning forest of least (cost, src, dst), then as many more of the rest. Every cut
    keeps its cheapest edge, and as many edges as it has up to ``forests``; so components, the least
    spanning forest and, with two, bridges are the graph's. A task holds twice its vertices or HELD edges;
    ranges that share vertices leave more edges to the caller, who joins them as before."""
    cost = F.col("cost") if "cost" in edges.columns else F.lit(0.0)
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), cost.cast("double").alias("cost")).where("src <> dst")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("cost", pa.float64())])

    def thin(t: pa.Table) -> pa.Table:
        src, dst, free = t["src"].to_numpy(), t["dst"].to_numpy(), t["cost"].is_null().to_numpy()
        order = np.lexsort((dst, src, t["cost"].to_numpy(), ~free))  # as Spark orders: null before all numbers
        by_pair = order[np.lexsort((np.arange(len(order)), dst[order], src[order]))]
        again = np.zeros(len(order), bool)
        again[by_pair[1:]] = (np.diff(src[by_pair]) == 0) & (np.diff(dst[by_pair]) == 0)
        rest, kept = order[~again[order]], []
        for _ in range(forests):
            keep = _acyclic(src[rest], dst[rest])
            kept.append(rest[keep])
            rest = rest[~keep]
        return t.take(pa.array(np.concatenate(kept)))

    def go(batches):
        held, n, full = [], 0, HELD
        for b in batches:
            held.append(b.cast(schema))
            n += b.num_rows
            if n >= full:
                t = thin(pa.Table.from_batches(held, schema))
                held, n = t.to_batches(), t.num_rows
                full = n + max(n, HELD)
        if n:
            yield from thin(pa.Table.from_batches(held, schema)).to_batches()

    ship(edges.sparkSession)
    return e.repartitionByRange("src").mapInArrow(go, "src long, dst long, cost double")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. Each round takes the least label
    of the neighbours, then of the label's own label, so paths shrink fast. Rounds
    run on thinned edges."""
    edges = _cut(edges.select("src", "dst"))
    near = _cut(both_ways(thinned(edges).select("src", "dst").unionByName(edges.where("src = dst"))))
    labels = _cut(near.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    before = None
    while True:
        got = _join(near, labels.toDF("other", "c"), "other").groupBy("id").agg(F.min("c").alias("c"))
        new = _join(labels, got, "id").select("id", F.least("component", "c").alias("component"))
        jump = new.toDF("component", "further")
        labels = _cut(_join(new, jump, "component").select("id", F.least("component", "further").alias("component")))
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, id, d) of all reachable pairs from the given sources, or of those within
    ``most``: a frontier a round, joined with neighbours and kept where new."""
    near = _cut(both_ways(edges))
    seen = _cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("d")))
    frontier, d = seen, 0
    while most is None or d < most:
        d += 1
        step = frontier.join(near, "id").select("source", F.col("other").alias("id")).distinct()
        frontier = _cut(step.join(seen, ["source", "id"], "left_anti").withColumn("d", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def histogram(dist: DataFrame) -> DataFrame:
    return dist.where("d > 0").groupBy("d").agg(F.count("*").alias("pairs"))


def path_summary(hist: DataFrame, n: int) -> DataFrame:
    """One row of a complete histogram: average length, efficiency, diameter."""
    return hist.agg((F.sum(F.col("d") * F.col("pairs")) / F.sum("pairs")).alias("average_path"), (F.sum(F.col("pairs") / F.col("d")) / (n * (n - 1))).alias("efficiency"), F.max("d").cast("long").alias("diameter"))


def hop_plot(hist: DataFrame) -> DataFrame:
    """(h, pairs, share) within h hops, of the connected ordered pairs."""
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return hist.select(F.col("d").cast("long").alias("h"), F.sum("pairs").over(w).alias("pairs"), (F.sum("pairs").over(w) / F.sum("pairs").over(total)).alias("share"))


def effective_diameter(hist: DataFrame, share: float = 0.9) -> DataFrame:
    """The hop count that the share of pairs is within, interpolated between hops."""
    h = hop_plot(hist)
    lag = F.coalesce(F.lag("share").over(Window.orderBy("h")), F.lit(0.0))
    first = h.withColumn("low", lag).where(F.col("share") >= share - 1e-12).orderBy("h").limit(1)
    return first.select((F.col("h") - 1 + (share - F.col("low")) / (F.col("share") - F.col("low"))).alias("effective_diameter"))
