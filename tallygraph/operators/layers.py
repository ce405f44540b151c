"""Relational cores of layers on graphs: supernode attention, bundle layers, coverage
masks, fingerprint matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.model import ship


def attention(rows: DataFrame) -> DataFrame:
    """(id, at, value): linear attention inside each supernode. ``rows`` is (id, label, q,
    k, v) with arrays; features are elu + 1. Outer products of keys and values are summed
    a label, with partial sums before the shuffle, and gathered back."""
    feature = lambda c: F.transform(c, lambda x: F.when(x > 0, x + 1).otherwise(F.exp(x)))
    keys = rows.select("label", F.posexplode(feature("k")).alias("i", "ki"), "v")
    kv = keys.select("label", "i", "ki", F.posexplode("v").alias("at", "vj")).groupBy("label", "i", "at").agg(F.sum(F.col("ki") * F.col("vj")).alias("kv"), F.sum("ki").alias("ks"))
    query = rows.select("id", "label", F.posexplode(feature("q")).alias("i", "qi"))
    out = query.join(kv, ["label", "i"]).groupBy("id", "at").agg(F.sum(F.col("qi") * F.col("kv")).alias("top"), F.sum(F.col("qi") * F.col("ks")).alias("norm"))
    return out.select("id", F.col("at").cast("long").alias("at"), (F.col("top") / F.greatest("norm", F.lit(1e-6))).alias("value"))


def bundle_layer(relations: DataFrame, values: DataFrame, scale: float = 1.0) -> DataFrame:
    """(id, value): edges (a, b, axons, src, dst) of a relation are dealt round robin to
    its axons; an axon carries the mean over its distinct sources to its distinct targets."""
    w = Window.partitionBy("a", "b").orderBy("src", "dst")
    dealt = relations.select("a", "b", "src", "dst", ((F.row_number().over(w) - 1) % F.col("axons")).alias("axon"))
    carried = dealt.select("a", "b", "axon", "src").distinct().join(values.toDF("src", "x"), "src").groupBy("a", "b", "axon").agg(F.avg("x").alias("m"))
    return dealt.select("a", "b", "axon", F.col("dst").alias("id")).distinct().join(carried, ["a", "b", "axon"]).groupBy("id").agg((F.sum("m") * scale).alias("value"))


def draw_mask(seed: int, target: float, side: int = 64, most: int = 60) -> np.ndarray:
    """Boolean mask of rectangles and strokes until a share of cells is covered."""
    rng, mask = np.random.default_rng(seed), np.zeros((side, side), bool)
    for _ in range(most):
        if mask.mean() >= target:
            break
        y, x = rng.integers(0, side, 2)
        if rng.random() < 0.5:
            h, w = rng.integers(side // 16, side // 3, 2)
            mask[y : y + h, x : x + w] = True
        else:
            steps, width, turn = int(rng.integers(side // 4, side)), int(rng.integers(1, 4)), rng.random() * 2 * np.pi
            for _ in range(steps):
                mask[max(0, int(y) - width) : int(y) + width, max(0, int(x) - width) : int(x) + width] = True
                turn += rng.normal(0, 0.3)
                y, x = np.clip([y + np.sin(turn), x + np.cos(turn)], 0, side - 1)
    return mask


def masks(rows: DataFrame, side: int = 64) -> DataFrame:
    """(seed, target, coverage, mask): a packed mask for each seed and target."""

    def go(batches):
        for b in batches:
            got = [draw_mask(int(s), float(t), side) for s, t in zip(b.seed, b.target)]
            yield pd.DataFrame({"seed": b.seed, "target": b.target, "coverage": [m.mean() for m in got], "mask": [np.packbits(m).tobytes() for m in got]})

    ship(rows.sparkSession)
    return rows.select("seed", "target").mapInPandas(go, "seed long, target double, coverage double, mask binary")


def coverage_bucket(coverage, edges: tuple = (0.1, 0.2, 0.3, 0.4, 0.5)):
    """Bucket number by coverage: how many of the bounds lie at or below it."""
    return sum((F.when(coverage >= x, 1).otherwise(0) for x in edges), F.lit(0)).cast("long")


def pixel_errors(pairs: DataFrame) -> DataFrame:
    """(id, l1, psnr) of arrays a and b with values from 0 to 1."""
    diff = F.zip_with("a", "b", lambda x, y: x - y)
    mean = lambda f: F.aggregate(F.transform(diff, f), F.lit(0.0), lambda s, x: s + x) / F.size("a")
    d = pairs.select("id", mean(F.abs).alias("l1"), mean(lambda x: x * x).alias("mse"))
    return d.select("id", (100 * F.col("l1")).alias("l1"), F.when(F.col("mse") > 0, -10 * F.log10("mse")).alias("psnr"))


def fingerprint_match(prints: DataFrame, rows: DataFrame, most: int = 1_024) -> DataFrame:
    """(print_id, vec_id, distance): each print's nearest row by L2, ties to the smaller
    id. Prints go to the tasks in blocks of about ``most``; a task keeps a running best and compares
    one print at a time with a batch, so it holds no distances but a batch's."""
    blocks = max(1, -(-prints.count() // most))
    best = [_nearest(prints.where(F.pmod(F.xxhash64("print_id"), F.lit(blocks)) == i), rows) for i in range(blocks)]
    out = best[0]
    for more in best[1:]:
        out = out.unionByName(more)
    return out.groupBy("print_id").agg(F.min(F.struct("distance", "vec_id")).alias("m")).select("print_id", "m.vec_id", "m.distance")


def _nearest(prints: DataFrame, rows: DataFrame) -> DataFrame:
    got = prints.select("print_id", "vec").toPandas()
    ids, p = got.print_id.to_numpy(), np.array(got.vec.tolist(), float)

    def go(batches):
        best, which = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
        for b in batches:
            x, v = np.array(b.vec.tolist(), float), b.vec_id.to_numpy()
            for i, q in enumerate(p if len(b) else ()):
                d = np.sqrt(((q - x) ** 2).sum(1))
                low = np.nanmin(d, initial=np.inf)
                if low <= best[i] and np.isfinite(low):
                    first = v[d == low].min()
                    which[i] = first if low < best[i] else min(first, which[i])
                    best[i] = low
        on = np.isfinite(best)
        yield pd.DataFrame({"print_id": ids[on], "vec_id": which[on], "distance": best[on]})

    ship(rows.sparkSession)
    return rows.select("vec_id", "vec").mapInPandas(go, "print_id long, vec_id long, distance double")


def _ssim(a: np.ndarray, b: np.ndarray, size: int = 7) -> float:
    """Mean structural similarity over all windows of size x size, sample covariances,
    values from 0 to 1."""
    x, y = (np.lib.stride_tricks.sliding_window_view(v, (size, size)).reshape(-1, size * size) for v in (a, b))
    n = size * size
    mx, my = x.mean(1), y.mean(1)
    vx, vy = x.var(1) * n / (n - 1), y.var(1) * n / (n - 1)
    cov = ((x - mx[:, None]) * (y - my[:, None])).sum(1) / (n - 1)
    c1, c2 = 0.01**2, 0.03**2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def structural_similarity(pairs: DataFrame, side: int, size: int = 7) -> DataFrame:
    """(id, ssim) of square images (id, a, b): arrays of side * side values from 0 to 1, row
    by row; null where an array is null or of another length."""

    def go(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.a, batch.b):
                fits = a is not None and b is not None and len(a) == len(b) == side * side
                out.append(_ssim(np.asarray(a, float).reshape(side, side), np.asarray(b, float).reshape(side, side), size) if fits else None)
            yield pd.DataFrame({"id": batch.id, "ssim": pd.Series(out, dtype="float64")})

    ship(pairs.sparkSession)
    return pairs.select("id", "a", "b").mapInPandas(go, "id long, ssim double")


def recurrent(edges: DataFrame, base: DataFrame, rounds: int, snapshots: tuple = ()) -> DataFrame:
    """(round, id, value): three layers of vertices that pass messages in turn. ``edges`` is
    (src, dst, layer) with layers '12', '13' and '23', the end of the lower class first;
    ``base`` (id, value) holds the first class. A round makes a2 from the a1 and a3 before
    it, then a1 = base + what a3 sends, then a3 from that a2 and a1; a message is the mean
    over the senders and 0 without any. Rows of all three layers at the last round, and
    of the third at the snapshots; a round is written out."""
    from tallygraph.operators.paths import _cut

    e = _cut(edges.select("src", "dst", "layer"))
    up = lambda k: e.where(F.col("layer") == k).select(F.col("src").alias("from"), F.col("dst").alias("to"))
    down = lambda k: e.where(F.col("layer") == k).select(F.col("dst").alias("from"), F.col("src").alias("to"))
    send = lambda pairs, x: pairs.join(x.toDF("from", "v"), "from").groupBy(F.col("to").alias("id")).agg(F.avg("v").alias("value"))
    add = lambda *parts: parts[0].unionByName(parts[1]).groupBy("id").agg(F.sum("value").alias("value"))
    base = _cut(base.select("id", F.col("value").cast("double").alias("value")))
    a1, a3, kept = base, base.limit(0), []
    for step in range(1, rounds + 1):
        a2 = _cut(add(send(up("12"), a1), send(down("23"), a3)))
        a1 = _cut(add(base, send(down("13"), a3)))
        a3 = _cut(add(send(up("23"), a2), send(up("13"), a1)))
        if step == rounds:
            kept += [x.withColumn("round", F.lit(step)) for x in (a1, a2, a3)]
        elif step in snapshots:
            kept.append(a3.withColumn("round", F.lit(step)))
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return out.select("round", "id", "value")
