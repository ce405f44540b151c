"""Degree-biased closure over tables.

A round deals ``3 * rest + 10`` draws to centres in proportion to degree ^ beta by systematic
sampling: the centres' masses stand in a row in hashed order, running sums go by buckets, and
a centre gets as many draws as evenly spaced points fall on its stretch; the first point is a
seeded number. A draw takes two of its centre's neighbours by rank, from hashes of (seed,
round, centre, draw). Pairs that are joined, were taken, repeat an earlier draw or (but for a share
``loose``) have one colour leave by joins; of the rest the first by hash are taken up to the quota.
The driver sees counts only; a round is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.model import both_ways, degrees
from tallygraph.operators.paths import _cut

#: Buckets of the running sums.
BUCKETS = 1_024


def unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) by hash."""
    h = F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)


def centres(weights: DataFrame, draws: int, seed: int, round_: int) -> DataFrame:
    """(id, draw): ``draws`` draws of ids (id, mass), a draw a row, numbered at each id."""
    held = weights.withColumn("h", F.xxhash64(F.lit(seed), F.lit(round_), "id")).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    sums = held.groupBy("b").agg(F.sum("mass").alias("s"))
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("o"), F.sum("s").over(Window.partitionBy()).alias("all"))  # a row a bucket
    inside = F.sum("mass").over(Window.partitionBy("b").orderBy("h", "id"))
    step = F.col("all") / draws
    first = unit(seed, round_, -1)
    at = held.withColumn("to", inside).join(before, "b").select("id", ((F.col("o") + F.col("to") - F.col("mass")) / step - first).alias("low"), ((F.col("o") + F.col("to")) / step - first).alias("high"))
    n = (F.ceil("high") - F.ceil("low")).cast("int")
    return at.select("id", n.alias("n")).where("n > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("draw"))


def random_closure(edges: DataFrame, colours: DataFrame, quota: int, beta: float = 1.0, seed: int = 42, loose: float = 0.0, rounds: int = 24) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of the new edges, and by round: drawn, joined already or repeated,
    stopped by colour alone, legal, taken, and the mean degree of the centres drawn over
    the mean of the graph's (the bias)."""
    spark = edges.sparkSession
    near = both_ways(edges)
    deg = _cut(degrees(edges))
    weights = _cut(deg.where("degree > 1").withColumn("mass", F.pow(F.col("degree").cast("double"), F.lit(float(beta)))))
    have, taken, record = edges.select("src", "dst"), None, []
    count, mean = 0, deg.agg(F.avg("degree")).first()[0]
    for r in range(rounds if weights.count() else 0):
        rest = quota - count
        if rest <= 0:
            break
        drawn = centres(weights, 3 * rest + 10, seed, r).join(deg, "id")
        i = F.floor(unit(seed, r, "id", "draw", 1) * F.col("degree"))
        j = F.floor(unit(seed, r, "id", "draw", 2) * (F.col("degree") - 1))
        drawn = _cut(drawn.withColumn("i", i.cast("int")).withColumn("j", (j + (j >= i).cast("int")).cast("int")))
        # Only the centres drawn rank their neighbours; a table of the draws' size is broadcast, the edges stay.
        here = near.join(drawn.select("id").distinct(), "id", "left_semi")
        ranked = here.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("other")) - 1)
        asked = drawn.select("id", F.col("i").alias("rank")).unionByName(drawn.select("id", F.col("j").alias("rank"))).distinct()
        ends = _cut(ranked.join(asked, ["id", "rank"]))
        ends = _cut(colours.toDF("other", "colour").join(ends, "other"))
        side = lambda k, o, c: ends.select("id", F.col("rank").alias(k), F.col("other").alias(o), F.col("colour").alias(c))
        pairs = drawn.join(side("i", "u", "cu"), ["id", "i"]).join(side("j", "v", "cv"), ["id", "j"])
        h = F.xxhash64(F.lit(seed), F.lit(r), "id", "draw", F.lit(3))
        pairs = pairs.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), (F.col("cu") == F.col("cv")).alias("same"), (unit(seed, r, "id", "draw", 4) < loose).alias("pass"), h.alias("h"))
        # Of draws of one pair the first stands for all; any that may pass the colour lets it.
        once = pairs.groupBy("src", "dst").agg(F.first("same").alias("same"), F.max("pass").alias("pass"), F.min("h").alias("h"))
        once = _cut(once)
        fresh = _cut(once.join(_cut(have.join(once.select("src", "dst"), ["src", "dst"], "left_semi")), ["src", "dst"], "left_anti"))
        legal = fresh.where(~F.col("same") | F.col("pass"))
        new = _cut(legal.orderBy("h", "src", "dst").limit(rest).select("src", "dst"))
        got, fine, all_ = new.count(), legal.count(), fresh.count()
        n, bias = drawn.agg(F.count("*"), F.avg("degree")).first()
        record.append((r, n, n - all_, all_ - fine, fine, got, float(bias or 0) / mean))
        taken = new if taken is None else taken.unionByName(new)
        have, count = have.unionByName(new), count + got
    schema = "round long, drawn long, joined_or_repeated long, stopped long, legal long, taken long, bias double"
    return (edges.select("src", "dst").limit(0) if taken is None else taken), spark.createDataFrame(record, schema)
