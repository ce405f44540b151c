"""Mixing sources to target weights by hierarchical budgets.

A tree domain > language > source has a weight at every node; a node's share of
its parent's budget is its weight over its siblings'.  A leaf can supply its rows'
tokens times ``epochs`` at most.  Budgets run down level by level: at each node the
parent's budget is water-filled over the children by weight, each child capped by
what its subtree supplies, so a short leaf's rest goes to its siblings first and
only what a whole subtree cannot use reaches the level above.  Each leaf then
takes rows epoch after epoch, each epoch in a seeded order of its own, while the
tokens before a row are fewer than its budget.  DataFrame expressions only; the tree
has one row per leaf.

Defined cases: a node of weight 0 and all below it get nothing, nor does what they
hold count as supply; a weight that is negative or not finite raises; null level columns are the value '' of that level; null or empty
text has 1 token, like any text without white space between words (tokens are
white-space pieces, at least 1); a node without a weight gets ``default_weight``;
repeated rows are rows of their own; an empty table gives no rows; other columns
pass through unchanged, whatever their names, but those of the five added columns
give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygraph.llm import common

LEVELS = ("domain", "lang", "source")

#: Weights by level and value; values not named get DEFAULT_WEIGHT.
WEIGHTS = {
    "domain": {"web": 3.0, "books": 2.0, "code": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}
DEFAULT_WEIGHT = 1.0

#: Sources by number, modulo three, stand for domains: documents name none.
DOMAINS = ("web", "books", "code")


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo the number of domains."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int)"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (number % len(DOMAINS)) + 1)


def tokens_of(text: Column) -> Column:
    """White-space pieces of a text, at least 1; bytes below 0x21 that split words."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(1)).cast("long")


def _weight(level: str, column: str, weights: dict) -> Column:
    if not all(0 <= float(w) < float("inf") for w in weights.get(level, {}).values()):
        raise ValueError(f"weights of {level} must be finite and not negative")
    out = F.lit(DEFAULT_WEIGHT)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(column) == value, F.lit(float(w))).otherwise(out)
    return out


def _fill(nodes: DataFrame, level: str, parents: list[str], weights: dict) -> DataFrame:
    """Water-fill ``_budget`` of the parent over its children: child i gets
    min(supply_i, weight_i * t) for the one t that spends the budget. Children in
    order of supply / weight fill up first; sums before a child give its t."""
    w = Window.partitionBy(*parents).orderBy("_ratio", level)
    nodes = nodes.withColumn("_w", _weight(level, level, weights)).withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_supply") / F.nullif("_w", F.lit(0.0))).otherwise(0.0))
    full = F.coalesce(F.sum("_supply").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumn("_t", (F.col("_budget") - full) / F.nullif(rest, F.lit(0.0)))
    # The first child that isn't filled up sets t for itself and all after it.
    t = F.min(F.when(F.col("_t") < F.col("_ratio"), F.struct("_ratio", level, "_t"))).over(Window.partitionBy(*parents))["_t"]
    return nodes.withColumn("_budget", F.when(t.isNull(), F.col("_supply").cast("double")).otherwise(F.least(F.col("_supply").cast("double"), F.col("_w") * t))).drop("_w", "_ratio", "_t")


def budgets(leaves: DataFrame, total: Column, weights: dict = WEIGHTS) -> DataFrame:
    """``leaves`` (the level columns and ``supply``) with ``budget`` in tokens."""
    out, path = None, []
    counts = F.lit(True)
    for level in LEVELS:
        counts &= _weight(level, level, weights) > 0
    leaves = leaves.withColumn("supply", F.when(counts, F.col("supply")).otherwise(0))
    for level in LEVELS:
        here = leaves.groupBy(*path, level).agg(F.sum("supply").alias("_supply"))
        if out is None:
            here = here.withColumn("_root", F.lit(0)).withColumn("_budget", total)
            filled = _fill(here, level, ["_root"], weights).drop("_root", "_supply")
        else:
            filled = _fill(here.join(out, path), level, path, weights).drop("_supply")
        path = [*path, level]
        out = filled
    return out.withColumnRenamed("_budget", "budget")


def mix(df: DataFrame, share: float = 0.5, epochs: int = 2, seed: int = 8, weights: dict = WEIGHTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of df for the selected rows, plus mix_domain, mix_tokens,
    mix_epoch (0-based), mix_before (tokens of the leaf before this row) and
    mix_budget (the leaf's). The total budget is ``share`` of all tokens, and a row
    may come up to ``epochs`` times."""
    ours = {"mix_domain", "mix_tokens", "mix_epoch", "mix_before", "mix_budget"}
    kept = [c for c in df.columns if c not in ours]
    # The input's columns travel by number, so no name of theirs clashes with ours.
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)],
        F.col(key).alias("_key"),
        F.coalesce(domain_of(F.col("source")), F.lit("")).alias("_domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("_lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        tokens_of(F.col(text)).alias("_n"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_m"),
    )
    names = [f"_{x}" for x in LEVELS]
    leaf = common.cut(rows.groupBy(*[F.col(a).alias(b) for a, b in zip(names, LEVELS)]).agg(F.sum("_n").alias("_own")), "leaves", narrow=True)
    leaf = leaf.withColumn("supply", F.col("_own") * epochs)
    total = leaf.agg(F.coalesce(F.sum("_own"), F.lit(0))).first()[0]
    budget = common.cut(
        leaf.join(budgets(leaf, F.lit(float(total) * share), weights), list(LEVELS)).select(*[F.col(b).alias(f"_leaf{a}") for a, b in zip(names, LEVELS)], "_own", F.floor("budget").alias("_budget")),
        "budget",
        narrow=True,
    )
    on = (F.col("_domain") == F.col("_leaf_domain")) & (F.col("_lang") == F.col("_leaf_lang")) & (F.col("_source") == F.col("_leaf_source"))
    # A row stands in each epoch that its leaf's budget reaches, with a hash of its own there.
    rows = rows.join(budget, on).withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).where(F.col("_e") * F.col("_own") < F.col("_budget"))
    rows = rows.withColumn("_h", common.spread(F.concat_ws(":", F.lit(str(seed)), F.col("_e"), F.coalesce(F.col("_key").cast("string"), F.lit("")), "_m"))).drop("_m")
    # A few thousand rows a bucket keep a window's buffer of whole rows in memory.
    placed = common.running(rows, "_n", ["_h", "_key", "_n"], [*names, "_e"], rows=3_000)
    chosen = placed.withColumn("_at", F.col("before") + F.col("_e") * F.col("_own")).where(F.col("_at") < F.col("_budget"))
    return chosen.select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)],
        F.col("_domain").alias("mix_domain"),
        F.col("_n").alias("mix_tokens"),
        F.col("_e").alias("mix_epoch"),
        F.col("_at").cast("long").alias("mix_before"),
        F.col("_budget").cast("long").alias("mix_budget"),
    )
