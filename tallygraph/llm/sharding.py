"""Jump consistent hashing: stable keys to shards, without a ring table.

``shard_of`` is the jump walk: a key at shard b jumps next to floor((b + 1) / r),
r uniform in (0, 1] and decided by the key and b alone (52 bits of the MD5 of
``key:b``), until it would leave the n shards.  With one more shard a key either stays or moves to the new one, and it
does so with probability 1 / (n + 1).  All of it is DataFrame expressions.

Defined cases: all null keys are the key of no characters and share one shard; null and empty texts have size 8 and the CRC of no bytes, 0; repeated rows
are rows of their own with slots of their own; an empty table gives no rows; input
columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygraph.llm import common


def shard_of(key: Column, *shards: int) -> Column:
    """The shard (int, 0 to n - 1) of a key for each number of shards n given: a
    struct of one field s<n> each, from one walk."""
    if min(shards) < 1:
        raise ValueError("shards must be at least 1")
    top, name = max(shards), F.coalesce(key.cast("string"), F.lit(""))

    def jump(state: Column, step: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), state["next"].cast("string")).cast("binary")), 1, 13), 16, 10).cast("double")
        target = F.least(F.floor((state["next"] + 1) * F.lit(float(1 << 52)) / (draw + 1)), F.lit(top).cast("long"))
        return F.struct(
            F.when(state["next"] < top, target).otherwise(state["next"]).alias("next"),
            *[F.when(state["next"] < n, state["next"]).otherwise(state[f"s{n}"]).alias(f"s{n}") for n in shards],
        )

    zero = F.lit(0).cast("long")
    end = F.aggregate(F.sequence(F.lit(1), F.lit(top)), F.struct(zero.alias("next"), *[zero.alias(f"s{n}") for n in shards]), jump)
    return F.struct(*[end[f"s{n}"].cast("int").alias(f"s{n}") for n in shards])


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """One row per input row: key, size, text_crc32, law ('key'), shard, slot (the
    place in its shard, gapless from 0, in the order of a hash of key and text, then of
    the key, then of the text's CRC) and grown_shard (the shard with one more)."""
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    at = shard_of(F.col("doc_id"), shards, shards + 1)
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        at[f"s{shards}"].alias("shard"),
        at[f"s{shards + 1}"].alias("grown_shard"),
        common.spread(F.concat_ws(":", "doc_id", "text_crc32")).alias("_h"),
        F.lit(1).cast("long").alias("_one"),
    )
    placed = common.running(rows, "_one", ["_h", "doc_id", "text_crc32"], ["shard"], rows=200_000)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("before").cast("long").alias("slot"), "grown_shard")
