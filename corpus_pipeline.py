"""A corpus from raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all
rows of docs, and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``, whatever
other columns docs has and however these are named.

Defined cases, for every stage: null texts are empty ones; texts of any length are read
whole; an empty table gives an empty one; rows repeat as often as they came, but for the
near-duplicate stage, which keeps one of equal rows, and mixing, which may take a row
once an epoch. What a stage does with ties and null ids is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.llm import common, mixing, neardup, packing, pii, quality
from tallygraph.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go. A row is judged by its
    text alone, so equal texts share their fate, and a null id changes nothing but that
    its row has no label to learn from; without labels of both classes all rows have
    the share of label 1 as their score (0.5 without any label, and all go)."""
    labels = common.table(spark, sf_dir, "labels").where(~held_out())
    return quality.keep(docs.select(COLUMNS), quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 of five-word shingles the row with the smallest id
    stays; only linked rows go.

    A row is known by (doc_id, text), not by its id: rows of one id whose texts differ
    are compared like any others, a null id is larger than every other, and of equal
    rows one stays. Texts without words link with nothing: under a null id, which
    equals no other, each stays."""
    # Only these are many rows of one key and yet no copies, so they go past the rest.
    apart = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
    rows = docs.select(*COLUMNS, neardup.row_of("doc_id", "text").alias("_row")).where(~apart)
    found = neardup.near_duplicates(rows, n=5, hundredths=80).select("doc_id", "row", "component")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = found.groupBy("component").agg(first.alias("f")).select(F.col("f.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(COLUMNS).unionByName(docs.select(COLUMNS).where(apart))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; no document goes. Of overlapping
    spans the first gives its kind; the field is fitted on this stage's own input."""
    return pii.redact(docs.select(COLUMNS), pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's token prefix, from at most two seeded epochs. Null languages and sources
    are leaves of their own; rows equal in id and text are in either order."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens along the curve; a null id stays null, an empty
    text is its end id alone, and ties on the curve go by a hash, then by place."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hash orders, sketches, a trained model and tokenizer ids: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
