"""Structured Streaming forms: windowed counts, degrees and edge weights that grow with
their input, and an append-only log that takes each key once.

Each runs until its input is used up (``availableNow``) and keeps its offsets and
state, or counts, under ``where``, so a later call goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, name: str, files: int = 64) -> DataFrame:
    """A table of a folder as a stream: one file, or a folder of them, called ``name``.parquet."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def totals(rows: DataFrame, where: str) -> DataFrame:
    """The result of a streaming aggregation once its input is used up. Only groups that
    a batch changed are written, by batch; a group's last batch holds."""
    spark = rows.sparkSession
    keep = where.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{keep}/out/batch={number:09d}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{keep}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.option("basePath", f"{keep}/out").parquet(f"{keep}/out/*")


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Each group as its last batch wrote it."""
    values = [c for c in written.columns if c not in (*keys, "batch")]
    g = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return g.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def event_windows(events: DataFrame, where: str, late: str = "1 day") -> DataFrame:
    """(start, event_type, n) by hour; rows later than the watermark are not waited for.
    Times without a zone are taken in the session's, which should be off UTC by whole hours."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
    return latest(totals(rows, where), ["start", "event_type"])


def counted(rows: DataFrame, keys: list[str], name: str, where: str) -> DataFrame:
    """(keys..., name): how many rows of the stream have each key. Counts add up, so no state is held: a batch
    writes its own counts, again if it runs again, and the result is their sum."""
    spark, keep = rows.sparkSession, where.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias(name)).write.mode("overwrite").parquet(f"{keep}/out/batch={number:09d}")

    rows.writeStream.option("checkpointLocation", f"{keep}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    written = spark.read.option("basePath", f"{keep}/out").parquet(f"{keep}/out/*")
    return written.groupBy(*keys).agg(F.sum(name).alias(name))


def edge_weights(pairs: DataFrame, where: str) -> DataFrame:
    """(src, dst, weight) of a stream of pairs in any order of their ends."""
    ends = pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return counted(ends, ["src", "dst"], "weight", where)


def degrees(edges: DataFrame, where: str) -> DataFrame:
    """(id, degree) of a stream of distinct edges."""
    return counted(edges.select(F.explode(F.array("src", "dst")).alias("id")), ["id"], "degree", where)


def log(spark: SparkSession, folder: str, schema: str, key: str, where: str) -> DataFrame:
    """Rows of a folder of JSON lines, each key once, appended to a table: finished keys
    are known from the stream's own state, also after a restart."""
    rows = spark.readStream.schema(schema).json(folder).dropDuplicates([key])
    sink = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/state").option("path", f"{where}/out")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out")
