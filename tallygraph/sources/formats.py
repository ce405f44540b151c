"""More readers: bit matrices, packed text, named and weighted pairs, GraphML; sinks
for JSON lines and CSV, and comparison of contents."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygraph.model import canonical


def _binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """``parse`` of each whole file, on the executors."""

    def read(batches):
        for b in batches:
            for content in b.content:
                yield parse(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def bit_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Edges (ids from 0) of a DIMACS binary graph: the length of a text preamble and a
    line break, the preamble with ``p edge n m``, then the lower triangle row by row,
    each row in whole bytes, the highest bit first. Wrong sizes raise."""

    def parse(content: bytes) -> pd.DataFrame:
        size, rest = content.split(b"\n", 1)
        head, bits = rest[: int(size)], rest[int(size) :]
        found = re.search(rb"^p\s+\w+\s+(\d+)\s+(\d+)", head, re.M)
        n, m = int(found[1]), int(found[2])
        at, src, dst = 0, [], []
        for row in range(n):
            width = row // 8 + 1
            near = np.flatnonzero(np.unpackbits(np.frombuffer(bits[at : at + width], np.uint8))[: row + 1])
            at += width
            src.append(near)
            dst.append(np.full(len(near), row))
        out = pd.DataFrame({"src": np.concatenate(src or [[]]).astype(np.int64), "dst": np.concatenate(dst or [[]]).astype(np.int64)})
        if at != len(bits) or len(out) != m:
            raise ValueError(f"{len(bits)} bytes and {len(out)} edges; the preamble says {at} and {m}")
        return out

    return canonical(_binary(spark, path, parse, "src long, dst long"))


def graphml(spark: SparkSession, path: str) -> DataFrame:
    """Edges (names, the smaller first) of GraphML files."""
    text = spark.read.text(path, wholetext=True)
    edge = F.explode(F.regexp_extract_all("value", F.lit(r"(<edge\s[^>]*>)"), 1)).alias("e")
    name = lambda k: F.regexp_extract("e", rf'\s{k}\s*=\s*"([^"]*)"', 1).alias(k)
    return canonical(text.select(edge).select(name("source"), name("target")), "source", "target")


def packed_lines(spark: SparkSession, path: str, suffixes: tuple = (".edges", ".mtx", ".txt")) -> DataFrame:
    """(value, at): lines of the largest member with one of the suffixes, of each zip or
    tar archive (compressed or not)."""

    def parse(content: bytes) -> pd.DataFrame:
        if content[:2] == b"PK":
            z = zipfile.ZipFile(io.BytesIO(content))
            some = [i for i in z.infolist() if i.filename.endswith(suffixes)]
            data = z.read(max(some, key=lambda i: i.file_size)) if some else b""
        else:
            t = tarfile.open(fileobj=io.BytesIO(content))
            some = [i for i in t.getmembers() if i.isfile() and i.name.endswith(suffixes)]
            data = t.extractfile(max(some, key=lambda i: i.size)).read() if some else b""
        lines = data.decode("utf-8", "replace").splitlines()
        return pd.DataFrame({"value": pd.Series(lines, dtype="str"), "at": np.arange(len(lines))})

    return _binary(spark, path, parse, "value string, at long")


def pairs_of(lines: DataFrame) -> DataFrame:
    """Edges of lines ``a b ...`` or ``a,b,...``; comments and other lines are skipped, as is
    the size line of a coordinate file (its first line without a comment)."""
    rows = lines.where(~F.trim("value").rlike("^([%#]|$)"))
    head = lines.agg(F.count_if(F.col("value").startswith("%%MatrixMarket")).alias("mm")).crossJoin(rows.agg(F.min("at").alias("first")))
    parts = F.split(F.trim("value"), r"[,\s]+")
    pair = rows.crossJoin(F.broadcast(head)).where("mm = 0 or at <> first")  # head is one row
    pair = pair.select(F.try_element_at(parts, F.lit(1)).try_cast("long").alias("src"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("dst"))
    return canonical(pair.where("src is not null and dst is not null"))


def named_pairs(spark: SparkSession, path: str, a: str, b: str, kind: str | None = None, without: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(edges, names): pairs of names of a CSV with a header, rows of some kinds left
    out; names are numbered from 0 in their order, by ranks inside first letters."""
    rows = spark.read.csv(path, header=True)
    if kind:
        rows = rows.where(~F.coalesce(F.col(kind).isin(*without), F.lit(False)))
    rows = rows.select(F.trim(a).alias("a"), F.trim(b).alias("b")).where("a <> '' and b <> ''")
    names = rows.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("part", F.substring("name", 1, 2))
    counts = names.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    names = names.withColumn("r", rank).join(before, "part").select((F.col("r") + F.col("before")).cast("long").alias("id"), "name")
    e = rows.join(names.toDF("src", "a"), "a").join(names.toDF("dst", "b"), "b")
    return canonical(e), names


def associations(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(src, dst, weight) of lines ``cue, target, strength``: both directions' strengths are
    summed; lines without a number there, headers and markup among them, are skipped."""
    parts = F.split("value", sep)
    field = lambda i: F.trim(F.try_element_at(parts, F.lit(i)))
    rows = spark.read.text(path).select(field(1).alias("a"), field(2).alias("b"), field(3).try_cast("double").alias("w"))
    rows = rows.where("w is not null and a <> '' and b <> '' and a <> b")
    return rows.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("weight"))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def append_lines(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key the JSON lines don't have yet, and read all; NaN and the
    infinities are written as null."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).json(path)
        rows = rows.join(done.select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    schema = rows.schema
    rows.select(clean).write.mode("append").json(path)
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
