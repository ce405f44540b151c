"""Sinks for results of a few rows, archives of masks, and image shards."""

from __future__ import annotations

import io
import json
import math

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallygraph.operators.construct import class_ids

#: Cells of a mask, and rows of a report, at most.
MOST_CELLS, MOST_ROWS = 400_000_000, 10_000


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file to any store that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def plain(value):
    """Values for JSON: rows are objects, NaN and the infinities null."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _few(df: DataFrame) -> list[Row]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return rows


def json_report(sections: dict[str, DataFrame], path: str) -> dict:
    """One JSON document, indented by two: a section of one row is an object, of more a
    list. Returns what it wrote."""
    doc = {}
    for name, df in sections.items():
        rows = [plain(r) for r in _few(df)]
        doc[name] = rows[0] if len(rows) == 1 else rows
    put(next(iter(sections.values())).sparkSession, path, json.dumps(doc, indent=2, allow_nan=False).encode())
    return doc


def text_table(df: DataFrame, title: str = "", digits: int = 4) -> str:
    """A table of aligned columns: text to the left, numbers to the right."""

    def show(v) -> str:
        return "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    rows = [[show(v) for v in r] for r in _few(df)]
    left = [t in ("string", "boolean") for _, t in df.dtypes]
    width = [max(len(x) for x in col) for col in zip(df.columns, *rows)]
    line = lambda cells: "  ".join(c.ljust(w) if a else c.rjust(w) for c, w, a in zip(cells, width, left)).rstrip()
    return "\n".join([*([title, "=" * len(title)] if title else []), line(df.columns), "  ".join("-" * w for w in width), *map(line, rows)])


def write_masks(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """An .npz archive of three 0/1 masks between classes of vertices (id, colour 0 to 2),
    rows of the higher class: vertices are numbered inside their class by id. Edges
    inside a class, or masks of too many cells, raise."""
    c = class_ids(vertices.select("id", "colour"))
    size = {r.colour: r.n for r in c.groupBy("colour").agg(F.count("*").alias("n")).collect()}  # three classes
    n = [size.get(i, 0) for i in range(3)]
    if max(n[0] * n[1], n[0] * n[2], n[1] * n[2]) > MOST_CELLS:
        raise ValueError(f"a mask has at most {MOST_CELLS} cells")
    e = edges.join(c.toDF("src", "ca", "pa"), "src").join(c.toDF("dst", "cb", "pb"), "dst").select("ca", "pa", "cb", "pb").toArrow()
    ca, pa_, cb, pb = (e.column(k).to_numpy() for k in ("ca", "pa", "cb", "pb"))
    if (ca == cb).any():
        raise ValueError("an edge lies inside a class")
    turn = ca > cb
    low, high, col, row = np.where(turn, cb, ca), np.where(turn, ca, cb), np.where(turn, pb, pa_), np.where(turn, pa_, pb)
    out = {f"n{i + 1}": np.int64(n[i]) for i in range(3)}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        mask = np.zeros((n[b], n[a]), np.uint8)
        on = (low == a) & (high == b)
        mask[row[on], col[on]] = 1
        out[f"mask_{a + 1}{b + 1}"] = mask
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **out)
    put(edges.sparkSession, path, buffer.getvalue())


def image_shards(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of Parquet shards whose column ``image`` is a struct with ``bytes``."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("image.bytes").alias("bytes"))


def first_source(spark: SparkSession, *paths: str | None) -> DataFrame:
    """The first of the given paths that is set; one that is set but cannot be read raises
    and never gives way to the next."""
    for path in paths:
        if path:
            return spark.read.parquet(path)
    raise ValueError("no path is set")
