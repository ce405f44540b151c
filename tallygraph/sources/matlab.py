"""Adjacency matrices of MATLAB level-5 files, without another library.

A file is a header and tagged elements; a compressed element holds another. Of a matrix
only its class, shape, name and places of non-zero entries are read. Each file is one task,
read as a whole as its compression asks; its entries leave in slices.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.model import canonical, ship
from tallygraph.operators.cover import largest_component

# Fixed values of the format: element types and what numpy calls them, kinds of elements, classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, SPARSE, NUMERIC = 14, 15, 5, range(6, 16)
HEADER = 128
#: Entries of a slice.
SLICE = 1 << 20


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, content) of the elements of a stretch; short ones hold theirs in the tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        if at + 8 + size > len(data):
            raise ValueError("the file ends inside an element")
        body = data[at + 8 : at + 8 + size]
        if kind == COMPRESSED:
            yield from _elements(memoryview(zlib.decompress(body)), order)
        else:
            yield kind, body
        at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def _numbers(element: tuple[int, memoryview], order: str) -> np.ndarray:
    kind, body = element
    if kind not in TYPES:
        raise ValueError(f"element type {kind} holds no numbers")
    return np.frombuffer(body, order + TYPES[kind])


def nonzeros(content: bytes, variable: str) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """Shape, rows and columns of the non-zero entries (complex ones by either part) of a
    dense or sparse numeric matrix. Names, classes and files that don't fit raise."""
    if len(content) < HEADER or content[126:128] not in (b"IM", b"MI"):
        raise ValueError("no level-5 file")
    order = "<" if content[126:128] == b"IM" else ">"
    names = []
    for kind, body in _elements(memoryview(content)[HEADER:], order):
        if kind != MATRIX:
            continue
        parts = list(_elements(body, order))
        if len(parts) < 3:
            continue
        flags = int(_numbers(parts[0], order)[0])
        shape, name = tuple(int(x) for x in _numbers(parts[1], order)), bytes(parts[2][1]).decode("ascii")
        names.append(name)
        if name != variable:
            continue
        if len(shape) != 2 or flags & 255 != SPARSE and flags & 255 not in NUMERIC:
            raise ValueError(f"{variable} is no numeric matrix")
        if flags & 255 == SPARSE:
            starts = _numbers(parts[4], order).astype(np.int64)
            count = int(starts[-1])
            rows, cols = _numbers(parts[3], order)[:count].astype(np.int64), np.repeat(np.arange(shape[1]), np.diff(starts))
            full = np.zeros(count, bool)
            for x in parts[5:]:
                full |= _numbers(x, order)[:count] != 0
            return shape, rows[full], cols[full]
        full = np.zeros(shape[0] * shape[1], bool)
        for x in parts[3:]:
            full |= _numbers(x, order) != 0
        at = np.flatnonzero(full)
        return shape, at % shape[0], at // shape[0]
    raise ValueError(f"no matrix {variable!r}; there are {names}")


def entries(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(file, n_rows, n_cols, row, col) of the non-zero entries, places from 0; a matrix
    without any has one row whose places are null."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                shape, rows, cols = nonzeros(content, variable)
                for at in range(0, max(len(rows), 1), SLICE):
                    part = {"row": pd.array(rows[at : at + SLICE], "Int64"), "col": pd.array(cols[at : at + SLICE], "Int64")} if len(rows) else {"row": pd.array([None], "Int64"), "col": pd.array([None], "Int64")}
                    yield pd.DataFrame({"file": file, "n_rows": shape[0], "n_cols": shape[1], **part})

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, n_rows long, n_cols long, row long, col long")


def summary(entries: DataFrame) -> DataFrame:
    """A row a file: shape, non-zero entries, those on the diagonal, and those whose
    mirror image is zero."""
    e = entries.where("row is not null")
    back = e.select("file", F.col("row").alias("col"), F.col("col").alias("row"), F.lit(1).alias("back"))
    sums = e.join(back, ["file", "row", "col"], "left").groupBy("file").agg(F.count("*").alias("nonzero"), F.count_if(F.col("row") == F.col("col")).alias("diagonal"), F.count_if(F.col("back").isNull()).alias("one_way"))
    shapes = entries.select("file", "n_rows", "n_cols").distinct()
    return shapes.join(sums, "file", "left").fillna(0, ["nonzero", "diagonal", "one_way"])


def adjacency(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Edges of the largest component: an entry either way is an edge, the diagonal none."""
    return largest_component(canonical(entries(spark, path, variable).where("row is not null"), "row", "col"))
