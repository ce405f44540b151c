"""Readers of graph files as edge tables, and writers.

Text formats are parsed by Spark's own text scan and string functions, line by
line or file by file; binary archives by numpy on the executors.  Every reader
gives canonical edges: no loops, no repeats, the smaller id first.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.model import GraphTables, canonical


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Pairs split by commas or white space; lines of % or #, blank ones, and those
    that don't begin with two integers are skipped. Compressed files are read too."""
    line = F.trim("value")
    parts = F.split(line, r"[,\s]+")
    pair = spark.read.text(path).where(~line.rlike("^([%#]|$)")).select(F.try_element_at(parts, F.lit(1)).try_cast("long").alias("src"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("dst"))
    return canonical(pair.where("src is not null and dst is not null"))


#: Three whole numbers of a size line, behind a comment sign or not.
_SIZES = r"^[%\s]*\d+\s+\d+\s+\d+\s*$"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank: file, at (their order inside a file), value, comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return lines.where("value <> ''").withColumn("comment", F.col("value").startswith("%"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Pattern of 1-based coordinate files as an undirected graph. A file gives its number of
    entries in one of three ways: in the size line, the first without a comment, behind a header that
    names the format; by a comment of three numbers, the last of these, behind such a header; or, behind
    another header, by the first number of the comment that follows. Another number of entries raises."""
    lines = _numbered(spark, path)
    head = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("top"))
    after = lines.join(head, "file").where("at > top")
    sized = F.when(F.col("comment") & F.col("value").rlike(_SIZES), F.col("at"))
    sums = after.groupBy("file", "header").agg(
        F.count_if(~F.col("comment")).alias("n"), F.min(F.when(~F.col("comment"), F.col("at"))).alias("first"), F.min_by("value", F.when(~F.col("comment"), F.col("at"))).alias("size_line"),
        F.max_by("value", sized).alias("last_comment"), F.min_by("value", sized).alias("first_comment"),
    )
    number = lambda c, i: F.regexp_extract(c, r"^[%\s]*(\d+)\s+(\d+)\s+(\d+)", i).try_cast("long")
    market = F.col("header").contains("MatrixMarket")
    plain = market & F.coalesce(number("size_line", 3) == F.col("n") - 1, F.lit(False))
    want = F.when(~market, number("first_comment", 1)).when(plain, F.col("n") - 1).otherwise(number("last_comment", 3))
    sums = sums.select("file", "n", F.when(plain, F.col("first")).alias("skip"), want.alias("want"))
    wrong = F.concat(F.lit("entries "), (F.col("n") - F.col("skip").isNotNull().cast("long")).cast("string"), F.lit(", size line "), F.coalesce(F.col("want").cast("string"), F.lit("none")), F.lit(": "), F.col("file"))
    fine = F.coalesce(F.col("want") == F.col("n") - F.col("skip").isNotNull().cast("long"), F.lit(False))
    sums = sums.select("file", "skip", F.when(fine, F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean")).alias("fine"))
    entries = lines.where("not comment").join(sums, "file").where("fine and (skip is null or at <> skip)")
    parts = F.split("value", r"\s+")
    return canonical(entries.select((parts[0].cast("long") - 1).alias("src"), (parts[1].cast("long") - 1).alias("dst")))


def bipartite_tsv(spark: SparkSession, path: str, left: int | None = None) -> DataFrame:
    """Pairs (left id, right id) of bipartite files; right ids come after the ``left`` left ones,
    which each file's comment of three numbers (pairs, left, right) tells if it isn't given."""
    parts = F.split("value", r"\s+")
    lines = _numbered(spark, path)
    if left is not None:
        lines = lines.withColumn("left", F.lit(left))
    else:
        sized = F.when(F.col("comment") & F.col("value").rlike(_SIZES), F.col("at"))
        count = F.regexp_extract(F.min_by("value", sized), r"^[%\s]*\d+\s+(\d+)", 1).try_cast("long")
        heads = lines.groupBy("file").agg(count.alias("left"))
        lines = lines.join(heads.select("file", F.coalesce("left", F.raise_error(F.concat(F.lit("no comment of three numbers: "), F.col("file"))).cast("long")).alias("left")), "file")
    return canonical(lines.where("not comment").select(parts[0].cast("long").alias("src"), (parts[1].cast("long") + F.col("left")).alias("dst")))


def gml(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    both = F.arrays_zip(F.regexp_extract_all("value", F.lit(r"source\s+(\d+)"), 1).alias("s"), F.regexp_extract_all("value", F.lit(r"target\s+(\d+)"), 1).alias("t"))
    return canonical(text.select(F.explode(both).alias("e")).select(F.col("e.s").cast("long").alias("src"), F.col("e.t").cast("long").alias("dst")))


def adjacency_json(spark: SparkSession, path: str) -> DataFrame:
    """Edges of ``adjacencyList``, a list of neighbour lists."""
    rows = spark.read.schema("adjacencyList array<array<bigint>>").json(path, multiLine=True)
    lists = rows.select(F.posexplode("adjacencyList").alias("src", "near"))
    return canonical(lists.select(F.col("src").cast("long").alias("src"), F.explode("near").alias("dst")))


#: An edge of the arrow text, and the whole text: vertices, then edges.
_ARC, _ARROWS = r"(?:Directed|Undirected)Edge\[\s*(\d+\s*,\s*\d+)\s*\]", r"(?s)^\s*Graph\[\s*\{[\d\s,]*\}\s*,\s*\{(.*)\}\s*\]\s*$"


def arrow_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of ``Graph[{ids},{DirectedEdge[a, b],...}]``; opposite arcs are one edge. A text of
    another form, or with anything else between the edges, raises."""
    text = spark.read.text(path, wholetext=True).select("value", F.regexp_extract("value", _ARROWS, 1).alias("body"))
    left = F.regexp_replace(F.regexp_replace("body", _ARC, ""), r"[\s,]+", "")
    fine = F.col("value").rlike(_ARROWS) & (left == "")
    arcs = F.when(fine, F.regexp_extract_all("body", F.lit(_ARC), 1)).otherwise(F.raise_error(F.concat(F.lit("no arrow graph: "), F.substring(F.when(left == "", F.col("value")).otherwise(left), 1, 40))).cast("array<string>"))
    pair = F.split("arc", r"\s*,\s*")
    return canonical(text.select(F.explode(arcs).alias("arc")).select(pair[0].cast("long").alias("src"), pair[1].cast("long").alias("dst")))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Edges of .npz archives: the array ``edges``, or else masks between three
    colour classes, a mask's rows of the higher class and its columns of the lower."""

    def read(batches):
        for batch in batches:
            for content in batch.content:
                z = np.load(io.BytesIO(content))
                if "edges" in z:
                    e = z["edges"].astype(np.int64)
                else:
                    n = [int(z[f"n{i}"]) for i in (1, 2, 3)]
                    first = [0, n[0], n[0] + n[1]]
                    parts = []
                    for a, b in ((0, 1), (0, 2), (1, 2)):
                        row, col = np.nonzero(z[f"mask_{a + 1}{b + 1}"])
                        parts.append(np.stack([first[a] + col, first[b] + row], 1))
                    e = np.concatenate(parts).astype(np.int64)
                yield pd.DataFrame({"src": e[:, 0], "dst": e[:, 1]})

    return canonical(spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "src long, dst long"))


def layered(spark: SparkSession, path: str) -> GraphTables:
    """Vertices (id, colour) and edges (src, dst, layer) of .npz archives: ids run over
    n_total, or n1 + n2 + n3, or the largest id, isolates too; colours follow the class
    sizes, thirds without any; a layer names an edge's two classes, the lower first."""

    def read(batches):
        for batch in batches:
            for content in batch.content:
                z = np.load(io.BytesIO(content))
                given = all(f"n{i}" in z for i in (1, 2, 3))
                n = [int(z[f"n{i}"]) for i in (1, 2, 3)] if given else None
                total = int(z["n_total"]) if "n_total" in z else sum(n) if n else int(z["edges"].max(initial=-1)) + 1
                n = n or [total // 3, total // 3, total - 2 * (total // 3)]
                yield pd.DataFrame({"id": np.arange(total), "colour": np.searchsorted(np.cumsum(n)[:2], np.arange(total), "right")})

    vertices = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "id long, colour long")
    c = vertices.select("id", (F.col("colour") + 1).cast("string").alias("c"))
    e = archive(spark, path).join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst")
    return GraphTables(vertices, e.select("src", "dst", F.concat(F.least("a", "b"), F.greatest("a", "b")).alias("layer")))


def gml_tables(spark: SparkSession, path: str) -> GraphTables:
    """Vertices (id, label; isolates too) and edges of a GML file, opposite and repeated
    edges collapsed, loops dropped."""
    text = spark.read.text(path, wholetext=True)
    node = F.explode(F.regexp_extract_all("value", F.lit(r"node\s*\[([^\]]*)\]"), 1)).alias("node")
    label = F.regexp_extract("node", r'label\s+"([^"]*)"', 1)
    rows = text.select(node).select(F.regexp_extract("node", r"\bid\s+(\d+)", 1).cast("long").alias("id"), F.when(label != "", label).alias("label"))
    return GraphTables(rows, gml(spark, path))


def with_policy(graph: GraphTables, isolates: bool = True, component: bool = False) -> GraphTables:
    """The graph with or without its isolates, or its largest component alone."""
    from tallygraph.operators.cover import largest_component

    edges = largest_component(graph.edges.select("src", "dst")) if component else graph.edges
    if isolates and not component:
        return GraphTables(graph.vertices, edges)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return GraphTables(graph.vertices.join(ids, "id", "left_semi"), edges)


#: Edges that a single archive may hold.
MOST_EDGES = 50_000_000


def write_archive(edges: DataFrame, n_total: int, path: str) -> None:
    """One .npz, for graphs that fit on the driver."""
    from tallygraph.sources.reports import put

    e = edges.select("src", "dst").limit(MOST_EDGES + 1).toArrow()
    if e.num_rows > MOST_EDGES:
        raise ValueError(f"an archive holds at most {MOST_EDGES} edges")
    pair = np.stack([e.column("src").to_numpy(), e.column("dst").to_numpy()], 1).astype(np.int64)
    buffer = io.BytesIO()
    np.savez_compressed(buffer, edges=pair[np.lexsort((pair[:, 1], pair[:, 0]))], n_total=n_total)
    put(edges.sparkSession, path, buffer.getvalue())
