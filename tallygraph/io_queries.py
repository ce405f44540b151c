"""Queries of the readers: Spark writes the trade graph in a format, the reader reads it, and
the twin takes the tables. Files hold some FILE edges each, so no task writes or reads all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygraph.model import degrees
from tallygraph.operators.paths import _cut, scratch
from tallygraph.queries import FULL, query, rounded
from tallygraph.sources import files, formats, trade
from tallygraph.structure_queries import _WEIGHTED

#: Edges of a file, about.
FILE = 50_000


def _edges(spark, d):
    return _cut(trade.edges(spark, d))


def _written(rows: DataFrame, line: Column, make) -> str:
    """A folder of texts, one a bucket of rows: ``make`` of the number of lines and the lines,
    joined by line breaks, as columns n and body (and the bucket). Rows and not lines are dealt out, and
    files are compressed."""
    path = scratch(rows.sparkSession)
    buckets = max(3, rows.count() // FILE)
    texts = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)).alias("bucket"), "*").repartition("bucket").select("bucket", line.alias("line")).groupBy("bucket").agg(F.count("*").alias("n"), F.concat_ws("\n", F.collect_list("line")).alias("body"))
    texts.select("bucket", make.alias("value")).write.partitionBy("bucket").option("compression", "gzip").text(path)
    return path


@query(FULL + " SELECT src, dst FROM e")
def io_edge_list(spark, d):
    """Compressed lines of ids, commas in some and tabs in others."""
    e, path = _edges(spark, d), scratch(spark)
    line = F.concat(F.col("src").cast("string"), F.when(F.col("src") % 2 == 0, ",").otherwise("\t"), F.col("dst").cast("string"))
    e.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return files.edge_list(spark, path)


@query(FULL + " SELECT src, dst FROM e")
def io_matrix_market(spark, d):
    """Coordinate files that give their entries in each of the three ways."""
    line = F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.lit("2.5"))
    n, size = F.col("n").cast("string"), "99999999 99999999 "
    head = (
        F.when(F.col("bucket") % 3 == 0, F.concat(F.lit("%%MatrixMarket matrix coordinate real symmetric\n% a comment\n" + size), n))
        .when(F.col("bucket") % 3 == 1, F.concat(F.lit("%%MatrixMarket matrix coordinate real symmetric\n% " + size), n))
        .otherwise(F.concat(F.lit("% sym unweighted\n% "), n, F.lit(" 99999999 99999999")))
    )
    return files.matrix_market(spark, _written(_edges(spark, d), line, F.concat_ws("\n", head, "body")))


@query(FULL + " SELECT src, dst + 1000000 AS dst FROM e WHERE src % 3 = 0 AND dst % 3 = 1")
def io_bipartite(spark, d):
    """Customers and parts; each file's header says after how many left ids the right ones come."""
    line = F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"))
    head = F.concat(F.lit("% bip unweighted\n% "), F.col("n").cast("string"), F.lit(" 1000000 99999999"))
    return files.bipartite_tsv(spark, _written(_edges(spark, d).where("src % 3 = 0 and dst % 3 = 1"), line, F.concat_ws("\n", head, "body")))


@query(FULL + " SELECT src, dst FROM e")
def io_gml(spark, d):
    line = F.format_string("  edge [\n    source %d\n    target %d\n  ]", "src", "dst")
    return files.gml(spark, _written(_edges(spark, d), line, F.concat(F.lit("graph [\n  directed 0\n"), "body", F.lit("\n]"))))


@query(FULL + " SELECT src, dst FROM e")
def io_arrow(spark, d):
    line = F.format_string("%sEdge[%d, %d],", F.when(F.col("src") % 2 == 0, "Directed").otherwise("Undirected"), "dst", "src")
    return files.arrow_graph(spark, _written(_edges(spark, d), line, F.concat(F.lit("Graph[{1, 2,\n3}, {"), "body", F.lit("}]"))))


@query(FULL + _WEIGHTED + " SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, weight * 1.5::DOUBLE AS weight FROM (SELECT least(src::VARCHAR, dst::VARCHAR) AS src, greatest(src::VARCHAR, dst::VARCHAR) AS dst, weight FROM w)")
def io_associations(spark, d):
    """Strengths of cue and target from two directions; lines of markup are skipped."""
    w = _cut(trade.weighted(spark, d))
    line = F.format_string("%d, %d, %s\n%d, %d, %s", "src", "dst", F.col("weight").cast("string"), "dst", "src", (F.col("weight") / 2).cast("string"))
    return formats.associations(spark, _written(w, line, F.concat(F.lit("<HTML>\nCUE, TARGET, STRENGTH\n"), "body")))


@query(
    "WITH p AS (SELECT DISTINCT c_name AS a, s_name AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <> 1),"
    " n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT a AS name FROM p UNION SELECT b FROM p)) SELECT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst FROM p JOIN n x ON x.name = a JOIN n y ON y.name = b"
)
def io_named_pairs(spark, d):
    """Customers' and suppliers' names of line items, those of one kind left out, as a CSV with a header."""
    read = lambda t, *c: trade.read(spark, d, t).select(*c)
    x = read("lineitem", "l_orderkey", "l_suppkey", "l_linenumber").join(read("orders", "o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).join(read("customer", "c_custkey", "c_name"), F.expr("c_custkey = o_custkey")).join(read("supplier", "s_suppkey", "s_name"), F.expr("s_suppkey = l_suppkey"))
    path = scratch(spark)
    formats.write_csv(x.select(F.col("c_name").alias("pre"), F.col("s_name").alias("post"), F.col("l_linenumber").cast("string").alias("kind")), path)
    return formats.named_pairs(spark, path, "pre", "post", "kind", ("1",))[0]


@query(FULL + " SELECT id, degree FROM deg")
def io_append(spark, d):
    """JSON lines written in two goes: what the first wrote is not written again."""
    g, path = _cut(degrees(trade.edges(spark, d))), scratch(spark)
    formats.append_lines(g.where("id % 2 = 0"), path, "id")
    return rounded(formats.append_lines(g, path, "id"))
