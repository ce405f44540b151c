"""More registered queries: audits, comparisons, covers, spectra, displays and sweeps.

Many run on the label graph: nations of customers and suppliers and brands of parts, by
vertex colour, joined where their vertices are, from all line items; its heaviest quarter
of edges. It is small enough for exact paths in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygraph.kernels import seeds
from tallygraph.model import degrees
from tallygraph.operators import communities, cover, display, ensemble, layers, paths, richclub, spectra, structure, sweeps, triangles
from tallygraph.operators.inference import hubs_above
from tallygraph.operators.paths import _cut
from tallygraph.plans import audit, compare, inference
from tallygraph.queries import FULL, HOPS, LABELS, ORACLE_SQL, QUERIES, SUMMARY, TRI, query, rounded
from tallygraph.sources import trade
from tallygraph.structure_queries import BRIDGES

__all__ = ["ORACLE_SQL", "QUERIES"]

_WEIGHTS = ", q AS (SELECT least(x.label * 3 + src % 3, y.label * 3 + dst % 3) AS src, greatest(x.label * 3 + src % 3, y.label * 3 + dst % 3) AS dst, count(*) AS weight FROM e JOIN lab x ON x.id = src JOIN lab y ON y.id = dst GROUP BY 1, 2)"
_KEPT = (
    ", hw AS (SELECT weight, sum(n) OVER (ORDER BY weight DESC) - n AS above, sum(n) OVER () AS t FROM (SELECT weight, count(*) AS n FROM q GROUP BY 1)), cw AS (SELECT weight AS c FROM hw ORDER BY round(abs(above / t - 0.25), 12), weight LIMIT 1)"
    ", g AS (SELECT src, dst, weight FROM q, cw WHERE weight > c), gs AS (SELECT src AS id, dst AS other FROM g UNION ALL SELECT dst, src FROM g), gd AS (SELECT id, count(*) AS degree FROM gs GROUP BY 1)"
)
GRAPH = FULL + LABELS + _WEIGHTS + _KEPT
#: Distances of the label graph, level by level; far more levels than it has.
_LEVELS = 8
_DIST = ", d0 AS (SELECT id AS s, id AS v, 0 AS d, 1.0::DOUBLE AS w FROM gd)" + "".join(
    f", n{i} AS (SELECT f.s, gs.other AS v, {i} AS d, sum(f.w) AS w FROM d{i - 1} f JOIN gs ON gs.id = f.v WHERE f.d = {i - 1} AND NOT EXISTS (SELECT 1 FROM d{i - 1} o WHERE o.s = f.s AND o.v = gs.other) GROUP BY 1, 2), d{i} AS (SELECT * FROM d{i - 1} UNION ALL SELECT * FROM n{i})"
    for i in range(1, _LEVELS + 1)
).replace(" AS (SELECT", " AS MATERIALIZED (SELECT") + f", dist AS (SELECT * FROM d{_LEVELS}), hist AS (SELECT d::BIGINT AS d, count(*) AS pairs FROM dist WHERE d > 0 GROUP BY 1)"
PATHS = GRAPH + _DIST


def label_weights(spark, d):
    """(src, dst, weight) of the label graph, all edges."""
    lab = trade.nation_labels(spark, d).select("id", (F.col("label") * 3 + F.col("id") % 3).alias("label"))
    return communities.quotient(trade.edges(spark, d), lab).toDF("src", "dst", "weight")


def label_graph(spark, d):
    return _cut(audit.keep_share(_cut(label_weights(spark, d)), 0.25))


def _bare(spark, d):
    return label_graph(spark, d).select("src", "dst")


@query(GRAPH + " SELECT src, dst, weight FROM g")
def label_edges(spark, d):
    return label_graph(spark, d)


@query(PATHS + " SELECT d, pairs FROM hist")
def label_distances(spark, d):
    return ensemble.distance_histogram(_bare(spark, d))


@query(PATHS + " SELECT s AS source, v AS id, d::BIGINT AS d FROM dist")
def label_distance_pairs(spark, d):
    """By joins, a frontier a round."""
    e = _bare(spark, d)
    return paths.distances(e, degrees(e)).select("source", "id", F.col("d").cast("long").alias("d"))


@query(PATHS + HOPS)
def label_hops(spark, d):
    return rounded(paths.hop_plot(ensemble.distance_histogram(_bare(spark, d))))


@query(PATHS + SUMMARY.format("gd"))
def label_paths(spark, d):
    e = _bare(spark, d)
    h = _cut(ensemble.distance_histogram(e))
    return rounded(paths.path_summary(h, degrees(e).count()).crossJoin(paths.effective_diameter(h)))


_PLACE = ", pl AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vertex FROM gd)"
_BETWEEN = _PLACE + ", bt AS (SELECT a.v, sum(a.w * b.w / c.w) AS b FROM dist a JOIN dist b ON b.s = a.v JOIN dist c ON c.s = a.s AND c.v = b.v WHERE a.d > 0 AND b.d > 0 AND a.d + b.d = c.d GROUP BY 1)"


@query(PATHS + _BETWEEN + " SELECT vertex, round(coalesce(b, 0) / (((SELECT count(*) FROM gd) - 1) * ((SELECT count(*) FROM gd) - 2)), 8) AS betweenness FROM pl LEFT JOIN bt ON v = id")
def label_betweenness(spark, d):
    return rounded(ensemble.betweenness(_bare(spark, d)))


@query(PATHS + _PLACE + ", eb AS (SELECT g.src, g.dst, sum(CASE WHEN a.d + 1 + b.d = c.d THEN a.w * b.w / c.w ELSE 0 END) AS b FROM g JOIN dist a ON a.v IN (g.src, g.dst) JOIN dist b ON b.s = CASE WHEN a.v = g.src THEN g.dst ELSE g.src END JOIN dist c ON c.s = a.s AND c.v = b.v GROUP BY 1, 2) SELECT x.vertex AS src, y.vertex AS dst, round(b / ((SELECT count(*) FROM gd) * ((SELECT count(*) FROM gd) - 1)), 8) AS betweenness FROM eb JOIN pl x ON x.id = eb.src JOIN pl y ON y.id = eb.dst WHERE b > 0")
def label_edge_betweenness(spark, d):
    return rounded(structure.edge_betweenness(_bare(spark, d)))


@query(PATHS + " SELECT s AS id, min(v) AS component FROM dist GROUP BY 1")
def label_components(spark, d):
    return paths.components(_bare(spark, d))


_TRI = TRI.split(", tv AS")[0].replace("FROM e x JOIN e y", "FROM g x JOIN g y").replace("JOIN e z", "JOIN g z")


@query(GRAPH.replace("WITH", "WITH RECURSIVE", 1) + _TRI + BRIDGES.format("g", "gs", "gd"))
def label_bridges(spark, d):
    return structure.bridges(_bare(spark, d))


@query(FULL + TRI + ", p AS (SELECT a AS src, b AS dst FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri) SELECT * FROM (SELECT 3::BIGINT AS size, (SELECT count(*) FROM tri) AS cliques UNION ALL SELECT 2, (SELECT count(*) FROM e ANTI JOIN p USING (src, dst))) WHERE cliques > 0")
def clique_census(spark, d):
    """The trade graph has three colours, so no clique has four vertices."""
    return triangles.clique_census(trade.edges(spark, d).withColumn("graph", F.lit(0)), "graph").drop("graph")


_PART = ", p AS (SELECT a AS src, b AS dst FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri), lone AS (SELECT src, dst FROM e ANTI JOIN p USING (src, dst)), pc AS (SELECT deg.id, degree, coalesce(t, 0) + (SELECT count(*) FROM lone WHERE lone.src = deg.id OR lone.dst = deg.id) AS cliques FROM deg LEFT JOIN tv USING (id))"


@query(FULL + TRI + _PART + " SELECT row_number() OVER (ORDER BY id) - 1 AS vertex, degree, cliques::BIGINT AS cliques FROM pc")
def clique_participation(spark, d):
    return triangles.participation(trade.edges(spark, d))


@query(
    FULL + TRI + _PART + ", x AS (SELECT degree::DOUBLE AS d, cliques::DOUBLE AS c FROM pc), o AS (SELECT avg(c) AS mean, stddev_pop(c) AS std FROM x)"
    " SELECT round(avg(c), 8) AS mean, round(stddev_pop(c), 8) AS std, round(quantile_cont(c, 0.5), 8) AS median, max(c) AS max, count(*) FILTER (c > (SELECT mean + 2 * std FROM o)) AS high, round(avg((c > (SELECT mean + 2 * std FROM o))::INT), 8) AS high_share, round(corr(c, d), 8) AS degree_correlation,"
    " (SELECT round(2 * sum(c * i) / (count(*) * sum(c)) - (count(*) + 1) / count(*), 8) FROM (SELECT c, row_number() OVER (ORDER BY c) AS i FROM x)) AS gini FROM x"
)
def participation_summary(spark, d):
    return rounded(audit.participation_table(_cut(triangles.participation(trade.edges(spark, d)))))


@query(
    FULL + ", h AS (SELECT degree // 10 AS x, count(*) AS y FROM deg GROUP BY 1), gr AS (SELECT r.x, coalesce(h.y, 0) AS y FROM (SELECT unnest(range((SELECT min(x) FROM h), (SELECT max(x) + 1 FROM h))) AS x) r LEFT JOIN h USING (x)),"
    " nb AS (SELECT x, y, lag(y) OVER (ORDER BY x) AS l, lead(y) OVER (ORDER BY x) AS r FROM gr), tp AS (SELECT x, y, row_number() OVER (ORDER BY y DESC, x) AS k FROM nb WHERE (SELECT count(*) FROM h) >= 3 AND (l IS NOT NULL OR r IS NOT NULL) AND coalesce(y > l, true) AND coalesce(y > r, true)),"
    " two AS (SELECT min(x) AS a, max(x) AS b, min(y) AS low, count(*) AS n FROM tp WHERE k <= 2), va AS (SELECT min(y) AS v FROM gr, two WHERE n = 2 AND x >= a AND x <= b)"
    " SELECT (SELECT x FROM h ORDER BY y DESC, x LIMIT 1)::BIGINT AS fullest, CASE WHEN n = 2 THEN a END::BIGINT AS first, CASE WHEN n = 2 THEN b END::BIGINT AS second, CASE WHEN n = 2 AND low > 0 THEN round(v / low, 8) END AS ratio, coalesce(CASE WHEN n = 2 AND low > 0 THEN v / low END < 0.5, false) AS bimodal FROM two, va"
)
def degree_bimodality(spark, d):
    h = degrees(trade.edges(spark, d)).groupBy(F.expr("degree div 10").alias("x")).agg(F.count("*").alias("y"))
    return rounded(audit.bimodality(_cut(h), "x", "y"))


@query(FULL + ", c AS (SELECT id % 3 AS colour, count(*) AS n FROM deg GROUP BY 1), w AS (SELECT count(*) FILTER (src % 3 = dst % 3) AS wrong FROM e) SELECT CASE WHEN wrong = 0 AND (SELECT count(*) FROM c) >= 2 AND (SELECT min(n) FROM c) > 1 THEN 'layered' ELSE 'plain' END AS kind, wrong FROM w")
def null_kind(spark, d):
    e = _cut(trade.edges(spark, d))
    return audit.null_kind(e, degrees(e).select("id", (F.col("id") % 3).alias("colour")))


_WEIGHTED = ", w AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM (SELECT o_custkey * 3 AS a, l_partkey * 3 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey * 3, l_suppkey * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT l_partkey * 3 + 1, l_suppkey * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2)"


@query(FULL + _WEIGHTED + " SELECT round(a, 8) AS ones, round(b, 8) AS others, round(abs(a - b), 8) AS floor FROM (SELECT avg((weight = 1)::INT) AS a FROM w WHERE src % 3 = 0 OR dst % 3 = 0), (SELECT avg((weight <= 1)::INT) AS b FROM w WHERE src % 3 <> 0 AND dst % 3 <> 0)")
def ks_floor(spark, d):
    """Weights of edges at customers against those between parts and suppliers."""
    w = _cut(trade.weighted(spark, d))
    at = (F.col("src") % 3 == 0) | (F.col("dst") % 3 == 0)
    return rounded(audit.ks_floor(w.where(at), w.where(~at), "weight"))


@query(
    "WITH r AS (SELECT o_orderpriority AS arm, o_custkey AS seed, count(*) AS orders, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2), j AS (SELECT x.orders = y.orders AS m, x.value AS va, y.value AS vb FROM r x JOIN r y USING (seed) WHERE x.arm = '1-URGENT' AND y.arm = '5-LOW')"
    " SELECT count(*) FILTER (m) AS pairs, count(*) FILTER (NOT m) AS unmatched, round(avg(va) FILTER (m), 4) AS mean_a, round(avg(vb) FILTER (m), 4) AS mean_b, round(avg(va - vb) FILTER (m), 4) AS change, round(stddev_samp(va - vb) FILTER (m), 4) AS sd, round(avg(100 * (va - vb) / vb) FILTER (m AND vb <> 0), 4) AS per_cent FROM j"
)
def paired_priorities(spark, d):
    """Mean order value of two priorities, paired by customer, where the customer has as
    many orders of both."""
    o = trade.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("seed")).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("value"))
    return rounded(compare.paired(o, "1-URGENT", "5-LOW", "orders", "value"), 4)


@query("WITH RECURSIVE z AS (SELECT 1)" + LABELS.split(", el AS")[0] + ", n AS (SELECT label, count(*) AS n, count(DISTINCT id % 3) AS parts FROM lab GROUP BY 1) SELECT count(*) AS labels, min(n) AS smallest, quantile_cont(n, 0.5) AS median, max(n) AS largest, round(stddev_pop(n), 8) AS sd FROM n")
def label_sizes(spark, d):
    return rounded(compare.partition_sizes(trade.nation_labels(spark, d)))


@query("WITH RECURSIVE z AS (SELECT 1)" + LABELS.split(", el AS")[0] + ", n AS (SELECT label, count(*) AS n, count(DISTINCT id % 3) AS parts FROM lab GROUP BY 1) SELECT count(*) AS labels, count(*) FILTER (parts > 1) AS straddling, coalesce(sum(n) FILTER (parts > 1), 0)::BIGINT AS vertices FROM n")
def label_straddling(spark, d):
    lab = trade.nation_labels(spark, d)
    return compare.straddling(lab, trade.colours(lab))


@query(FULL + LABELS + " SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS witness FROM el GROUP BY 1, 2")
def quotient_inside(spark, d):
    return compare.quotient_with_inside(trade.edges(spark, d), trade.nation_labels(spark, d))


#: Null curves that both engines can make: the real one, moved by a rule.
_MOVE = "phi * (1 + ((k * 7919 + null_id * 104729 + {0}) % 101 - 50) / 250.0)"
_CLUB = (
    FULL + ", ks AS (SELECT unnest(range(0, (SELECT max(degree) FROM deg))) AS k), dh AS (SELECT degree, count(*) AS n FROM deg GROUP BY 1), eh AS (SELECT least(du, dv) AS degree, count(*) AS n FROM ends GROUP BY 1)"
    ", ph AS (SELECT k, (SELECT coalesce(sum(n), 0) FROM dh WHERE degree > k)::BIGINT AS n_above, (SELECT coalesce(sum(n), 0) FROM eh WHERE degree > k)::BIGINT AS e_above FROM ks), pc AS (SELECT k, n_above, 2.0 * e_above / (n_above * (n_above - 1)) AS phi FROM ph WHERE n_above >= 2)"
)


def _table_sql(name: str, shift: int) -> str:
    return f", nu_{name} AS (SELECT k, null_id, {_MOVE.format(shift)} AS x FROM pc, range(20) r(null_id)), {name} AS (SELECT k, phi, n_above, avg(x) AS mean, stddev_samp(x) AS std, CASE WHEN avg(x) > 0 THEN phi / avg(x) END AS rho, (1 + count(*) FILTER (x >= phi)) / (1 + count(*)) AS p FROM nu_{name} JOIN pc USING (k) GROUP BY 1, 2, 3)"


def _club(spark, d, shift=0, real=None):
    if real is None:
        real = _cut(richclub.phi(_cut(trade.edges(spark, d))))
    nulls = real.select("k", "phi", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("null_id")).selectExpr("null_id", "k", _MOVE.format(shift) + " AS phi")
    return real, _cut(nulls)


@query(_CLUB + _table_sql("a", 0) + " SELECT k, round(phi, 8) AS phi, round(mean, 8) AS mean, round(std, 8) AS std, round(rho, 7) AS rho, round(p, 8) AS p FROM a")
def club_table(spark, d):
    """The null table of a rich club against null curves made by a rule."""
    real, nulls = _club(spark, d)
    t = richclub.null_table(nulls, real)
    return rounded(t.withColumn("rho", F.round("rho", 7)))


_RUN = "(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS s FROM o WHERE {0}) GROUP BY s))"


@query(_CLUB + _table_sql("a", 0) + ", o AS (SELECT k, n_above, rho > 1 AND p < 0.3 AS sig FROM a) SELECT count(*) FILTER (sig) AS significant, " + _RUN.format("sig") + " AS run, count(*) FILTER (sig AND n_above >= 20) AS significant_floored, " + _RUN.format("sig AND n_above >= 20") + " AS run_floored, coalesce(max(k) FILTER (n_above >= 20), 0) AS highest_k FROM o")
def club_floored(spark, d):
    real, nulls = _club(spark, d)
    return rounded(compare.floored_club(nulls, real, alpha=0.3))


_AT = "(SELECT s.size, arg_min({{'k': k, 'rho': rho}}, {{'d': abs(n_above - s.size), 'm': -n_above, 'k': k}}) AS x FROM {0}, (VALUES (10), (50), (200)) s(size) GROUP BY 1)"


@query(_CLUB + _table_sql("a", 0) + _table_sql("b", 31) + f" SELECT u.size::BIGINT AS size, u.x.k AS k_x, round(u.x.rho, 7) AS rho_x, v.x.k AS k_y, round(v.x.rho, 7) AS rho_y, round(v.x.rho - u.x.rho, 7) AS change FROM {_AT.format('a')} u JOIN {_AT.format('b')} v USING (size)")
def club_comparison(spark, d):
    """Two runs at matched club sizes."""
    tables, real = [], None
    for shift in (0, 31):
        real, nulls = _club(spark, d, shift, real)
        tables.append(_cut(richclub.null_table(nulls, real).join(real.select("k", "n_above"), "k")))
    return rounded(compare.compare_clubs(*tables, [10, 50, 200]), 7)


@query(_CLUB + _table_sql("a", 0) + ", r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM a), q AS (SELECT k, p, least(1, min(p * n / i) OVER (ORDER BY i DESC)) AS q FROM r) SELECT count(*) AS tests, count(*) FILTER (q.p <= 0.05) AS nominal, count(*) FILTER (q <= 0.05) AS controlled, count(DISTINCT CASE WHEN q <= 0.05 THEN n_above END) AS clubs, round(min(q.p), 8) AS least_p, round(max(rho), 7) AS highest_ratio FROM q JOIN a USING (k)")
def club_report(spark, d):
    real, nulls = _club(spark, d)
    t = richclub.null_table(nulls, real).join(real.select("k", "n_above"), "k")
    return rounded(inference.report(_cut(t)).withColumn("highest_ratio", F.round("highest_ratio", 7)))


@query("WITH m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS x, count(*)::DOUBLE AS y FROM orders GROUP BY 1), f AS (SELECT x, y, sum(CASE WHEN abs(y - l) <= 1e-12 THEN 0 ELSE 1 END) OVER (ORDER BY x) AS g FROM (SELECT x, y, lag(y) OVER (ORDER BY x) AS l FROM m)), s AS (SELECT g, min(y) AS y, list(x ORDER BY x)[(count(*) - 1) // 2 + 1] AS x FROM f GROUP BY 1), n AS (SELECT x, y, lag(y) OVER (ORDER BY g) AS a, lead(y) OVER (ORDER BY g) AS b FROM s) SELECT x, y FROM n WHERE y < a AND y < b")
def monthly_minima(spark, d):
    """Local minima of the orders by month, a flat valley as one."""
    o = trade.read(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("x")).agg(F.count("*").cast("double").alias("y"))
    return richclub.minima(_cut(o), "x", "y")


@query("SELECT ((l_discount >= 0.02)::INT + (l_discount >= 0.04)::INT + (l_discount >= 0.06)::INT + (l_discount >= 0.08)::INT)::BIGINT AS bucket, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def discount_buckets(spark, d):
    b = layers.coverage_bucket(F.col("l_discount"), (0.02, 0.04, 0.06, 0.08))
    return rounded(trade.read(spark, d, "lineitem").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("quantity")), 6)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), j AS (SELECT p.vec_id AS print_id, r.vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(p.x[i] - r.x[i], 2)))) AS distance FROM v p JOIN v r ON p.vec_id % 50 = 0 AND r.vec_id % 50 <> 0) SELECT print_id, arg_min(vec_id, {'d': distance, 'v': vec_id}) AS vec_id, round(min(distance), 6) AS distance FROM j GROUP BY 1")
def fingerprints(spark, d):
    """For every fiftieth vector the nearest of the others."""
    v = trade.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(layers.fingerprint_match(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("print_id"), "vec"), v.where("vec_id % 50 <> 0")), 6)


def _rounds_sql(rounds: int) -> str:
    layer = lambda a, b: f"(SELECT CASE WHEN src % 3 = {a} THEN src ELSE dst END AS f, CASE WHEN src % 3 = {a} THEN dst ELSE src END AS t FROM e WHERE src % 3 + dst % 3 = {a + b} AND src % 3 <> dst % 3)"
    out = f", l12 AS (SELECT * FROM {layer(0, 1)}), l13 AS (SELECT * FROM {layer(0, 2)}), l23 AS (SELECT * FROM {layer(1, 2)}), b AS (SELECT id, degree::DOUBLE AS v FROM deg WHERE id % 3 = 0), x0 AS (SELECT * FROM b), z0 AS (SELECT * FROM b WHERE false)"
    for i in range(1, rounds + 1):
        out += (
            f", y{i} AS MATERIALIZED (SELECT id, sum(v) AS v FROM (SELECT t AS id, avg(v) AS v FROM l12 JOIN x{i - 1} ON id = f GROUP BY 1 UNION ALL SELECT f, avg(v) FROM l23 JOIN z{i - 1} ON id = t GROUP BY 1) GROUP BY 1)"
            f", x{i} AS MATERIALIZED (SELECT id, sum(v) AS v FROM (SELECT * FROM b UNION ALL SELECT f, avg(v) FROM l13 JOIN z{i - 1} ON id = t GROUP BY 1) GROUP BY 1)"
            f", z{i} AS MATERIALIZED (SELECT id, sum(v) AS v FROM (SELECT t AS id, avg(v) AS v FROM l23 JOIN y{i} ON id = f GROUP BY 1 UNION ALL SELECT t, avg(v) FROM l13 JOIN x{i} ON id = f GROUP BY 1) GROUP BY 1)"
        )
    return out


@query(FULL + _rounds_sql(3) + " SELECT 3::BIGINT AS round, id, round(v, 6) AS value FROM (SELECT * FROM x3 UNION ALL SELECT * FROM y3 UNION ALL SELECT * FROM z3) UNION ALL SELECT 2, id, round(v, 6) FROM z2")
def recurrent_messages(spark, d):
    e = _cut(trade.edges(spark, d))
    a, b = F.col("src") % 3, F.col("dst") % 3
    turn = a > b
    layered = e.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.concat((F.least(a, b) + 1).cast("string"), (F.greatest(a, b) + 1).cast("string")).alias("layer"))
    base = degrees(e).where("id % 3 = 0").select("id", F.col("degree").alias("value"))
    return rounded(layers.recurrent(layered, base, 3, (2,)), 6)


def _nested(spark, d):
    """Labels of the label graph by a rule: region or a fifth of the brands, nation or brand, colour."""
    return label_graph(spark, d).select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.expr("id div 15").alias("outer"), F.expr("id div 3").alias("middle"), (F.col("id") % 3).alias("inner"))


@query(GRAPH + " SELECT src, dst, weight, (CASE WHEN src // 15 <> dst // 15 THEN 4 WHEN src // 3 <> dst // 3 THEN 3 WHEN src % 3 <> dst % 3 THEN 2 ELSE 1 END)::BIGINT AS tier FROM g")
def display_tiers(spark, d):
    return display.tiers(label_graph(spark, d), _nested(spark, d))


@query(GRAPH + " SELECT id, row_number() OVER (ORDER BY id // 15, id // 3, id % 3, degree DESC, id) - 1 AS place FROM gd")
def display_order(spark, d):
    return display.order(_bare(spark, d), _nested(spark, d))


@query(FULL + LABELS + " SELECT count(*) AS runs, round(avg((h > 0)::INT), 8) AS rate, min(h) AS least, quantile_cont(h, 0.5) AS median, max(h) AS most, CASE WHEN avg((h > 0)::INT) = 1 THEN 'stable pass' WHEN avg((h > 0)::INT) = 0 THEN 'stable fail' ELSE 'seed dependent' END AS reading FROM (SELECT run, count(*) FILTER (z >= 2.5 AND p > 0.3 AND p <= 0.75) AS h FROM (SELECT run, p, CASE WHEN stddev_pop(own) OVER w > 0 THEN (own - avg(own) OVER w) / stddev_pop(own) OVER w ELSE 0 END AS z FROM (SELECT run, nk.id, l.label * run % 7 AS label, 1 - sum(k * k) / (sum(k) * sum(k)) AS p, sum(CASE WHEN there = l.label * run % 7 THEN k ELSE 0 END) AS own FROM (SELECT run, s.id, o.label * run % 7 AS there, count(*) AS k FROM s JOIN lab o ON o.id = s.other, range(1, 6) r(run) GROUP BY 1, 2, 3) nk JOIN lab l USING (id) GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY run, label)) GROUP BY run)")
def hub_stability(spark, d):
    """Connector hubs over five labellings made by a rule."""
    lab = trade.nation_labels(spark, d)
    runs = lab.select(F.explode(F.expr("sequence(1L, 5L)")).alias("run"), "id", "label").select("run", "id", (F.col("label") * F.col("run") % 7).alias("label"))
    return rounded(compare.hub_stability(trade.edges(spark, d), runs))


@query()
def hub_stability_seeds(spark, d):
    """The same over ten seeds of Louvain on the label graph."""
    e = _bare(spark, d)
    runs = ensemble.louvain(e, [1.0], 10).select("run", F.col("vertex").alias("id"), "label")
    from tallygraph.model import relabel

    return rounded(compare.hub_stability(relabel(e), _cut(runs)))


@query()
def resolution_hierarchy(spark, d):
    return rounded(compare.hierarchy(_bare(spark, d)))


@query()
def potts_labels(spark, d):
    """Labels by the constant Potts model, by resolution."""
    return ensemble.louvain(_bare(spark, d), [0.1, 0.3, 0.6], 3, potts=True).groupBy("gamma", "run").agg(F.count_distinct("label").alias("labels"))


@query()
def sampled_hubs(spark, d):
    """Vertices of more than twice the mean betweenness, from 200 seeded sources."""
    b = ensemble.betweenness(trade.edges(spark, d), 200)
    return rounded(hubs_above(_cut(b), "vertex", "betweenness").where("above_twice_mean = 1"))


@query()
def sampled_distances(spark, d):
    """Pairs by distance from 192 seeded sources; the largest bounds the diameter."""
    return ensemble.distance_histogram(trade.edges(spark, d), 192)


@query()
def weighted_null_club(spark, d):
    """The weighted rich club of the label graph against 100 connected rewirings with the
    weights dealt anew."""
    w = label_graph(spark, d)
    real = structure.weighted_rich_club(w)
    return rounded(richclub.null_table(ensemble.weighted_nulls(w, 100), _cut(real)))


@query()
def connected_nulls(spark, d):
    """Edges of 20 connected rewirings of the label graph."""
    return ensemble.connected_nulls(_bare(spark, d), 20).groupBy("null_id").agg(F.count("*").alias("m"))


@query()
def audit_report(spark, d):
    """Ten verdicts on the label graph: 100 rewirings, 1,000 for the rich club, 20 runs a resolution."""
    return audit.audit(_bare(spark, d))


@query()
def six_test_score(spark, d):
    """The label graph against one random graph of its degrees."""
    e = _bare(spark, d)
    null = _cut(ensemble.connected_nulls(e, 1).select("src", "dst"))
    return rounded(audit.six_tests(null, e), 6)


@query()
def eigenvalues(spark, d):
    return rounded(spectra.eigenvalues(_bare(spark, d)), 6)


@query(
    GRAPH + _TRI + ", w2 AS (SELECT x.id AS a, y.other AS b, count(*) AS n FROM gs x JOIN gs y ON y.id = x.other GROUP BY 1, 2)"
    " SELECT round((SELECT 2.0 * count(*) FROM g), 4) AS second, round((SELECT 6.0 * count(*) FROM tri), 4) AS third, round((SELECT sum(n * n) FROM w2)::DOUBLE, 4) AS fourth"
)
def spectral_moments(spark, d):
    """Sums of powers of the eigenvalues, which count the closed walks of so many steps."""
    x = spectra.eigenvalues(_bare(spark, d))
    return x.agg(*[F.round(F.sum(F.pow("value", F.lit(float(k)))), 4).alias(n) for k, n in ((2, "second"), (3, "third"), (4, "fourth"))])


_EGO = (
    ", ne AS (SELECT x.id AS v, x.other AS a, y.other AS b FROM gs x JOIN gs y ON y.id = x.other JOIN gs z ON z.id = x.id AND z.other = y.other), o0 AS (SELECT id AS v, other AS a, other AS b FROM gs)"
    ", o1 AS MATERIALIZED (SELECT * FROM ne)" + "".join(f", o{i} AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT o.v, o.a, ne.b FROM o{i - 1} o JOIN ne ON ne.v = o.v AND ne.a = o.b) ANTI JOIN o{i - 1} USING (v, a, b) ANTI JOIN o{i - 2} USING (v, a, b))" for i in range(2, 8))
    + ", ef AS (SELECT v, sum(1 / d) AS e FROM (" + " UNION ALL ".join(f"SELECT v, {i}.0 AS d FROM o{i}" for i in range(1, 8)) + ") GROUP BY 1)"
)


@query(GRAPH + _EGO + _PLACE + " SELECT vertex, CASE WHEN degree > 1 THEN round(coalesce(e, 0) / (degree * (degree - 1)), 8) ELSE 0 END AS efficiency FROM pl JOIN gd USING (id) LEFT JOIN ef ON v = id")
def label_local_efficiency(spark, d):
    return rounded(structure.local_efficiency(_bare(spark, d)))


@query()
def scree(spark, d):
    return rounded(spectra.scree(_bare(spark, d)), 6)


@query()
def network_value(spark, d):
    return rounded(spectra.network_value(_bare(spark, d)), 6)


@query()
def spectral_embedding(spark, d):
    return rounded(spectra.embedding(_bare(spark, d)), 6)


@query()
def control_summary(spark, d):
    return spectra.control_summary(_bare(spark, d))


@query()
def effective_dimension(spark, d):
    """Components of the numbers of line items."""
    return rounded(spectra.effective_dimension(trade.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 6)


@query()
def random_cover(spark, d):
    """Boxes of the best of 50 random covers, distances below 2, 3 and 4."""
    return cover.random_covers(_bare(spark, d), [1, 2, 3], 50).groupBy((F.col("reach") + 1).alias("length")).agg(F.count_distinct("box").alias("boxes"))


@query()
def box_dimension(spark, d):
    return rounded(cover.box_dimension(_bare(spark, d)))


@query()
def ball_dimension(spark, d):
    return rounded(cover.ball_dimension(_bare(spark, d)))


@query()
def mass_cover(spark, d):
    return cover.mass_covers(_bare(spark, d), [1, 2])


@query()
def nested_display(spark, d):
    """Three levels of communities of the label graph, and the edges to show."""
    w = label_graph(spark, d)
    lab = _cut(display.nested_labels(w))
    return display.shown(w, lab, 400)


@query()
def swapped_display(spark, d):
    w = label_graph(spark, d)
    return display.swapped(w, w, _cut(_nested(spark, d)), 20)[0]


def _parent(spark, d):
    lab = trade.nation_labels(spark, d).select("id", (F.col("label") * 3 + F.col("id") % 3).alias("label"), (F.col("id") % 3).alias("colour"))
    return _cut(trade.edges(spark, d)), _cut(lab)


@query()
def swap_and_lift(spark, d):
    """Parent edges by colours after 20 label pairs changed places."""
    e, v = _parent(spark, d)
    w = label_graph(spark, d)
    new, _ = display.swap_and_lift(e, v, w.select("src", "dst"), w, _cut(_nested(spark, d)), 20)
    return new.groupBy((F.col("src") % 3).alias("a"), (F.col("dst") % 3).alias("b")).agg(F.count("*").alias("n"))


@query()
def matched_bundles(spark, d):
    """Parent edges by colours after the bundles took weights of order sizes."""
    e, v = _parent(spark, d)
    w = label_graph(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    n = w.count()
    sample = trade.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("value")).orderBy(F.xxhash64("l_orderkey"), "l_orderkey").limit(n).select("value")
    new = display.match_bundles(e, v, w, sample)
    return new.groupBy((F.col("src") % 3).alias("a"), (F.col("dst") % 3).alias("b")).agg(F.count("*").alias("n"))


@query()
def seed_families(spark, d):
    """What each family of seeds gives for three and four colours."""
    grid = inference.grid(spark, 1, family=list(seeds.FAMILIES), size=[8, 12], colours=[3, 4], seed=[1, 2], balanced=[True, False], blocks=[1, 2], arm=["colours"], schedule=["even"], alpha=[0.0], steps=[1])
    return sweeps.sweep(spark, grid).select("key", "status", "colours", "n", "m", "monochrome")


@query()
def closure_arms(spark, d):
    """One seed grown under the four rules of closure."""
    grid = inference.grid(spark, 2, family=["sparse"], size=[8], colours=[3], seed=[1, 2, 3, 4], balanced=[True], blocks=[1], arm=list(sweeps.ARMS), schedule=list(sweeps.SCHEDULES), alpha=[4.0], steps=[3])
    return rounded(sweeps.sweep(spark, grid).where("status = 'ok'").select("key", "arm", "schedule", "n", "m", "clustering", "monochrome"))


@query()
def pruned_trade(spark, d):
    """Degrees after the best fifth of the label graph's pairs, with repair."""
    w = label_weights(spark, d)
    e = _cut(w.select("src", "dst"))
    colours = degrees(e).select("id", (F.col("id") % 3).alias("colour"))
    return degrees(sweeps.prune_step(e, _cut(colours), 300))


@query()
def edge_orbits(spark, d):
    from tallygraph.queries import _SEED

    return structure.edge_symmetry(spark.createDataFrame(list(_SEED), "src long, dst long"))


@query()
def image_similarity(spark, d):
    """Structural similarity of vectors next in id, read as 8 x 8 images."""
    v = trade.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("a"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select(F.col("vec_id").alias("id"), "a", "b")
    return rounded(layers.structural_similarity(pairs, 8), 6)
