"""Registered graph queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.model import both_ways, degrees
from tallygraph.operators import communities, construct, degree, ensemble, inference, matching, paths, relational, richclub, triangles
from tallygraph.sources import trade

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL twin if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that two engines' last bits don't matter; no -0.0."""
    return df.select([(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


FULL = """WITH e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
  SELECT o_custkey * 3 AS a, l_partkey * 3 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT o_custkey * 3, l_suppkey * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT l_partkey * 3 + 1, l_suppkey * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
s AS (SELECT src AS id, dst AS other FROM e UNION ALL SELECT dst, src FROM e),
deg AS (SELECT id, count(*) AS degree FROM s GROUP BY id),
ends AS (SELECT src, dst, x.degree AS du, y.degree AS dv FROM e JOIN deg x ON x.id = src JOIN deg y ON y.id = dst)"""
RECURSIVE = FULL.replace("WITH", "WITH RECURSIVE", 1)
LABELS = """, lab AS (SELECT c_custkey * 3 AS id, c_nationkey::BIGINT AS label FROM customer
  UNION ALL SELECT s_suppkey * 3 + 2, s_nationkey::BIGINT FROM supplier UNION ALL SELECT p_partkey * 3 + 1, (p_partkey % 25)::BIGINT FROM part)
, el AS (SELECT src, dst, x.label AS la, y.label AS lb FROM e JOIN lab x ON x.id = src JOIN lab y ON y.id = dst)"""
TRI = """, tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)
, tv AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY id)
, cl AS (SELECT id, degree, coalesce(t, 0) AS t, CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS c FROM deg LEFT JOIN tv USING (id))"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core audit in one row: density, degree summary, clustering, assortativity."""
    e = paths._cut(trade.edges(spark, sf_dir))
    return rounded(degree.density(e).crossJoin(degree.summary(e).drop("n")).crossJoin(triangles.clustering(e)).crossJoin(degree.assortativity(e)))


_SUMMARY = """SELECT count(*) AS n, min(x) + 0.0 AS min, max(x) + 0.0 AS max, round(avg(x), 8) AS mean, round(quantile_cont(x, 0.5), 8) AS median, round(stddev_pop(x), 8) AS std,
 round(stddev_pop(x) / avg(x), 8) AS cv, round(var_pop(x) / avg(x), 8) AS dispersion, round(quantile_cont(x, 0.9), 8) AS p90, round(quantile_cont(x, 0.99), 8) AS p99,
 round(max(x) / avg(x), 8) AS max_mean, (SELECT round(2 * sum(x * i) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 8) FROM (SELECT degree::DOUBLE AS x, row_number() OVER (ORDER BY degree) AS i FROM deg)) AS gini
FROM (SELECT degree::DOUBLE AS x FROM deg)"""


@query(FULL + " SELECT src, dst FROM e")
def graph_edges(spark, d):
    return trade.edges(spark, d)


@query(FULL + " SELECT id, degree FROM deg")
def vertex_degrees(spark, d):
    return degrees(trade.edges(spark, d))


@query(FULL + " " + _SUMMARY)
def degree_summary(spark, d):
    return rounded(degree.summary(trade.edges(spark, d)))


@query(FULL + " SELECT degree AS value, count(*) AS n FROM deg GROUP BY 1")
def degree_histogram(spark, d):
    return degree.histogram(degrees(trade.edges(spark, d)), "degree")


@query(FULL + ", k AS (SELECT least(greatest(10, count(*) // 10), 200, count(*) - 1) AS k FROM deg), t AS (SELECT degree AS x, row_number() OVER (ORDER BY degree DESC) AS i FROM deg) SELECT round(1 / avg(ln(t.x / (SELECT x FROM t, k WHERE i = k + 1))), 8) AS hill FROM t, k WHERE i <= k")
def hill_index(spark, d):
    return rounded(degree.hill(trade.edges(spark, d)))


def _entropy(keys: str, table: str) -> str:
    return f" SELECT round(-sum(n / t * ln(n / t)), 8) AS entropy FROM (SELECT n::DOUBLE AS n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys}))"


@query(FULL + _entropy("abs(du - dv)", "ends"))
def degree_difference_entropy(spark, d):
    return rounded(degree.difference_entropy(trade.edges(spark, d)))


@query(FULL + _entropy("least(du, dv), greatest(du, dv)", "ends"))
def degree_pair_entropy(spark, d):
    return rounded(degree.pair_entropy(trade.edges(spark, d)))


@query(FULL + _entropy("degree", "deg"))
def degree_entropy(spark, d):
    return rounded(degree.degree_entropy(trade.edges(spark, d)))


@query(FULL + " SELECT round(corr(a, b), 8) AS assortativity FROM (SELECT du::DOUBLE AS a, dv::DOUBLE AS b FROM ends UNION ALL SELECT dv, du FROM ends)")
def assortativity(spark, d):
    return rounded(degree.assortativity(trade.edges(spark, d)))


@query(FULL + " SELECT n, m, round(2.0 * m / (n * (n - 1)), 8) AS density, round(2.0 * m / n, 8) AS mean_degree FROM (SELECT count(*) AS n FROM deg), (SELECT count(*) AS m FROM e)")
def graph_density(spark, d):
    return rounded(degree.density(trade.edges(spark, d)))


@query(FULL + ", v AS (SELECT DISTINCT degree AS x FROM deg) SELECT round(max(abs(a - b)), 8) AS ks FROM (SELECT (SELECT count(*) FROM deg WHERE id % 3 = 0 AND degree <= x) / (SELECT count(*) FROM deg WHERE id % 3 = 0) AS a, (SELECT count(*) FROM deg WHERE id % 3 = 1 AND degree <= x) / (SELECT count(*) FROM deg WHERE id % 3 = 1) AS b FROM v)")
def degree_ks(spark, d):
    g = degrees(trade.edges(spark, d))
    return rounded(degree.ks(g.where("id % 3 = 0"), g.where("id % 3 = 1"), "degree"))


@query(FULL + ", nd AS (SELECT s.id, avg(o.degree) AS m FROM s JOIN deg o ON o.id = s.other GROUP BY s.id), r AS (SELECT rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2 AS a, rank() OVER (ORDER BY round(m, 6)) + (count(*) OVER (PARTITION BY round(m, 6)) - 1) / 2 AS b FROM deg JOIN nd USING (id)) SELECT round(corr(a, b), 8) AS spearman FROM r")
def degree_spearman(spark, d):
    e = trade.edges(spark, d)
    return rounded(degree.spearman(degrees(e).join(degree.neighbour_degree(e).select("id", F.round("mean_degree", 6).alias("m")), "id"), "degree", "m"))


@query(FULL + LABELS + ", sz AS (SELECT label, count(*) AS n FROM lab GROUP BY 1), g AS (SELECT a.label AS a, b.label AS b, CASE WHEN a.label = b.label THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END AS p FROM sz a, sz b WHERE a.label <= b.label), k AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS n FROM el GROUP BY 1, 2) SELECT g.a, g.b, coalesce(n, 0) AS edges, CASE WHEN p > 0 THEN round(coalesce(n, 0) / p, 8) END AS density FROM g LEFT JOIN k USING (a, b)")
def block_density(spark, d):
    return rounded(degree.block_density(trade.edges(spark, d), trade.nation_labels(spark, d)))


@query(FULL + TRI + " SELECT sum(t)::BIGINT // 3 AS triangles, (sum(degree * (degree - 1)) / 2)::BIGINT AS wedges, round(sum(t) / (sum(degree * (degree - 1)) / 2), 8) AS transitivity, round(avg(c), 8) AS average_clustering FROM cl")
def clustering(spark, d):
    return rounded(triangles.clustering(trade.edges(spark, d)))


@query(FULL + TRI + " SELECT id, degree, t::BIGINT AS triangles, round(c, 8) AS clustering FROM cl")
def vertex_clustering(spark, d):
    return rounded(triangles.per_vertex(trade.edges(spark, d)))


@query(FULL + TRI + ", p AS (SELECT a AS src, b AS dst FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri) SELECT src, dst, (SELECT count(*) FROM p WHERE p.src = e.src AND p.dst = e.dst) AS support FROM e")
def edge_support(spark, d):
    return triangles.support(trade.edges(spark, d))


@query(FULL + TRI + " SELECT (degree // 30)::BIGINT AS band, count(*) AS n, round(avg(c), 8) AS clustering FROM cl GROUP BY 1 HAVING count(*) >= 3")
def clustering_by_degree(spark, d):
    return rounded(triangles.by_degree_band(trade.edges(spark, d)))


_PHI = ", ks AS (SELECT unnest(range(0, (SELECT max(degree) + 1 FROM deg))) AS k), ph AS (SELECT k, (SELECT count(*) FROM deg WHERE degree > k) AS n_above, (SELECT count(*) FROM ends WHERE least(du, dv) > k) AS e_above FROM ks), pc AS (SELECT k, n_above, e_above, 2.0 * e_above / (n_above * (n_above - 1)) AS phi FROM ph WHERE n_above >= 2)"


@query(FULL + _PHI + " SELECT k, n_above, e_above, round(phi, 8) AS phi FROM pc")
def rich_club(spark, d):
    return rounded(richclub.phi(trade.edges(spark, d)))


@query(FULL + _PHI + ", t AS (SELECT k, (1 + (k * 7919) % 101) / 102 AS p FROM pc), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM t) SELECT k, round(p, 8) AS p, round(least(1, min(p * n / i) OVER (ORDER BY i DESC)), 8) AS q FROM r")
def benjamini_hochberg(spark, d):
    t = richclub.phi(trade.edges(spark, d)).select("k", ((1 + (F.col("k") * 7919) % 101) / 102).alias("p"))
    return rounded(richclub.benjamini_hochberg(t, "k", "p"))


@query(FULL + _PHI + ", m AS (SELECT k FROM pc WHERE round(phi, 6) >= 0.02), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM m) SELECT min(k) AS first, max(k) AS last, count(*) AS length FROM g GROUP BY g")
def significant_runs(spark, d):
    return richclub.runs(richclub.phi(trade.edges(spark, d)).where("round(phi, 6) >= 0.02").select("k"), "k")


@query(FULL + LABELS + ", x AS (SELECT la AS label, (la = lb)::INT AS i FROM el UNION ALL SELECT lb, 0 FROM el), g AS (SELECT sum(i) AS i, count(*)::DOUBLE AS d FROM x GROUP BY label) SELECT round(sum(i) / (sum(d) / 2) - sum(d * d) / (sum(d) * sum(d)), 8) AS modularity FROM g")
def modularity(spark, d):
    return rounded(communities.modularity(trade.edges(spark, d), trade.nation_labels(spark, d)))


_ROLES = LABELS + ", nk AS (SELECT s.id, o.label AS there, count(*) AS k FROM s JOIN lab o ON o.id = s.other GROUP BY 1, 2), pr AS (SELECT nk.id, lab.label, sum(k) AS degree, sum(k * k) AS sq, sum(CASE WHEN there = lab.label THEN k ELSE 0 END) AS own FROM nk JOIN lab USING (id) GROUP BY 1, 2), ro AS (SELECT id, label, degree, 1 - sq / (degree * degree) AS p, CASE WHEN stddev_pop(own) OVER w > 0 THEN (own - avg(own) OVER w) / stddev_pop(own) OVER w ELSE 0 END AS z FROM pr WINDOW w AS (PARTITION BY label))"


@query(FULL + _ROLES + " SELECT id, label, degree::BIGINT AS degree, round(p, 7) AS participation, round(z, 7) AS z FROM ro")
def vertex_roles(spark, d):
    return rounded(communities.roles(trade.edges(spark, d), trade.nation_labels(spark, d)), 7)


@query(FULL + _ROLES + " SELECT count(*) FILTER (z >= 2.5 AND p > 0.30 AND p <= 0.75) AS connector, count(*) FILTER (z >= 2.5 AND p > 0.75) AS kinless FROM ro")
def connector_hubs(spark, d):
    return communities.hubs(trade.edges(spark, d), trade.nation_labels(spark, d))


@query("WITH RECURSIVE r AS (SELECT 1)" + LABELS.split(", el AS")[0] + ", c AS (SELECT label AS a, id % 3 AS b, count(*)::DOUBLE AS n FROM lab GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(n * ln(n)) AS sab, sum(n * (n - 1) / 2) AS pab FROM c), x AS (SELECT sum(n * ln(n)) AS sa, sum(n * (n - 1) / 2) AS pa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * ln(n)) AS sb, sum(n * (n - 1) / 2) AS pb FROM (SELECT sum(n) AS n FROM c GROUP BY b)), h AS (SELECT *, ln(t) - sa / t AS ha, ln(t) - sb / t AS hb, ln(t) - sab / t AS hab, pa * pb / (t * (t - 1) / 2) AS ex FROM t, x, y) SELECT round(2 * hab - ha - hb, 8) AS vi, round(2 * (ha + hb - hab) / (ha + hb), 8) AS nmi, round((pab - ex) / ((pa + pb) / 2 - ex), 8) AS ari FROM h")
def partition_agreement(spark, d):
    lab = trade.nation_labels(spark, d)
    return rounded(communities.agreement(lab, trade.colours(lab)))


@query(FULL + LABELS + " SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS witness FROM el WHERE la <> lb GROUP BY 1, 2")
def quotient(spark, d):
    return communities.quotient(trade.edges(spark, d), trade.nation_labels(spark, d))


@query(FULL + LABELS + " SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS weight, count(DISTINCT CASE WHEN la < lb THEN src ELSE dst END) AS fan_a, count(DISTINCT CASE WHEN la < lb THEN dst ELSE src END) AS fan_b FROM el WHERE la <> lb GROUP BY 1, 2")
def bundle_fans(spark, d):
    return communities.bundle_fans(trade.edges(spark, d), trade.nation_labels(spark, d))


@query(FULL + LABELS + ", q AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*)::DOUBLE AS w FROM el WHERE la <> lb GROUP BY 1, 2) SELECT a, b, greatest(1, round_even(pow(w, 0.05) * pow(1 + (w - 1) / 11, 0.95), 0))::BIGINT AS axons FROM q")
def axon_law(spark, d):
    return communities.quotient(trade.edges(spark, d), trade.nation_labels(spark, d)).select("a", "b", degree.axons("witness").alias("axons"))


@query(FULL + LABELS + " SELECT count(*) FILTER (la <> lb) AS cut, count(*) AS m, round(avg((la <> lb)::INT), 8) AS share FROM el")
def cut_share(spark, d):
    return rounded(communities.cut_share(trade.edges(spark, d), trade.nation_labels(spark, d)))


@query("WITH g AS (SELECT c_nationkey::BIGINT AS nation, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT nation, n * 1015 / (SELECT sum(n) FROM g) AS q FROM g), f AS (SELECT nation, floor(q) AS f, row_number() OVER (ORDER BY q - floor(q) DESC, nation) AS r FROM q) SELECT nation, (f + (r <= 1015 - (SELECT sum(f) FROM f))::INT)::BIGINT AS seats FROM f")
def apportionment(spark, d):
    g = trade.read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("n"))
    return communities.apportion(g, "nation", "n", 1015)


@query(RECURSIVE + ", src AS (SELECT min(id) AS v FROM deg), b(id, d) AS (SELECT v, 0 FROM src UNION SELECT s.other, d + 1 FROM b JOIN s ON s.id = b.id WHERE d < 12), r AS (SELECT id FROM b GROUP BY id) SELECT count(*) AS reached, (SELECT count(*) FROM deg) AS n FROM r")
def reachable(spark, d):
    e = trade.edges(spark, d)
    c = paths.components(e)
    low = c.agg(F.min("id").alias("component"))
    return c.join(low, "component").agg(F.count("*").alias("reached")).crossJoin(c.agg(F.count("*").alias("n")))


def frontier_sql(levels: int) -> str:
    """CTEs of the pairs at each distance, a frontier a level, and of their counts: an
    end's neighbours are at its own distance, one less or one more."""
    out = ", f0 AS (SELECT id AS a, id AS b FROM deg), f1 AS MATERIALIZED (SELECT id AS a, other AS b FROM s)"
    for i in range(2, levels + 1):
        out += f", f{i} AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT f.a, s.other AS b FROM f{i - 1} f JOIN s ON s.id = f.b) ANTI JOIN f{i - 1} USING (a, b) ANTI JOIN f{i - 2} USING (a, b))"
    counts = " UNION ALL ".join(f"SELECT {i}::BIGINT AS d, count(*) AS pairs FROM f{i}" for i in range(1, levels + 1))
    return out + f", hist AS (SELECT d, pairs FROM ({counts}) WHERE pairs > 0)"


#: The trade graph has three distances; two more levels are empty.
DISTANCES = FULL.replace("WITH e AS (", "WITH e AS MATERIALIZED (").replace("s AS (SELECT src AS id", "s AS MATERIALIZED (SELECT src AS id") + frontier_sql(5)
HOPS = " SELECT d AS h, sum(pairs) OVER (ORDER BY d)::BIGINT AS pairs, round(sum(pairs) OVER (ORDER BY d) / sum(pairs) OVER (), 8) AS share FROM hist"
SUMMARY = (
    ", c AS (SELECT d, sum(pairs) OVER (ORDER BY d) / sum(pairs) OVER () AS s FROM hist), l AS (SELECT d, s, coalesce(lag(s) OVER (ORDER BY d), 0) AS low FROM c), f AS (SELECT round(d - 1 + (0.9 - low) / (s - low), 8) AS effective_diameter FROM l WHERE s >= 0.9 - 1e-12 ORDER BY d LIMIT 1)"
    " SELECT round(sum(d * pairs) / sum(pairs), 8) AS average_path, round(sum(pairs / d) / ((SELECT count(*) FROM {0}) * ((SELECT count(*) FROM {0}) - 1)), 8) AS efficiency, max(d) AS diameter, (SELECT effective_diameter FROM f) AS effective_diameter FROM hist"
)


@query(DISTANCES + " SELECT d, pairs FROM hist")
def distance_histogram(spark, d):
    """Ordered pairs by distance, from every vertex."""
    return ensemble.distance_histogram(trade.edges(spark, d))


@query(DISTANCES + HOPS)
def hop_plot(spark, d):
    return rounded(paths.hop_plot(ensemble.distance_histogram(trade.edges(spark, d))))


@query(DISTANCES + SUMMARY.format("deg"))
def path_summary(spark, d):
    """Average path length, global efficiency, diameter, effective diameter."""
    e = paths._cut(trade.edges(spark, d))
    h = paths._cut(ensemble.distance_histogram(e))
    return rounded(paths.path_summary(h, degrees(e).count()).crossJoin(paths.effective_diameter(h)))


#: A seven-cycle with two chords.
_SEED = (*((i, i + 1) for i in range(6)), (0, 6), (0, 2), (3, 5))


@query(FULL + ", k(a, b) AS (VALUES " + ", ".join(f"({a}, {b}), ({b}, {a})" for a, b in _SEED) + ") SELECT DISTINCT least(src * 7 + a, dst * 7 + b) AS src, greatest(src * 7 + a, dst * 7 + b) AS dst FROM e, k")
def kronecker_product(spark, d):
    seed = spark.createDataFrame(list(_SEED), "src long, dst long")
    return construct.kronecker(trade.edges(spark, d), seed, 7)


@query(FULL + ", w AS (SELECT x.other AS src, y.other AS dst, count(*) AS support FROM s x JOIN s y ON x.id = y.id AND x.other < y.other GROUP BY 1, 2) SELECT src, dst, support FROM w ANTI JOIN e USING (src, dst) WHERE src % 3 <> dst % 3")
def legal_wedges(spark, d):
    e = trade.edges(spark, d)
    return construct.legal_wedges(e, degrees(e).select("id", (F.col("id") % 3).alias("colour")))


@query(
    FULL.replace("WITH e AS (", "WITH e AS MATERIALIZED (").replace("s AS (SELECT src AS id", "s AS MATERIALIZED (SELECT src AS id")
    + """, w AS MATERIALIZED (SELECT x.other AS src, y.other AS dst, count(*) AS support FROM s x JOIN s y ON x.id = y.id AND x.other < y.other WHERE x.other % 3 <> y.other % 3 GROUP BY 1, 2),
l AS MATERIALIZED (SELECT src, dst FROM w ANTI JOIN e USING (src, dst) ORDER BY support DESC, src, dst LIMIT 100)
SELECT src, dst FROM e UNION ALL SELECT src, dst FROM l"""
)
def triangle_closure(spark, d):
    e = trade.edges(spark, d)
    return construct.close(e, degrees(e).select("id", (F.col("id") % 3).alias("colour")), 100)


@query(FULL + " SELECT id, id % 3 AS colour, row_number() OVER (PARTITION BY id % 3 ORDER BY id) - 1 AS place FROM deg")
def class_places(spark, d):
    return rounded(construct.class_ids(degrees(trade.edges(spark, d)).select("id", (F.col("id") % 3).alias("colour"))))


@query(FULL + " SELECT s.id, sum(o.degree)::BIGINT AS message FROM s JOIN deg o ON o.id = s.other GROUP BY 1")
def message_passing(spark, d):
    e = trade.edges(spark, d)
    return rounded(relational.propagate(both_ways(e), degrees(e).toDF("id", "value")).withColumnRenamed("value", "message"))


@query()
def null_rich_club(spark, d):
    """Real curve against 20 rewirings: mean, sd, ratio, p and q at each k."""
    e = trade.edges(spark, d)
    t = richclub.null_table(ensemble.null_rich_clubs(e, 20), richclub.phi(e))
    q = richclub.benjamini_hochberg(t.select("k", "p"), "k", "p").select("k", "q")
    return rounded(t.join(q, "k"))


@query()
def louvain_sweep(spark, d):
    """Mean variation of information over seeds, and mean labels, by resolution."""
    return rounded(inference.stability(ensemble.louvain(trade.edges(spark, d), [0.5, 1.0, 2.0], 4)))


@query()
def betweenness(spark, d):
    return rounded(ensemble.betweenness(trade.edges(spark, d)))


@query()
def betweenness_hubs(spark, d):
    return rounded(inference.hubs_above(ensemble.betweenness(trade.edges(spark, d)), "vertex", "betweenness"))


@query()
def fractional_cover(spark, d):
    """By the kernel, or for more edges than it takes by the table form."""
    e = paths._cut(trade.edges(spark, d))
    if e.count() <= ensemble.MOST_EDGES:
        return ensemble.fractional_cover(e)
    return matching.double_cover(e)[0].agg((F.count("*") / 2).alias("value"))


def _nations(spark, d):
    lab = trade.nation_labels(spark, d)
    w = communities.quotient(trade.edges(spark, d), lab)
    return w.select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query()
def spectrum(spark, d):
    return rounded(ensemble.spectrum(_nations(spark, d)))


@query()
def box_counts(spark, d):
    return ensemble.box_counts(trade.edges(spark, d), [1, 2, 3])


@query(FULL + ", w AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM (SELECT o_custkey * 3 AS a, l_partkey * 3 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey * 3, l_suppkey * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT l_partkey * 3 + 1, l_suppkey * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2) SELECT src, dst, weight FROM w")
def weighted_edges(spark, d):
    return trade.weighted(spark, d)


@query("WITH q AS (SELECT c_nationkey::BIGINT AS nation, o_totalprice AS x FROM customer JOIN orders ON o_custkey = c_custkey), g AS (SELECT nation, round(avg(x), 2) AS mean, round(stddev_pop(x), 2) AS sd, count(*) AS n FROM q GROUP BY 1) SELECT nation, mean, sd, n FROM g")
def bucket_means(spark, d):
    o = trade.read(spark, d, "orders").join(trade.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return inference.bucket_means(o.select(F.col("c_nationkey").cast("long").alias("nation"), F.col("o_totalprice").alias("x")), "nation", "x")


for _f, _sql in relational.EXTRAS:
    query(_sql)(_f)
