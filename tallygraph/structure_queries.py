"""More registered queries: structure, growth, layers, audits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygraph.functions import scalars
from tallygraph.model import degrees
from tallygraph.operators import communities, degree, ensemble, growth, layers, repair, richclub, structure, triangles
from tallygraph.operators.paths import _cut, scratch
from tallygraph.plans import audit, inference
from tallygraph.queries import _SEED, FULL, LABELS, ORACLE_SQL, QUERIES, TRI, _nations, query, rounded
from tallygraph.sources import trade
from tallygraph.streaming import tables

__all__ = ["ORACLE_SQL", "QUERIES"]

_PAIRS = "SELECT o_custkey * 3 AS a, l_partkey * 3 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey * 3, l_suppkey * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT l_partkey * 3 + 1, l_suppkey * 3 + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_WEIGHTED = f", w AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM ({_PAIRS}) GROUP BY 1, 2)"
_QUOTIENT = LABELS + ", q AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS weight FROM el WHERE la <> lb GROUP BY 1, 2)"


def _quotient(spark, d):
    return communities.quotient(trade.edges(spark, d), trade.nation_labels(spark, d))


def _coloured(spark, d):
    e = trade.edges(spark, d)
    return e, degrees(e).select("id", (F.col("id") % 3).alias("colour"))


@query(FULL + _WEIGHTED + ", wd AS (SELECT least(x.degree, y.degree) AS m, weight FROM w JOIN deg x ON x.id = src JOIN deg y ON y.id = dst), h AS (SELECT m, count(*) AS c, sum(weight) AS s FROM wd GROUP BY m), ks AS (SELECT unnest(range(0, (SELECT max(degree) + 1 FROM deg))) AS k), g AS (SELECT k, coalesce(sum(c), 0) AS e, coalesce(sum(h.s), 0) AS ws FROM ks LEFT JOIN h ON m > k GROUP BY k), r AS (SELECT row_number() OVER (ORDER BY weight DESC) AS i, sum(weight) OVER (ORDER BY weight DESC ROWS UNBOUNDED PRECEDING) AS top FROM w) SELECT k, CASE WHEN e > 0 THEN round(ws / top, 8) ELSE 0 END AS phi FROM g LEFT JOIN r ON i = e WHERE (SELECT count(*) FROM deg WHERE degree > k) >= 2")
def weighted_rich_club(spark, d):
    return rounded(structure.weighted_rich_club(trade.weighted(spark, d)))


@query("WITH RECURSIVE z AS (SELECT 1)" + LABELS.split(", el AS")[0] + " SELECT round(sum(top) / sum(n), 8) AS nesting, count(*) AS labels FROM (SELECT label, max(n) AS top, sum(n) AS n FROM (SELECT label, id % 3 AS c, count(*) AS n FROM lab GROUP BY 1, 2) GROUP BY 1)")
def partition_nesting(spark, d):
    lab = trade.nation_labels(spark, d)
    return rounded(structure.nesting(lab, trade.colours(lab)))


@query(FULL + ", g AS (SELECT n, 2.0 * m / (n * (n - 1)) AS c, 2.0 * m / n AS k FROM (SELECT count(*) AS n FROM deg), (SELECT count(*) AS m FROM e)) SELECT round(c, 8) AS clustering, round((ln(n) - 0.5772) / ln(k) + 0.5, 8) AS path, round(1 / ((ln(n) - 0.5772) / ln(k) + 0.5), 8) AS efficiency FROM g")
def random_expectations(spark, d):
    return rounded(audit.expectations(trade.edges(spark, d)))


@query(FULL + _QUOTIENT + ", x AS (SELECT weight::DOUBLE AS x FROM q) SELECT round(avg(x), 8) AS mean, quantile_cont(x, 0.5) AS median, max(x) AS max, round(avg((x <= 5)::INT), 8) AS at_most_5, round(avg((x = 1)::INT), 8) AS ones, round(quantile_cont(x, 0.9) / quantile_cont(x, 0.5), 8) AS p90_median, (SELECT round(2 * sum(x * i) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 8) FROM (SELECT x, row_number() OVER (ORDER BY x) AS i FROM x)) AS gini FROM x")
def weight_table(spark, d):
    return rounded(audit.weight_table(_quotient(spark, d), "witness"))


@query(FULL + _WEIGHTED + ", c AS (SELECT (SELECT min(degree) FROM (SELECT degree, cume_dist() OVER (ORDER BY degree) AS p FROM deg) WHERE p >= 0.9) AS dc, (SELECT min(weight) FROM (SELECT weight, cume_dist() OVER (ORDER BY weight) AS p FROM w) WHERE p >= 0.99) AS wc) SELECT count(*) AS heavy, count(*) FILTER (x.degree >= dc AND y.degree >= dc) AS hub_hub FROM w JOIN deg x ON x.id = src JOIN deg y ON y.id = dst, c WHERE weight >= wc")
def heavy_hub_share(spark, d):
    return audit.heavy_hub_share(trade.weighted(spark, d))


@query(FULL + _WEIGHTED + ", h AS (SELECT weight, sum(n) OVER (ORDER BY weight DESC) - n AS above, sum(n) OVER () AS t FROM (SELECT weight, count(*) AS n FROM w GROUP BY 1)), p AS (SELECT weight AS c FROM h ORDER BY round(abs(above / t - 0.05), 12), weight LIMIT 1) SELECT src, dst, weight FROM w, p WHERE weight > c")
def heaviest_share(spark, d):
    return audit.keep_share(trade.weighted(spark, d), 0.05)


@query(FULL + ", g AS (SELECT floor(log2(degree) + 1e-9)::BIGINT AS bin, count(*) AS n FROM deg GROUP BY 1) SELECT bin, pow(2, bin)::BIGINT AS low, n, round(n / pow(2, bin), 8) AS per_unit FROM g")
def log_degrees(spark, d):
    return rounded(scalars.log_histogram(degrees(trade.edges(spark, d)), "degree"))


@query(FULL + _QUOTIENT + " SELECT CASE WHEN weight >= 301 THEN 301 WHEN weight >= 101 THEN 101 WHEN weight >= 31 THEN 31 WHEN weight >= 11 THEN 11 WHEN weight >= 6 THEN 6 WHEN weight >= 3 THEN 3 WHEN weight >= 2 THEN 2 ELSE 1 END::BIGINT AS band, count(*) AS n, round(avg(weight), 8) AS mean FROM q GROUP BY 1")
def weight_bands(spark, d):
    return rounded(_quotient(spark, d).groupBy(scalars.band(F.col("witness")).alias("band")).agg(F.count("*").alias("n"), F.avg("witness").alias("mean")))


@query(FULL + LABELS + ", f AS (SELECT id, label, degree / 10 + 1 AS f0, CASE WHEN id % 7 / 7 - 0.5 > 0 THEN id % 7 / 7 - 0.5 + 1 ELSE exp(id % 7 / 7 - 0.5) END AS f1, degree AS v0, id % 3 AS v1 FROM deg JOIN lab USING (id)), kv AS (SELECT label, sum(f0 * v0) AS a, sum(f0 * v1) AS b, sum(f1 * v0) AS c, sum(f1 * v1) AS d, sum(f0) AS n0, sum(f1) AS n1 FROM f GROUP BY 1) SELECT id, 0::BIGINT AS \"at\", round((f0 * a + f1 * c) / greatest(f0 * n0 + f1 * n1, 1e-6), 6) AS value FROM f JOIN kv USING (label) UNION ALL SELECT id, 1, round((f0 * b + f1 * d) / greatest(f0 * n0 + f1 * n1, 1e-6), 6) FROM f JOIN kv USING (label)")
def supernode_attention(spark, d):
    rows = degrees(trade.edges(spark, d)).join(trade.nation_labels(spark, d), "id")
    x = F.array(F.col("degree") / 10, F.col("id") % 7 / 7 - 0.5)
    return rounded(layers.attention(rows.select("id", "label", x.alias("q"), x.alias("k"), F.array(F.col("degree").cast("double"), (F.col("id") % 3).cast("double")).alias("v"))), 6)


@query(FULL + LABELS + ", rel AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, CASE WHEN la < lb THEN src ELSE dst END AS f, CASE WHEN la < lb THEN dst ELSE src END AS t FROM el WHERE la <> lb), ax AS (SELECT a, b, greatest(1, round_even(pow(n, 0.05) * pow(1 + (n - 1) / 11, 0.95), 0))::BIGINT AS axons FROM (SELECT a, b, count(*)::DOUBLE AS n FROM rel GROUP BY 1, 2)), dealt AS (SELECT a, b, f, t, (row_number() OVER (PARTITION BY a, b ORDER BY f, t) - 1) % axons AS x FROM rel JOIN ax USING (a, b)), car AS (SELECT a, b, x, avg(degree) AS m FROM (SELECT DISTINCT a, b, x, f FROM dealt) JOIN deg ON deg.id = f GROUP BY 1, 2, 3) SELECT t AS id, round(sum(m), 6) AS value FROM (SELECT DISTINCT a, b, x, t FROM dealt) JOIN car USING (a, b, x) GROUP BY 1")
def bundle_layer(spark, d):
    e, lab = trade.edges(spark, d), trade.nation_labels(spark, d)
    el = e.join(lab.toDF("src", "la"), "src").join(lab.toDF("dst", "lb"), "dst").where("la <> lb")
    up = F.col("la") < F.col("lb")
    el = el.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    axons = el.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", degree.axons("n").alias("axons"))
    return rounded(layers.bundle_layer(el.join(axons, ["a", "b"]), degrees(e)), 6)


@query(FULL + LABELS + TRI + ", p AS (SELECT a AS src, b AS dst FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri), sc AS (SELECT src, dst, la <> lb AS crossing, (SELECT count(*) FROM p WHERE p.src = el.src AND p.dst = el.dst) AS score FROM el), c AS (SELECT count(*) FILTER (crossing) AS x, count(*) FILTER (NOT crossing) AS i, 40 AS b FROM sc), n AS (SELECT least(i, b - least(x, 10)) AS inner_n, least(x, b - least(i, b - least(x, 10))) AS outer_n FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY crossing ORDER BY score DESC, src, dst) AS k FROM sc) SELECT src, dst, score, crossing FROM r, n WHERE k <= CASE WHEN crossing THEN outer_n ELSE inner_n END")
def stratified_prune(spark, d):
    e, lab = trade.edges(spark, d), trade.nation_labels(spark, d)
    s = triangles.support(e).join(lab.toDF("src", "la"), "src").join(lab.toDF("dst", "lb"), "dst")
    return growth.stratified_prune(_cut(s.select("src", "dst", F.col("support").alias("score"), (F.col("la") != F.col("lb")).alias("crossing"))), 40, 0.25)


@query(FULL + ", x AS (SELECT id, degree, row_number() OVER (ORDER BY degree, id) AS r FROM deg WHERE id % 3 = 0), y AS (SELECT degree AS target, row_number() OVER (ORDER BY degree, id) AS r FROM deg WHERE id % 3 = 1) SELECT id, degree, target FROM x JOIN y USING (r)")
def rank_match(spark, d):
    g = _cut(degrees(trade.edges(spark, d)))
    return growth.rank_match(g.where("id % 3 = 0"), g.where("id % 3 = 1"), "id", "degree")


@query(FULL + _QUOTIENT + ", two AS (SELECT a, b, weight FROM q UNION ALL SELECT b, a, weight FROM q), best AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM two) WHERE r = 1) SELECT x.a, x.b FROM best x JOIN best y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def best_partners(spark, d):
    return growth.best_partners(_quotient(spark, d).withColumnRenamed("witness", "density"))


@query(ORACLE_SQL["event_windows"])
def stream_event_windows(spark, d):
    """The hourly counts by Structured Streaming."""
    return tables.event_windows(tables.source(spark, d, "events"), scratch(spark))


@query(FULL + _WEIGHTED + " SELECT src, dst, weight FROM w")
def stream_edge_weights(spark, d):
    """Edge weights from a stream of line items, joined with the orders as a table."""
    lines = tables.source(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = trade.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return tables.edge_weights(trade.three_pairs(lines, orders), scratch(spark))


#: An edge of a triangle is no bridge; the others are, if their ends part without them.
BRIDGES = (
    ", p AS (SELECT a AS src, b AS dst FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri), lone AS (SELECT src, dst FROM {0} ANTI JOIN p USING (src, dst))"
    ", r(src, dst, v) AS (SELECT src, dst, src FROM lone UNION SELECT r.src, r.dst, n.other FROM r JOIN {1} n ON n.id = r.v WHERE NOT (n.id = r.src AND n.other = r.dst) AND NOT (n.id = r.dst AND n.other = r.src))"
    ", br AS (SELECT src, dst FROM lone ANTI JOIN (SELECT src, dst FROM r WHERE v = dst) USING (src, dst)), pl AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS vertex FROM {2}) SELECT x.vertex AS src, y.vertex AS dst FROM br JOIN pl x ON x.id = br.src JOIN pl y ON y.id = br.dst"
)


@query(FULL.replace("WITH", "WITH RECURSIVE", 1) + TRI + BRIDGES.format("e", "s", "deg"))
def bridges(spark, d):
    return structure.bridges(trade.edges(spark, d))


@query()
def odd_cycle(spark, d):
    return structure.odd_cycle(trade.edges(spark, d))


@query()
def largest_matching(spark, d):
    return structure.matching(_nations(spark, d))


@query()
def vertex_cover(spark, d):
    """Ends of a maximal matching: at most twice the least cover."""
    return structure.maximal_matching(trade.edges(spark, d)).select(F.explode(F.array("src", "dst")).alias("id"))


@query()
def greedy_colours(spark, d):
    return structure.colouring(trade.edges(spark, d))


def _seed(spark):
    return spark.createDataFrame(list(_SEED), "src long, dst long")


@query()
def seed_colours(spark, d):
    return structure.chromatic_number(_seed(spark))


@query()
def seed_orbits(spark, d):
    return rounded(structure.symmetry(_seed(spark)))


_REFINED = ", k0 AS (SELECT id, degree::HUGEINT AS c FROM deg)" + "".join(f", k{i} AS MATERIALIZED (SELECT id, (hash(c, s)::HUGEINT) AS c FROM (SELECT x.id, x.c, sum(hash(y.c)::HUGEINT) AS s FROM k{i - 1} x JOIN s ON s.id = x.id JOIN k{i - 1} y ON y.id = s.other GROUP BY 1, 2))" for i in range(1, 7))


@query(FULL + _REFINED + " SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 8) AS entropy, count(*) AS groups FROM (SELECT count(*)::DOUBLE AS n FROM k6 GROUP BY c)")
def refined_classes(spark, d):
    """Entropy and number of the stable colour classes."""
    return rounded(structure.group_entropy(structure.refined(trade.edges(spark, d)), "colour"))


@query()
def local_efficiency(spark, d):
    return rounded(structure.local_efficiency(trade.edges(spark, d)))


@query()
def edge_betweenness(spark, d):
    return rounded(structure.edge_betweenness(_nations(spark, d)), 10)


@query()
def skeleton(spark, d):
    return rounded(structure.skeleton(_nations(spark, d)), 10)


@query()
def random_box_fit(spark, d):
    return rounded(structure.scaling_fit(structure.random_box_counts(trade.edges(spark, d), [2, 3, 4], 3), "length", "boxes"))


@query()
def controllability(spark, d):
    return rounded(structure.controllability(_nations(spark, d)))


@query()
def fiedler_cut(spark, d):
    return rounded(structure.fiedler_cut(_nations(spark, d)))


@query()
def layered_nulls(spark, d):
    """Edges of three rewirings that keep degrees towards every colour, by colours."""
    e, c = _coloured(spark, d)
    n = structure.layered_nulls(e, c, 3)
    return n.groupBy("null_id", F.least(F.col("src") % 3, F.col("dst") % 3).alias("a"), F.greatest(F.col("src") % 3, F.col("dst") % 3).alias("b")).agg(F.count("*").alias("n"))


@query()
def baseline_manifest(spark, d):
    return rounded(structure.manifest(structure.baselines(trade.edges(spark, d))))


@query()
def closure_record(spark, d):
    """Draws of a random closure: legal, stopped by colour, taken, by round."""
    e, c = _coloured(spark, d)
    return growth.random_closure(e, c, 200)[1]


@query()
def growth_loop(spark, d):
    """Degrees of a graph grown from the seed in three steps."""
    seed = _seed(spark)
    colours = spark.createDataFrame([(i, i % 3) for i in range(7)], "id long, colour long")
    return degrees(growth.grow(seed, colours, 7, [1, 4, 30])[0])


@query()
def merged_labels(spark, d):
    return structure.merged_labels(trade.edges(spark, d), trade.nation_labels(spark, d), 10)


@query()
def densest_merge(spark, d):
    return structure.merged_labels(trade.edges(spark, d), trade.nation_labels(spark, d), 10, "dense")


@query()
def best_partition(spark, d):
    e = _cut(trade.edges(spark, d))
    return rounded(structure.best_partition(e, ensemble.louvain(e, [1.0], 4).drop("gamma")))


@query()
def coverage_masks(spark, d):
    """Coverage and its bucket of seeded masks, ten a target."""
    rows = spark.range(60).select(F.col("id").alias("seed"), (0.1 + 0.1 * (F.col("id") % 6)).alias("target"))
    return rounded(layers.masks(rows).select("seed", "target", "coverage", layers.coverage_bucket(F.col("coverage")).alias("bucket")))


@query(FULL + TRI + ", p AS (SELECT a AS src, b AS dst FROM tri UNION ALL SELECT a, c FROM tri UNION ALL SELECT b, c FROM tri) SELECT src, dst, round((SELECT count(*) FROM p WHERE p.src = ends.src AND p.dst = ends.dst) + 1e-7 * (du + dv), 8) AS score FROM ends")
def scored_edges(spark, d):
    return rounded(repair.scored(trade.edges(spark, d)))


@query(FULL + ", low AS (SELECT id, 3 - degree AS lacks FROM deg WHERE degree < 3), two AS (SELECT x.id, lacks, y.other AS far, count(*) AS shared FROM low JOIN s x ON x.id = low.id JOIN s y ON y.id = x.other WHERE y.other <> x.id GROUP BY 1, 2, 3), legal AS (SELECT id, lacks, far, row_number() OVER (PARTITION BY id ORDER BY shared DESC, far) AS r FROM two WHERE id % 3 <> far % 3 AND NOT EXISTS (SELECT 1 FROM s WHERE s.id = two.id AND s.other = far)) SELECT src, dst FROM e UNION SELECT least(id, far), greatest(id, far) FROM legal WHERE r <= lacks")
def raised_degrees(spark, d):
    return repair.raise_degrees(*_coloured(spark, d))


@query()
def resolution_search(spark, d):
    """Labels of the resolution nearest to 40 labels."""
    return rounded(repair.resolution_for(trade.edges(spark, d), 40))


@query()
def block_coarsening(spark, d):
    """Labels inside each of four blocks of nations, four a block."""
    e, lab = trade.edges(spark, d), trade.nation_labels(spark, d)
    blocks = lab.select("id", (F.col("label") % 4).alias("block"))
    return repair.coarsen_blocks(e, blocks, spark.createDataFrame([(i, 4) for i in range(4)], "block long, target long"))


@query()
def rich_club_report(spark, d):
    e = _cut(trade.edges(spark, d))
    real = richclub.phi(e)
    table = richclub.null_table(ensemble.null_rich_clubs(e, 20), real)
    return rounded(inference.report(_cut(table.join(real.select("k", "n_above"), "k"))))


_RUNS = ", m AS (SELECT k FROM ph WHERE n_above >= 2 AND round(2.0 * e_above / (n_above * (n_above - 1)), 6) >= 0.02), rn AS (SELECT min(k) AS first, max(k) AS last, count(*) AS length FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM m) GROUP BY g)"
_ABOVE = ", ks AS (SELECT unnest(range(0, (SELECT max(degree) FROM deg))) AS k), dh AS (SELECT degree, count(*) AS n FROM deg GROUP BY 1), eh AS (SELECT least(du, dv) AS degree, count(*) AS n FROM ends GROUP BY 1), ph AS (SELECT k, (SELECT coalesce(sum(n), 0) FROM dh WHERE degree > k)::BIGINT AS n_above, (SELECT coalesce(sum(n), 0) FROM eh WHERE degree > k)::BIGINT AS e_above FROM ks)"


def regime_sql(marks: str) -> str:
    """CTEs that end in rg (k_lower, k_upper, rule), from a table of (k, significant)."""
    return f"""
, g0 AS (SELECT k, significant AS s FROM {marks}),
g1 AS (SELECT k, s FROM g0 WHERE k BETWEEN (SELECT min(k) FROM g0 WHERE s) AND (SELECT max(k) FROM g0 WHERE s)),
g2 AS (SELECT k, s, coalesce(s <> lag(s) OVER (ORDER BY k), true)::INT AS turn FROM g1),
g3 AS (SELECT k, s, sum(turn) OVER (ORDER BY k) AS run FROM g2),
g4 AS (SELECT run, min(k) AS a, max(k) AS b, count(*) AS n, bool_and(s) AS s FROM g3 GROUP BY run),
g5 AS (SELECT *, sum(CASE WHEN NOT s AND n >= 2 THEN 1 ELSE 0 END) OVER (ORDER BY run) AS piece FROM g4),
g6 AS (SELECT piece, min(a) AS a, max(b) AS b, max(b) - min(a) AS len, count(*) FILTER (NOT s) AS lone FROM g5 WHERE s OR n = 1 GROUP BY piece),
g7 AS (SELECT *, (SELECT count(*) FROM g6) AS pieces, (SELECT coalesce(max(len), 0) FROM g6 o WHERE o.piece <> g6.piece) AS other FROM g6),
rg AS (SELECT a AS k_lower, b AS k_upper, CASE WHEN lone = 0 THEN 'whole' ELSE 'outliers' END AS rule FROM g7 WHERE pieces = 1 AND lone <= 2
  UNION ALL SELECT a, b, 'longest' FROM g7 WHERE pieces > 1 AND len > 0 AND len >= 1.5 * other
  UNION ALL SELECT a, b, 'uppermost' FROM g7 WHERE pieces > 1 AND piece = (SELECT max(piece) FROM g7) AND NOT EXISTS (SELECT 1 FROM g7 WHERE len > 0 AND len >= 1.5 * other))"""


@query(FULL + _ABOVE + ", mk AS (SELECT k, round(2.0 * e_above / (n_above * (n_above - 1)), 6) >= 0.02 AS significant FROM ph WHERE n_above >= 2)" + regime_sql("mk") + " SELECT k_lower, k_upper, rule FROM rg")
def rich_club_regime(spark, d):
    """The regime of the thresholds whose club is two hundredths full or more."""
    marks = richclub.phi(trade.edges(spark, d)).select("k", (F.round("phi", 6) >= 0.02).alias("significant"))
    return inference.regime(_cut(marks))


@query()
def clustering_slope(spark, d):
    """Slope of log clustering on log degree over degree bands, with its interval."""
    bands = triangles.by_degree_band(trade.edges(spark, d)).where("clustering > 0")
    return rounded(inference.slope_interval(_cut(bands.select(F.log(F.col("band") * 30 + 15).alias("x"), F.log("clustering").alias("y"))), "x", "y"), 6)
