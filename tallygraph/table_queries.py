"""Queries of the table forms: no vertex or edge array leaves the executors, no ceiling.

Where an algorithm's choices are its own, a ``_law`` query checks the result by what SQL knows
of every right one, in one row or a row a null or step.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygraph.model import both_ways, degrees
from tallygraph.operators import closure, colouring, communities, ensemble, forests, lanczos, matching, partition, paths, rewiring, richclub, sketches, triangles
from tallygraph.operators.paths import _cut
from tallygraph.operators.ranges import Ranges
from tallygraph.plans import audit, inference
from tallygraph.queries import DISTANCES, FULL, query, rounded
from tallygraph.sources import trade
from tallygraph.structure_queries import _WEIGHTED, regime_sql

#: Resolution of the constant Potts model on the trade graph: about twice its density.
POTTS = 0.05
_COUNTS = FULL + ", c AS (SELECT (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM deg) AS n)"


def _edges(spark, d):
    return _cut(trade.edges(spark, d))


@query()
def leiden_labels(spark, d):
    """(id, label): connected communities of the whole trade graph by modularity."""
    return partition.leiden(_edges(spark, d))


@query()
def leiden_potts(spark, d):
    """(id, label) by the constant Potts model, each nation's block (of customers and
    suppliers, and parts by number) for itself."""
    return partition.leiden(_edges(spark, d), POTTS, "potts", trade.nation_labels(spark, d))


def _torn(edges, labels):
    """Labels whose inside edges leave them in several components."""
    return partition.connected(edges, labels).join(labels.toDF("id", "was"), "id").groupBy("was").agg(F.count_distinct("label").alias("n")).where("n > 1").count()


@query(_COUNTS + " SELECT quality, n AS vertices, 0::BIGINT AS torn, true AS not_below_louvain FROM c, (VALUES ('modularity'), ('potts')) q(quality)")
def leiden_law(spark, d):
    """Every vertex has a label, no label is torn, and the quality is not below Louvain's."""
    e, rows = _edges(spark, d), []
    for quality, gamma in (("modularity", 1.0), ("potts", POTTS)):
        labels, plain = partition.leiden(e, gamma, quality), partition.louvain(e, gamma, quality)
        score = (lambda x: communities.modularity(e, x)) if quality == "modularity" else (lambda x: partition.potts_quality(e, x, gamma))
        better = score(labels).first()[0] >= 0.99 * score(plain).first()[0]
        rows.append((quality, labels.count(), _torn(e, labels), better))
    return spark.createDataFrame(rows, "quality string, vertices long, torn long, not_below_louvain boolean")


@query(_COUNTS + " SELECT n AS vertices, true AS never_falls, true AS score_is_modularity, true AS near_the_kernel FROM c")
def louvain_law(spark, d):
    """Over tables: modularity recomputed from the labels is the score, never falls between
    levels, and is within 2 % of the sequential kernel's."""
    e = _edges(spark, d)
    m, found = e.count(), partition.levels(e, leiden=False)
    got = [communities.modularity(e, labels).first()[0] for labels, _ in found]
    falls = any(y < x - 1e-9 for x, y in zip(got, got[1:]))
    same = all(abs(x - q / m) < 1e-9 for x, (_, q) in zip(got, found))
    kernel = ensemble.louvain(e, [1.0], 1).select(F.col("vertex").alias("new_id"), "label")
    from tallygraph.model import relabel_ids

    best = communities.modularity(e, relabel_ids(e).join(kernel, "new_id").select("id", "label")).first()[0]
    return spark.createDataFrame([(found[-1][0].count(), not falls, same, got[-1] >= 0.98 * best)], "vertices long, never_falls boolean, score_is_modularity boolean, near_the_kernel boolean")


@query()
def hop_sketch(spark, d):
    """(h, pairs, share) by merged counters, and the relative standard error of a count."""
    return rounded(paths.hop_plot(sketches.neighbourhood(_edges(spark, d)))).withColumn("error", F.lit(round(sketches.error(10), 8)))


@query(DISTANCES + " SELECT d AS h, sum(pairs) OVER (ORDER BY d)::BIGINT AS pairs, true AS within FROM hist")
def hop_sketch_law(spark, d):
    """The exact hop plot, and whether the counters' is within three standard errors."""
    e = _edges(spark, d)
    exact, near = paths.hop_plot(_cut(ensemble.distance_histogram(e))), paths.hop_plot(sketches.neighbourhood(e))
    within = F.coalesce(F.abs(F.col("pairs") - F.col("near")) <= 3 * sketches.error(10) * F.col("pairs"), F.lit(False))
    return exact.join(near.select("h", F.col("pairs").alias("near")), "h", "left").select("h", "pairs", within.alias("within"))


@query()
def widest_forest(spark, d):
    """(src, dst, weight) of the spanning forest that keeps the most line items."""
    return forests.spanning_forest(trade.weighted(spark, d), "weight")


#: The largest forest of whole weights has n less the components of the edges of each weight or more.
_FOREST = (
    FULL.replace("WITH e AS (", "WITH e AS MATERIALIZED (") + _WEIGHTED.replace(" w AS (", " w AS MATERIALIZED (")
    + """, lv AS (SELECT unnest(range(1, (SELECT max(weight) FROM w)::BIGINT + 1)) AS t),
st AS MATERIALIZED (SELECT t, src AS a, dst AS b FROM w, lv WHERE weight >= t UNION ALL SELECT t, dst, src FROM w, lv WHERE weight >= t),
l0 AS MATERIALIZED (SELECT DISTINCT t, a AS id, a AS c FROM st)"""
    + "".join(
        f""",
n{i} AS MATERIALIZED (SELECT t, id, min(c) AS c FROM (SELECT t, id, c FROM l{i - 1} UNION ALL SELECT st.t, st.a, y.c FROM st JOIN l{i - 1} y ON y.t = st.t AND y.id = st.b) GROUP BY t, id),
l{i} AS MATERIALIZED (SELECT n.t, n.id, p.c FROM n{i} n JOIN n{i} p ON p.t = n.t AND p.id = n.c)"""
        for i in range(1, 11)
    )
    + """,
k AS (SELECT t, count(*) - count(DISTINCT c) AS kept FROM l10 GROUP BY t)
SELECT (SELECT kept FROM k WHERE t = 1)::BIGINT AS edges, sum(kept)::DOUBLE AS weight, true AS acyclic FROM k"""
)


@query(_FOREST)
def widest_forest_law(spark, d):
    """Number and weight of the forest's edges; without cycle: its components say so."""
    f = _cut(forests.spanning_forest(trade.weighted(spark, d), "weight"))
    labels = _cut(paths.components(f.select("src", "dst")))
    n, c = labels.agg(F.count("*"), F.count_distinct("component")).first()
    return f.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"), (F.count("*") == n - c).alias("acyclic"))


@query(FULL + ", t AS (SELECT count(*) AS n FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst) SELECT CASE WHEN n > 0 THEN 3 END::BIGINT AS length, true AS odd, true AS closed FROM t WHERE n > 0")
def odd_cycle_law(spark, d):
    """The witness starts nearest a root, so in a graph whose smallest vertex lies on a triangle it is one."""
    e = _edges(spark, d)
    ring = [r.vertex for r in forests.odd_cycle(e).orderBy("at").collect()]
    steps = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(ring, ring[1:] + ring[:1])], "src long, dst long")
    closed = steps.join(e, ["src", "dst"], "left_semi").count() == len(ring) == len(set(ring))
    return spark.createDataFrame([(len(ring), len(ring) % 2 == 1, closed)], "length long, odd boolean, closed boolean")


@query(_COUNTS + " SELECT i::BIGINT AS null_id, m AS edges, 0::BIGINT AS loops, 0::BIGINT AS repeated, 0::BIGINT AS off_degree, true AS mixed FROM c, range(3) r(i)")
def rewired_law(spark, d):
    """Three rewirings of the whole trade graph: simple, degrees kept, most edges new."""
    e = _edges(spark, d)
    got = rewiring.check(e, rewiring.rewired(e, 3))
    return got.select("null_id", "edges", "loops", "repeated", "off_degree", (F.col("kept") < 0.7 * F.col("edges")).alias("mixed"))


@query(_COUNTS + " SELECT i::BIGINT AS null_id, m AS edges, 0::BIGINT AS loops, 0::BIGINT AS repeated, 0::BIGINT AS off_degree FROM c, range(2) r(i)")
def rewired_layers_law(spark, d):
    """Two rewirings that keep every vertex's degree towards each of the three colours."""
    e = _edges(spark, d)
    layer = degrees(e).select("id", (F.col("id") % 3).alias("layer"))
    return rewiring.check(e, rewiring.rewired(e, 2, layer=layer), layer).drop("kept")


@query()
def rewired_rich_club(spark, d):
    """(k, phi, null_mean, null_sd, ratio, p) of the whole trade graph against 24 rewirings
    that keep the three colours."""
    e = _edges(spark, d)
    layer = degrees(e).select("id", (F.col("id") % 3).alias("layer"))
    null = rewiring.rich_clubs(e, rewiring.rewired(e, 24, layer=layer))
    own = _cut(richclub.phi(e))
    return rounded(rewiring.club_table(null, own))


@query()
def priority_colours(spark, d):
    """(id, colour) of the whole trade graph."""
    return rounded(colouring.priority_colouring(_edges(spark, d)))


@query(FULL + " SELECT count(*) AS vertices, 0::BIGINT AS clashes, 0::BIGINT AS first_colour, true AS few, true AS least FROM deg")
def priority_colours_law(spark, d):
    """Proper; at most the largest degree plus one colours; every vertex meets all lesser colours."""
    e = _edges(spark, d)
    c = _cut(colouring.priority_colouring(e))
    met = colouring.check(e, c).agg((F.sum("clashes") / 2).cast("long").alias("clashes"), F.count_if(F.col("lesser") == F.col("colour")).alias("full")).first()
    short, clashes = c.count() - met.full, met.clashes or 0
    most = degrees(e).agg(F.max("degree")).first()[0]
    return c.agg(F.count("*").alias("vertices"), F.lit(clashes).cast("long").alias("clashes"), F.min("colour").cast("long").alias("first_colour"), (F.max("colour") <= most).alias("few"), F.lit(short == 0).alias("least"))


@query()
def sketched_boxes(spark, d):
    """(radius, boxes): covers of the whole trade graph by balls of most estimated mass."""
    e = _edges(spark, d)
    rows = [(r, sketches.box_cover(e, r).select("centre").distinct().count()) for r in (1, 2)]
    return spark.createDataFrame(rows, "radius long, boxes long")


@query(FULL + " SELECT r::BIGINT AS radius, count(*) AS vertices, 0::BIGINT AS too_far, 0::BIGINT AS centres_too_near FROM deg, (VALUES (1), (2)) v(r) GROUP BY r")
def sketched_boxes_law(spark, d):
    """Every vertex lies within the radius of its centre, by walks; no two centres do."""
    e, rows = _edges(spark, d), []
    for r in (1, 2):
        boxes = _cut(sketches.box_cover(e, r))
        rows.append((r, boxes.count(), *sketches.check_cover(e, boxes, r)))
    return spark.createDataFrame(rows, "radius long, vertices long, too_far long, centres_too_near long")


@query(FULL.replace("WITH e AS (", "WITH e AS MATERIALIZED (") + ", x0 AS (SELECT id, 1.0::DOUBLE AS x FROM deg)" + "".join(f", y{i} AS MATERIALIZED (SELECT s.id, sum(x) AS x FROM s JOIN x{i} o ON o.id = s.other GROUP BY 1), x{i + 1} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})" for i in range(40)) + " SELECT round((SELECT sqrt(sum(x * x)) FROM y39), 3) AS lambda_max, true AS sure FROM (SELECT 1)")
def largest_eigenvalue(spark, d):
    """Of the whole trade graph by Lanczos, its residual below a thousandth; SQL takes powers."""
    a = lanczos.Matrix(_edges(spark, d))
    got = lanczos.lanczos(a, 16)
    a.tiles.close()
    return spark.createDataFrame([(round(float(got.values[-1]), 3), bool(got.residuals[-1] < 1e-3))], "lambda_max double, sure boolean")


@query()
def sparse_spectrum(spark, d):
    """Spectral measures of the whole trade graph, traces with their standard errors."""
    return rounded(lanczos.summary(_edges(spark, d)), 6)


@query()
def leading_vector(spark, d):
    """(id, value): the network value, entries of the leading vector in falling order, the first thousand."""
    a = lanczos.Matrix(_edges(spark, d))
    top = lanczos.lanczos(a, 16)
    a.tiles.close()
    v = top.vectors([len(top.values) - 1]).select("id", F.abs("value").alias("value"))
    return rounded(v.orderBy(F.col("value").desc(), "id").limit(1_000), 6)


@query(FULL + ", tri AS (SELECT count(*) AS n FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst), p AS (SELECT x.other AS a, y.other AS b, count(*) AS c FROM s x JOIN s y ON x.id = y.id AND x.other < y.other GROUP BY 1, 2), q AS (SELECT sum(c * (c - 1) / 2) AS n FROM p), w AS (SELECT sum(degree * (degree - 1) / 2) AS n FROM deg), m AS (SELECT count(*) AS n FROM e) SELECT power, walks, true AS within FROM (SELECT 2::BIGINT AS power, (2 * m.n)::BIGINT AS walks FROM m UNION ALL SELECT 3, (6 * n)::BIGINT FROM tri UNION ALL SELECT 4, (2 * m.n + 4 * w.n + 4 * q.n)::BIGINT FROM m, w, q)")
def closed_walks(spark, d):
    """Closed walks of two, three and four steps, counted; and whether the trace of that power of the
    adjacency matrix, from random vectors, is within four standard errors of it."""
    e = _edges(spark, d)
    a = lanczos.Matrix(e)
    top = lanczos.lanczos(a, 12)
    m = lanczos.moments(a, float(top.values[0] - top.residuals[0]), float(top.values[-1] + top.residuals[-1]), 3, 16)
    a.tiles.close()
    exact = triangles.closed_walks(e)
    rows = []
    for power, walks in ((r.power, r.walks) for r in exact.collect()):  # three rows
        near, off = m.trace(lambda x, p=power: x**p)
        rows.append((power, walks, abs(near - walks) <= 4 * off + 1e-9 * walks))
    return spark.createDataFrame(rows, "power long, walks long, within boolean")


@query(FULL + " SELECT count(*) AS vertices, true AS disjoint, true AS covers, true AS equal FROM deg")
def fractional_cover_law(spark, d):
    """No vertex holds more than one of the matching, every edge has one of the cover, and their sums agree."""
    e = _edges(spark, d)
    near = Ranges(e)
    x, y = matching.fractional(e, near)
    x, y = _cut(x), _cut(y)
    held = x.select(F.explode(F.array("src", "dst")).alias("id"), "x").groupBy("id").agg(F.sum("x").alias("x")).where("x > 1").count() == 0
    foreign, bare = matching.check(near, x, y)
    near.close()
    held = held and foreign == 0
    total = x.agg(F.sum("x")).first()[0]
    return y.agg(F.count("*").alias("vertices"), F.lit(held).alias("disjoint"), F.lit(bare == 0).alias("covers"), (F.sum("y") == total).alias("equal"))


#: The year whose club is held against those of all months outside, by the first month's year * 12 + month.
MONTH = 1995 * 12 + 1
_GROUP = f"CASE WHEN year({{0}}) * 12 + month({{0}}) BETWEEN {MONTH} AND {MONTH + 11} THEN {MONTH} ELSE year({{0}}) * 12 + month({{0}}) END"
_MONTHS = f"""WITH x AS (SELECT ({_GROUP.format("o_orderdate")})::BIGINT AS g, o_custkey * 3 AS c, l_partkey * 3 + 1 AS p, l_suppkey * 3 + 2 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
em AS MATERIALIZED (SELECT DISTINCT g, least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT g, c AS a, p AS b FROM x UNION ALL SELECT g, c, s FROM x UNION ALL SELECT g, p, s FROM x)),
dm AS MATERIALIZED (SELECT g, id, count(*) AS degree FROM (SELECT g, src AS id FROM em UNION ALL SELECT g, dst FROM em) GROUP BY ALL),
lm AS (SELECT em.g, least(x.degree, y.degree) AS low FROM em JOIN dm x ON x.g = em.g AND x.id = src JOIN dm y ON y.g = em.g AND y.id = dst),
ks AS (SELECT g, unnest(range(0, max(degree))) AS k FROM dm GROUP BY g),
pm AS MATERIALIZED (SELECT ks.g, k, n_above, e_above, 2.0 * e_above / (n_above * (n_above - 1)) AS phi FROM ks
  JOIN LATERAL (SELECT count(*) AS n_above FROM dm WHERE dm.g = ks.g AND degree > ks.k) ON true JOIN LATERAL (SELECT count(*) AS e_above FROM lm WHERE lm.g = ks.g AND low > ks.k) ON true WHERE n_above >= 2),
own AS (SELECT k, n_above, phi FROM pm WHERE g = {MONTH}),
tb AS (SELECT own.k, own.n_above, own.phi, avg(pm.phi) AS mean, stddev_samp(pm.phi) AS std, CASE WHEN avg(pm.phi) > 0 THEN own.phi / avg(pm.phi) END AS rho, (1.0 + count(*) FILTER (round(pm.phi, 12) >= round(own.phi, 12))) / (1 + count(*)) AS p FROM own JOIN pm ON pm.k = own.k AND pm.g <> {MONTH} GROUP BY own.k, own.n_above, own.phi)"""


def _monthly(spark, d):
    """Clubs of the trade graphs of a year and of every month outside it, and the table of the year against these."""
    lines = trade.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = trade.read(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(_GROUP.format("o_orderdate")).cast("long").alias("g"))
    ids = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("g", (F.col("o_custkey") * 3).alias("c"), (F.col("l_partkey") * 3 + 1).alias("p"), (F.col("l_suppkey") * 3 + 2).alias("s"))
    side = lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    e = _cut(ids.select("g", F.explode(F.array(side("c", "p"), side("c", "s"), side("p", "s"))).alias("e")).select("g", "e.src", "e.dst").distinct())
    club = _cut(richclub.phi_by(e, "g").withColumn("phi", F.round("phi", 12)))
    own, others = club.where(F.col("g") == MONTH), club.where(F.col("g") != MONTH).withColumnRenamed("g", "null_id")
    return _cut(richclub.null_table(others, own).join(own.select("k", "n_above"), "k")), others.select("null_id").distinct().count()


@query(_MONTHS + " SELECT k, n_above, round(phi, 8) + 0.0 AS phi, round(mean, 8) + 0.0 AS mean, round(std, 8) + 0.0 AS std, round(rho, 7) AS rho, round(p, 8) AS p FROM tb")
def monthly_club(spark, d):
    """A year's rich club against the ensemble of all other months' graphs."""
    table, _ = _monthly(spark, d)
    return rounded(table.withColumn("rho", F.round("rho", 7)))


@query(
    _MONTHS
    + f""", bh AS (SELECT *, least(1, min(p * n / i) OVER (ORDER BY i DESC)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM tb)),
mk AS (SELECT k, n_above, p, q < 0.2 AND coalesce(rho > 1, false) AS significant FROM bh), nl AS (SELECT count(DISTINCT g) AS n FROM pm WHERE g <> {MONTH})"""
    + regime_sql("mk")
    + """, rs AS (SELECT count(*) AS ranges FROM (SELECT DISTINCT k - row_number() OVER (ORDER BY k) AS j FROM mk WHERE significant)),
ins AS (SELECT min(k_lower) AS k_lower, max(k_upper) AS k_upper, max(rule) AS rule, count(*) AS thresholds, count(*) FILTER (NOT significant) AS others_inside, count(DISTINCT n_above) AS clubs_inside FROM mk, rg WHERE k BETWEEN k_lower AND k_upper),
sm AS (SELECT count(*) AS tests, (SELECT n FROM nl) AS nulls, 1.0 / ((SELECT n FROM nl) + 1) AS r, count(*) FILTER (significant) AS significant, count(DISTINCT CASE WHEN significant THEN n_above END) AS clubs FROM mk)
SELECT tests, nulls, round(r, 8) AS p_resolution, (SELECT count(*) FROM mk WHERE abs(p - r) <= 1e-9 * r) AS at_resolution, significant, clubs, (SELECT min(c) FROM range(1, (SELECT count(*) + 1 FROM mk)) t(c) WHERE r * tests / c < 0.2) AS needed, ranges, k_lower, k_upper, rule, thresholds, others_inside, clubs_inside,
CASE WHEN k_lower IS NULL THEN 'no_valid_regime' WHEN k_lower = k_upper THEN 'single_threshold_regime' ELSE 'valid_regime' END AS verdict FROM sm, rs, ins"""
)
def monthly_club_report(spark, d):
    """What that ensemble resolves, control of the false-discovery rate at a fifth, and the regime."""
    table, nulls = _monthly(spark, d)
    return rounded(inference.fdr_report(table, nulls, 0.2))


@query(FULL + " SELECT 300::BIGINT AS taken, 0::BIGINT AS joined, 0::BIGINT AS same_colour, 0::BIGINT AS without_wedge, true AS accounts, true AS biased")
def random_closure_law(spark, d):
    """New edges join two neighbours of a vertex, of different colours and not joined before; every
    draw is accounted for; centres are drawn by degree."""
    e = _edges(spark, d)
    colours = _cut(degrees(e).select("id", (F.col("id") % 3).alias("colour")))
    new, record = closure.random_closure(e, colours, 300)
    new = _cut(new)
    ends = new.select("src", "dst").distinct()
    mids = _cut(both_ways(e).toDF("src", "mid").join(ends, "src"))  # the ends' neighbours, few beside the edges
    held = both_ways(e).toDF("dst", "mid").join(mids, ["dst", "mid"]).select("src", "dst").distinct().count()
    r = record.agg(F.min((F.col("drawn") == F.col("joined_or_repeated") + F.col("stopped") + F.col("legal")) & (F.col("taken") <= F.col("legal"))).alias("ok"), F.min("bias").alias("bias")).first()
    return new.agg(
        F.count("*").alias("taken"), F.lit(e.join(ends, ["src", "dst"], "left_semi").count()).cast("long").alias("joined"), F.count_if((F.col("src") - F.col("dst")) % 3 == 0).alias("same_colour"),
        (F.count("*") - F.lit(held)).cast("long").alias("without_wedge"), F.lit(r.ok).alias("accounts"), F.lit(r.bias > 1.5).alias("biased"),
    )


@query(FULL.replace("WITH e AS (", "WITH e AS MATERIALIZED (") + ", tri AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst), p AS (SELECT a AS src, b AS dst FROM tri UNION SELECT a, c FROM tri UNION SELECT b, c FROM tri), x AS (SELECT 3::BIGINT AS size, (SELECT count(*) FROM tri) AS observed, true AS enriched UNION ALL SELECT 2, (SELECT count(*) FROM e ANTI JOIN p USING (src, dst)), false) SELECT size, observed, 4::BIGINT AS nulls, enriched FROM x WHERE observed > 0")
def clique_enrichment(spark, d):
    """Maximal cliques of the trade graph by size against four rewirings that keep the colours; a size is
    enriched three standard deviations above their mean."""
    e = _edges(spark, d)
    layer = degrees(e).select("id", (F.col("id") % 3).alias("layer"))
    both = rewiring.tiled(e, 4, layer=layer).unionByName(e.select(F.lit(-1).cast("long").alias("null_id"), "src", "dst"))
    got = _cut(triangles.clique_census(both, "null_id"))
    real, null = got.where("null_id = -1").select("size", "cliques"), got.where("null_id >= 0")
    table = audit.enrichment(real, null).where("real > 0")
    return table.select("size", F.col("real").alias("observed"), F.lit(4).cast("long").alias("nulls"), (F.coalesce("z", F.lit(0.0)) > 3).alias("enriched"))
