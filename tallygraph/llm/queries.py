"""The registered queries of the thirteen operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygraph.llm import ann, centroids, licenses, media, mixing, neardup, negatives, packing, pii, quality, secrets, sharding, substrings
from tallygraph.llm.common import table


def held_out():
    """Rows that no label is learnt from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=2, hundredths=80).drop("row", "component")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=2048)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows chosen: ids, leaf, tokens, epoch and place in the leaf's prefix."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "mix_domain", "mix_tokens", "mix_epoch", "mix_before", "mix_budget")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), window=20)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, seed="2")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one, so that some rows are mislabelled."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, label=label)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_media, op4_licenses, op5_neardup, op6_sharding, op7_packing, op8_mixing, op9_substrings, op10_neighbours, op11_centroids, op12_negatives, op13_secrets, pipeline)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_PHRASES = ", ".join(f"({_QUOTED(p)}, {_QUOTED(label)})" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"({i}, {', '.join(map(_QUOTED, t))})" for i, t in enumerate(licenses.TEMPLATES))
_ALNUM = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"



def _weights_sql(level: str, column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {_QUOTED(v)} THEN {float(w)!r}" for v, w in mixing.WEIGHTS[level].items()) + f" ELSE {mixing.DEFAULT_WEIGHT!r} END" if mixing.WEIGHTS[level] else repr(mixing.DEFAULT_WEIGHT)


def _fill_sql(level: str, parents: list[str], budget: str) -> str:
    """CTEs b_<level>: the children's budgets by water-filling, from that of the parents."""
    keys, by = ", ".join([*parents, level]), f"PARTITION BY {', '.join(parents)}" if parents else ""
    on = f"USING ({', '.join(parents)})" if parents else "ON true"
    return f"""n_{level} AS (SELECT {keys}, sum(own) * 2 AS s, {_weights_sql(level, level)} AS w FROM leaf GROUP BY {keys}),
t_{level} AS (SELECT n.*, s / w AS r, p.b, (p.b - coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM n_{level} n JOIN {budget} p {on} WINDOW o AS ({by} ORDER BY s / w, {level})),
b_{level} AS (SELECT {keys}, CASE WHEN u IS NULL THEN s::DOUBLE ELSE least(s::DOUBLE, w * u) END AS b FROM (SELECT *, (min(CASE WHEN t < r THEN {{'r': r, 'k': {level}, 't': t}} END) OVER ({by}))['t'] AS u FROM t_{level}))"""


#: Integer vectors of 64 clean components.
_WHOLE = "FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) {} AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and')"


def _centroids_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds, each assignment and each update a table expression of its own."""
    out = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v {_WHOLE.format("= 64")}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT row, vec_id, v, (min({{'d': d, 'c': c}})).c AS c, min(d) AS d FROM (SELECT row, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}) GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY row, vec_id, v"))
        if i < rounds:
            out.append(f"""s{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(f.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY j) AS m FROM s{i} GROUP BY c) f ON f.c = c{i}.c)""")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


_CRC32 = """b AS (SELECT row_number() OVER () AS row, doc_id, text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::INTEGER) AS b FROM documents),
k AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS k FROM range(256) r(i)),
c AS (SELECT row, doc_id, len(b) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda c, x: xor(c >> 8, k[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, k)"""

ORACLE_SQL = {
    "op11_centroids": _centroids_sql(40, 5),
    "op12_negatives": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v {_WHOLE.format("> 0")} AND label IS NOT NULL AND vec_id IS NOT NULL),
s AS MATERIALIZED (SELECT a.row AS a, a.vec_id AS anchor_id, b.row AS b, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS s
  FROM v a JOIN v b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, other AS positive_id, s AS positive_score, row_number() OVER (PARTITION BY a ORDER BY s DESC, other) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.a, p.k ORDER BY s DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score QUALIFY rank <= 3""",
    "op6_sharding": f"""
WITH RECURSIVE {_CRC32},
w(name, pos) AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, ''), 0::BIGINT FROM documents
  UNION ALL SELECT name, least(floor((pos + 1) * 4503599627370496.0 / (('0x' || substr(md5(name || ':' || pos), 1, 13))::BIGINT::DOUBLE + 1))::BIGINT, 25) FROM w WHERE pos < 25),
s AS (SELECT name, max(pos) FILTER (pos < 24) AS shard, max(pos) FILTER (pos < 25) AS grown FROM w GROUP BY name)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, crc)), 1, 15), doc_id NULLS FIRST, crc) - 1 AS slot, grown::INTEGER AS grown_shard
FROM c JOIN s ON name = coalesce(doc_id::VARCHAR, '')""",
    "op8_mixing": f"""
WITH r AS (SELECT doc_id, lang, source, {mixing.DOMAINS!r}[coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % {len(mixing.DOMAINS)} + 1] AS dm, coalesce(lang, '') AS la, coalesce(source, '') AS so,
  greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')), 1) AS n, md5(coalesce(text, '')) AS m FROM documents),
leaf AS (SELECT dm AS domain, la AS lang, so AS source, sum(n) AS own FROM r GROUP BY ALL), root AS (SELECT sum(own)::DOUBLE * 0.5 AS b FROM leaf),
{_fill_sql("domain", [], "root")}, {_fill_sql("lang", ["domain"], "b_domain")}, {_fill_sql("source", ["domain", "lang"], "b_lang")},
e AS (SELECT r.*, own, floor(b)::BIGINT AS budget, e FROM r JOIN leaf l ON dm = l.domain AND la = l.lang AND so = l.source JOIN b_source x ON dm = x.domain AND la = x.lang AND so = x.source, range(2) t(e)),
p AS (SELECT *, e * own + coalesce(sum(n) OVER (PARTITION BY dm, la, so, e ORDER BY substr(md5(concat_ws(':', '8', e, coalesce(doc_id::VARCHAR, ''), m)), 1, 15), doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e)
SELECT doc_id, lang, source, dm AS mix_domain, n::BIGINT AS mix_tokens, e::INTEGER AS mix_epoch, pos::BIGINT AS mix_before, budget AS mix_budget FROM p WHERE pos < budget""".replace(repr(mixing.DOMAINS), str(list(mixing.DOMAINS))),
    "op4_licenses": f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("coalesce(text, '')")} AS a FROM documents),
p AS (SELECT label, string_split(phrase, ' ') AS q FROM (VALUES {_PHRASES}) v(phrase, label)),
b AS (SELECT doc_id, label, unnest(list_filter(range(1, len(a) - len(q) + 2), lambda i: a[i : i + len(q) - 1] = q)) - 1 AS i FROM d, p),
t AS (SELECT t, label, {_ALNUM.format("line")} AS a, {_ALNUM.format("keys")} AS k FROM (VALUES {_TEMPLATES}) v(t, label, line, keys)),
n AS (SELECT t, label, ceil({licenses.SPAN} * len(a)) AS span, len(list_distinct(a)) AS n, len(list_distinct(k)) AS k, CASE WHEN len(list_distinct(a)) < {licenses.SHORT} THEN len(list_distinct(a)) ELSE ceil({licenses.THRESHOLD} * len(list_distinct(a)) - 1e-9) END AS need FROM t),
x AS (SELECT DISTINCT t, unnest(a) AS x FROM t), y AS (SELECT DISTINCT t, unnest(k) AS x, true AS key FROM t),
w AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM d),
h AS (SELECT doc_id, x.t, i, w.x, coalesce(key, false) AS key FROM w JOIN x USING (x) LEFT JOIN y ON y.t = x.t AND y.x = w.x),
h2 AS (SELECT h.* FROM h JOIN (SELECT doc_id, t FROM h JOIN n USING (t) GROUP BY doc_id, t HAVING count(DISTINCT x) >= min(need)) USING (doc_id, t)),
g AS (SELECT u.doc_id, u.t, u.i, count(DISTINCT v.x) AS c, count(DISTINCT v.x) FILTER (v.key) AS kc FROM h2 u JOIN n USING (t) JOIN h2 v ON v.doc_id = u.doc_id AND v.t = u.t AND v.i >= u.i AND v.i < u.i + span GROUP BY 1, 2, 3),
m AS (SELECT doc_id, label, c / n.n AS s FROM g JOIN n USING (t) WHERE c >= need AND kc = n.k),
l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM b) GROUP BY 1),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM b) GROUP BY 1),
bn AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi FROM b GROUP BY 1), sc AS (SELECT doc_id, max(s) AS s FROM m GROUP BY 1)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(bn.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(bl.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(s, 0)::DOUBLE AS score
FROM d LEFT JOIN bn USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN sc USING (doc_id)""",
    "op5_neardup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^ \\x09-\\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(a) >= 2 THEN list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) WHEN len(a) = 1 THEN a ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)""",
    "op9_substrings": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(a) - 18, 1))) AS i, a FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(a[i : i + 19], ' ')) AS g FROM s),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
d AS (SELECT DISTINCT doc_id, i + j AS i FROM l, range(20) t(j)),
k AS (SELECT doc_id, i, a[i] AS t FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM w)),
o AS (SELECT k.doc_id, count(*) AS m, string_agg(t, ' ' ORDER BY i) AS t FROM k ANTI JOIN d USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(a)::BIGINT AS n_words, (len(a) - coalesce(m, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)""",
}
