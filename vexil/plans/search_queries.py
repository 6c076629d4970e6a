"""Queries over embeddings: search, functions, validators, clustering steps, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators import agreement, checks, hierarchy, kmeans, reports, search
from vexil.plans.registry import query, table
from vexil.storage import materialise

DIM = 64


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def centroids(rows: DataFrame) -> DataFrame:
    """(cid, centroid): the mean vector of each label."""
    means = rows.select("label", F.posexplode("vector").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s")).select(F.col("label").alias("cid"), F.transform("s", lambda x: x["m"]).alias("centroid"))


E_SQL = "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings)"
C_SQL = E_SQL + """, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY label, pos),
c AS (SELECT label AS cid, list(m ORDER BY pos) AS c FROM m GROUP BY label)"""


def _best_sql(score: str) -> str:
    return f"""{E_SQL}, q AS (SELECT v AS q FROM e ORDER BY id LIMIT 1), s AS (SELECT id, {score} AS score FROM e, q)
SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10"""


def _first_vector(rows: DataFrame) -> list[float]:
    return list(rows.orderBy("id").select("vector").first()[0])


@query(_best_sql("list_dot_product(v, q)"))
def search_dot(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return search.search_exact(rows, _first_vector(rows), id_column="id").withColumn("score", V.rounded("score", 6))


@query(_best_sql("CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(q, q) > 0 THEN list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) ELSE 0 END"))
def search_cosine(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return search.search_exact(rows, _first_vector(rows), metric="cosine", id_column="id").withColumn("score", V.rounded("score", 6))


@query(f"""{E_SQL}, q AS (SELECT id AS query_id, v AS q FROM e WHERE id % 100 = 0), s AS (SELECT query_id, id, list_dot_product(v, q) AS score FROM e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def search_many(spark, sf_dir):
    """The queries are the vectors whose id is divisible by 100, against all."""
    rows = embeddings(spark, sf_dir)
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return search.search_many(rows, queries, id_column="id").withColumn("score", V.rounded("score", 6))


@query(f"""{E_SQL}, s AS (SELECT a.id AS query_id, b.id, list_dot_product(b.v, a.v) AS score FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def search_every(spark, sf_dir):
    """Every vector is a query."""
    rows = embeddings(spark, sf_dir)
    queries = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return search.search_many(rows, queries, id_column="id").withColumn("score", V.rounded("score", 6))


@query(C_SQL + ", s AS (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, c) DESC, cid) AS r FROM e, c) SELECT id, list(cid ORDER BY r) AS top FROM s WHERE r <= 2 GROUP BY id")
def top_centroids(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return search.top_centroids(rows, centroids(rows), id_column="id")


@query(C_SQL + ", s AS (SELECT id, cid, list_dot_product(v, c) AS score, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, c) DESC, cid) AS r FROM e, c) SELECT id, cid, round(score, 6) AS score FROM s WHERE r = 1")
def top_label(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return search.top_label(rows, centroids(rows), id_column="id").withColumn("score", V.rounded("score", 6))


NEAREST_SQL = C_SQL + ", s AS (SELECT id, cid, list_distance(v, c) ** 2 AS distance, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), cid) AS r FROM e, c), near AS (SELECT id, cid, distance FROM s WHERE r = 1)"


@query(NEAREST_SQL + " SELECT id, cid, round(distance, 6) AS distance FROM near")
def nearest_centroid(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return search.nearest_centroid(rows, centroids(rows), id_column="id").withColumn("distance", V.rounded("distance", 6))


def _matrix_of(cents: DataFrame):
    import numpy as np

    return np.array([r.centroid for r in cents.orderBy("cid").collect()], dtype=float)


@query(NEAREST_SQL + " SELECT id, cid, round(distance, 6) AS distance FROM near")
def assign_by_matrix(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return kmeans.assigned(rows, _matrix_of(centroids(rows))).withColumn("distance", V.rounded("distance", 6))


@query(NEAREST_SQL + " SELECT cid, count(*) AS n, round(sum(distance), 6) AS objective, round(max(distance), 6) AS far FROM near GROUP BY cid")
def lloyd_step(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return kmeans.cluster_sums(rows, _matrix_of(centroids(rows))).select("cid", "n", V.rounded("objective", 6).alias("objective"), V.rounded("far", 6).alias("far"))


@query(C_SQL + " SELECT cid, pos::INTEGER - 1 AS pos, round(x, 6) AS value FROM (SELECT cid, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM c)")
def centroid_means(spark, sf_dir):
    return centroids(embeddings(spark, sf_dir)).select("cid", F.posexplode("centroid").alias("pos", "value")).withColumn("value", V.rounded("value", 6))


@query(C_SQL + " SELECT cid, pos::INTEGER - 1 AS pos, round(x / n, 6) AS value FROM (SELECT cid, unnest(c) AS x, generate_subscripts(c, 1) AS pos, greatest(sqrt(list_dot_product(c, c)), 1e-12) AS n FROM c)")
def spherical_centroids(spark, sf_dir):
    c = centroids(embeddings(spark, sf_dir)).withColumn("centroid", V.normalise("centroid"))
    return c.select("cid", F.posexplode("centroid").alias("pos", "value")).withColumn("value", V.rounded("value", 6))


@query(NEAREST_SQL + " SELECT round(sum(distance), 5) AS sse, round(avg(distance), 6) AS mean FROM near")
def objective(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return search.nearest_centroid(rows, centroids(rows), id_column="id").agg(V.rounded(F.sum("distance"), 5).alias("sse"), V.rounded(F.avg("distance"), 6).alias("mean"))


@query(E_SQL + ", p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM e), w AS (SELECT DISTINCT (c * n) // 32 AS pos, c FROM p, range(32) t(c)) SELECT c, id FROM w JOIN p USING (pos)")
def starting_rows(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    placed = kmeans.with_position(rows.select("id"), "id")
    n = rows.count()
    wanted = spark.createDataFrame([(c, c * n // 32) for c in range(32)], "c long, pos long")
    return placed.join(F.broadcast(wanted), "pos").select("c", "id")


@query(E_SQL + " SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS max_abs, sqrt(list_dot_product(v, v)) BETWEEN 0.999 AND 1.001 AS guard FROM e")
def vector_norms(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", V.rounded(V.norm("vector"), 6).alias("norm"), V.rounded(V.max_abs("vector"), 6).alias("max_abs"), V.within_norm("vector").alias("guard"))


@query("""SELECT vec_id AS id, round(CASE WHEN m = 0 THEN 1 ELSE m / 127 END, 9) AS scale,
  list_transform(v, lambda x: greatest(-127, least(127, round_even(x / CASE WHEN m = 0 THEN 1 ELSE m / 127 END, 0)))::TINYINT) AS codes
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)""")
def int8_codes(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", V.rounded(V.int8_scale("vector"), 9).alias("scale"), V.quantise_int8("vector").alias("codes"))


@query(E_SQL + ", s AS (SELECT id, list_filter(v, lambda x, i: (i - 1) % 4 = 0) AS v FROM e) SELECT id, list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6)) AS reduced FROM s")
def stride_reduction(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", F.transform(V.stride("vector", 4), lambda x: V.rounded(x, 6)).alias("reduced"))


@query(E_SQL + " SELECT count(*) AS n, count(DISTINCT id) AS ids, 0::BIGINT AS not_finite, count(*) FILTER (WHERE sqrt(list_dot_product(v, v)) NOT BETWEEN 0.95 AND 1.05) AS norm_out, round(min(sqrt(list_dot_product(v, v))), 6) AS norm_min, round(max(sqrt(list_dot_product(v, v))), 6) AS norm_max, round(avg(sqrt(list_dot_product(v, v))), 6) AS norm_mean FROM e")
def vector_report(spark, sf_dir):
    r = checks.vector_report(embeddings(spark, sf_dir))
    return r.select("n", "ids", "not_finite", "norm_out", *[V.rounded(c, 6).alias(c) for c in ("norm_min", "norm_max", "norm_mean")])


@query(f"{E_SQL} SELECT id, CASE WHEN len(v) <> {DIM} THEN 'dimension' ELSE 'norm' END AS reason FROM e WHERE len(v) <> {DIM} OR sqrt(list_dot_product(v, v)) NOT BETWEEN 0.999 AND 1.001")
def embedding_violations(spark, sf_dir):
    return checks.embedding_violations(embeddings(spark, sf_dir), DIM)


@query(E_SQL + ", o AS (SELECT id AS pos, id * 7 % 1000 AS id, lag(id * 7 % 1000) OVER (ORDER BY id) AS before FROM e) SELECT pos, id, before FROM o WHERE id <= before")
def order_violations(spark, sf_dir):
    return checks.order_violations(embeddings(spark, sf_dir).select(F.col("id").alias("pos"), (F.col("id") * 7 % 1000).alias("id")))


@query("WITH a AS (SELECT vec_id AS pos, vec_id AS id FROM embeddings), b AS (SELECT vec_id AS pos, CASE WHEN vec_id % 50 = 0 THEN -1 ELSE vec_id END AS id FROM embeddings WHERE vec_id % 70 <> 1) SELECT count(a.id) AS n_a, count(b.id) AS n_b, count(*) FILTER (WHERE a.id IS DISTINCT FROM b.id) AS mismatches FROM a FULL JOIN b USING (pos)")
def id_alignment(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return checks.alignment(e.select(F.col("id").alias("pos"), "id"), e.where("id % 70 <> 1").select(F.col("id").alias("pos"), F.when(F.col("id") % 50 == 0, -1).otherwise(F.col("id")).alias("id")))


def _layers(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    tops = rows.select("id", F.col("label").alias("top_id"))
    mids = hierarchy.mid_ids(rows.select("id", F.col("label").alias("top_id"), (F.col("id") % 3).alias("mid")))
    gates = hierarchy.lower_gate(mids, 16)
    return rows, tops, mids, gates


L_SQL = """WITH e AS (SELECT vec_id AS id, label::BIGINT AS top_id, vec_id % 3 AS mid FROM embeddings),
k AS (SELECT top_id, max(mid) + 1 AS k FROM e GROUP BY top_id), o AS (SELECT top_id, coalesce(sum(k) OVER (ORDER BY top_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM k),
mids AS (SELECT id, e.top_id, (mid + offset_)::BIGINT AS mid_id FROM e JOIN o USING (top_id)),
gates AS (SELECT top_id, mid_id, count(*) AS n, CASE WHEN count(*) <= 16 THEN 'stop' ELSE 'continue' END AS gate FROM mids GROUP BY top_id, mid_id),
lower_ AS (SELECT *, row_number() OVER (ORDER BY top_id, mid_id) - 1 AS lower_id FROM gates),
finals AS (SELECT row_number() OVER (ORDER BY top_id, mid_id) - 1 AS final_id, top_id, mid_id, n FROM gates WHERE gate = 'stop'),
members AS (SELECT id, m.top_id, m.mid_id, coalesce(CASE WHEN gate = 'continue' THEN lower_id END, 4294967295) AS lower_id, coalesce(final_id, 4294967295) AS final_id
  FROM mids m JOIN lower_ USING (top_id, mid_id) LEFT JOIN finals f ON f.top_id = m.top_id AND f.mid_id = m.mid_id)"""


@query(L_SQL + " SELECT * FROM mids")
def mid_ids(spark, sf_dir):
    return _layers(spark, sf_dir)[2]


@query(L_SQL + " SELECT * FROM gates")
def lower_gate(spark, sf_dir):
    return _layers(spark, sf_dir)[3]


@query(L_SQL + " SELECT top_id, mid_id, n, CASE WHEN n >= 17 THEN 'continue' ELSE 'stop' END AS gate FROM gates")
def gate_by_size(spark, sf_dir):
    return hierarchy.gate_by_size(_layers(spark, sf_dir)[3], 17)


@query(L_SQL + " SELECT count(*) FILTER (WHERE gate = 'stop') AS stop, count(*) FILTER (WHERE gate = 'continue') AS continue, sum(n)::BIGINT AS processed FROM gates")
def gate_counts(spark, sf_dir):
    return hierarchy.gate_counts(_layers(spark, sf_dir)[3])


@query(L_SQL + " SELECT * FROM finals")
def final_clusters(spark, sf_dir):
    return hierarchy.final_clusters(_layers(spark, sf_dir)[3])


@query(L_SQL + " SELECT id, final_id FROM mids JOIN finals USING (top_id, mid_id)")
def final_assignments(spark, sf_dir):
    _, _, mids, gates = _layers(spark, sf_dir)
    return hierarchy.final_assignments(mids, hierarchy.final_clusters(gates))


def _members(spark, sf_dir):
    rows, tops, mids, gates = _layers(spark, sf_dir)
    return hierarchy.membership(rows, tops, mids, hierarchy.lower_ids(gates), hierarchy.final_clusters(gates))


@query(L_SQL + " SELECT * FROM members")
def membership(spark, sf_dir):
    return _members(spark, sf_dir)


@query(L_SQL + " SELECT 'top' AS level, top_id AS cluster_id, count(*) AS n FROM members GROUP BY top_id UNION ALL SELECT 'mid', mid_id, count(*) FROM members GROUP BY mid_id UNION ALL SELECT 'final', final_id, count(*) FROM members GROUP BY final_id UNION ALL SELECT 'all', -1, count(*) FROM members")
def counts_by_level(spark, sf_dir):
    return hierarchy.counts_by_level(_members(spark, sf_dir))


B_SQL = L_SQL + """, sizes AS (SELECT 1 AS stage, 0::BIGINT AS source_id, count(*) AS n, 'none' AS gate FROM e UNION ALL SELECT 2, top_id, count(*), 'none' FROM e GROUP BY top_id UNION ALL SELECT 3, mid_id, n, gate FROM gates),
bounds AS (SELECT *, CASE WHEN gate = 'stop' THEN 1 ELSE greatest(1, least(32, n)) END::BIGINT AS k_min, CASE WHEN gate = 'stop' THEN 1 ELSE greatest(least(32, n), least(256, n)) END::BIGINT AS k_max FROM sizes)"""


@query(B_SQL + " SELECT * FROM bounds")
def k_bounds(spark, sf_dir):
    rows, tops, _, gates = _layers(spark, sf_dir)
    return hierarchy.k_bounds_table(rows, tops, gates)


@query(B_SQL + " SELECT stage, count(*) AS rows FROM bounds GROUP BY stage")
def rows_by_stage(spark, sf_dir):
    rows, tops, _, gates = _layers(spark, sf_dir)
    return hierarchy.rows_by_stage(hierarchy.k_bounds_table(rows, tops, gates))


@query("SELECT label::BIGINT AS top_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label)::INTEGER AS place FROM embeddings GROUP BY label")
def group_order(spark, sf_dir):
    return hierarchy.group_order(_layers(spark, sf_dir)[1])


@query("WITH g AS (SELECT label * 100 + vec_id % 8 AS cluster, count(*) AS n, count(*) FILTER (WHERE vec_id % 5 > 0) AS live FROM embeddings GROUP BY 1) SELECT cluster::BIGINT AS cluster, n, live, CASE WHEN n < 8 THEN 'too_few_vectors' WHEN live < 8 THEN 'too_few_live_vectors' END AS reason, n >= 8 AND live >= 8 AS eligible FROM g")
def second_level_eligibility(spark, sf_dir):
    g = embeddings(spark, sf_dir).groupBy((F.col("label") * 100 + F.col("id") % 8).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 5 > 0).alias("live"))
    return hierarchy.second_level_eligibility(g)


@query("WITH p AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), t AS (SELECT count(*) AS t FROM p), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b), s AS (SELECT n / t AS p, sum(n) OVER (PARTITION BY a) / t AS pa, sum(n) OVER (PARTITION BY b) / t AS pb FROM c, t) SELECT round(sum(p * ln(p / (pa * pb))) / sqrt(sum(p * ln(pa)) * sum(p * ln(pb))), 9) AS nmi FROM s")
def nmi(spark, sf_dir):
    return agreement.nmi(embeddings(spark, sf_dir).select(F.col("label").alias("a"), (F.col("id") % 7).alias("b"))).select(V.rounded("nmi", 9).alias("nmi"))


@query("WITH p AS (SELECT label::BIGINT AS a1, (label + 1)::BIGINT AS a2, vec_id % 10 AS b1, (vec_id + 1) % 10 AS b2 FROM embeddings) SELECT round(avg(len(list_intersect([a1, a2], [b1, b2])) / len(list_distinct([a1, a2, b1, b2]))), 9) AS jaccard FROM p")
def mean_jaccard(spark, sf_dir):
    pairs = embeddings(spark, sf_dir).select(F.array(F.col("label"), F.col("label") + 1).alias("a"), F.array(F.col("id") % 10, (F.col("id") + 1) % 10).alias("b"))
    return agreement.mean_jaccard(pairs).select(V.rounded("jaccard", 9).alias("jaccard"))


@query("WITH p AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), n AS (SELECT count(*)::DOUBLE AS n FROM p), c AS (SELECT sum(x * (x - 1) / 2.0) AS s FROM (SELECT count(*) AS x FROM p GROUP BY a, b)), a AS (SELECT sum(x * (x - 1) / 2.0) AS s FROM (SELECT count(*) AS x FROM p GROUP BY a)), b AS (SELECT sum(x * (x - 1) / 2.0) AS s FROM (SELECT count(*) AS x FROM p GROUP BY b)) SELECT round(1 - (a.s + b.s - 2 * c.s) / (n * (n - 1) / 2), 9) AS agreement FROM n, a, b, c")
def co_membership(spark, sf_dir):
    return agreement.co_membership(embeddings(spark, sf_dir).select(F.col("label").alias("a"), (F.col("id") % 7).alias("b"))).select(V.rounded("agreement", 9).alias("agreement"))


D_SQL = E_SQL + """, u AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e ORDER BY id LIMIT 4096),
d AS (SELECT a.id, greatest(1e-9, 1 - greatest(-1, least(1, list_dot_product(a.v, b.v)))) AS d FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d),
w AS (SELECT id, min(d) AS d1, max(d) AS d2 FROM r WHERE r <= 2 GROUP BY id), m AS (SELECT id, ln(2) / ln(d2 / d1) AS m FROM w WHERE d2 > d1)"""


def _dimensions(spark, sf_dir):
    # all rows up to 4096, beyond that a sample of the whole table; the SQL has the same rows only up to 4096
    sample = agreement.sample_by_hash(embeddings(spark, sf_dir), 1234, ratio=1.0)
    return agreement.local_dimensions(materialise(sample.withColumn("vector", V.normalise("vector")), "sample"))


@query(D_SQL + " SELECT id, round(m, 4) AS m FROM m")
def local_dimensions(spark, sf_dir):
    return _dimensions(spark, sf_dir).withColumn("m", V.rounded("m", 4))


@query(D_SQL + ", q AS (SELECT list(m ORDER BY m) AS l FROM m) SELECT 0.25::DOUBLE AS p, round(l[floor(0.25 * (len(l) - 1))::BIGINT + 1], 4) AS value FROM q UNION ALL SELECT 0.75, round(l[floor(0.75 * (len(l) - 1))::BIGINT + 1], 4) FROM q")
def quartiles_by_place(spark, sf_dir):
    return agreement.quantile_at_floor(_dimensions(spark, sf_dir), "m", 0.25, 0.75).withColumn("value", V.rounded("value", 4))


@query(D_SQL + """, q AS (SELECT list(m ORDER BY m) AS l FROM m), a AS (SELECT greatest(2, least(512, l[floor(0.25 * (len(l) - 1))::BIGINT + 1])) AS m_low, l[floor(0.75 * (len(l) - 1))::BIGINT + 1] AS h FROM q),
b AS (SELECT m_low, greatest(m_low, least(512, h)) AS m_high, (SELECT count(*) FROM embeddings) AS n FROM a), c AS (SELECT *, sqrt(n) * sqrt((m_low + m_high) / 2 / 32) AS k FROM b),
g AS (SELECT m_low, m_high, greatest(8, 2 ** floor(log2(floor(greatest(1, 0.5 * k)))))::BIGINT AS k_min, least(8192, 2 ** ceil(log2(floor(greatest(1, 2 * k)))))::BIGINT AS k_max FROM c)
SELECT round(m_low, 4) AS m_low, round(m_high, 4) AS m_high, CASE WHEN k_min >= k_max THEN greatest(8, k_max // 2) ELSE k_min END AS k_min, k_max FROM g""")
def k_range(spark, sf_dir):
    r = agreement.k_range(_dimensions(spark, sf_dir), embeddings(spark, sf_dir).count())
    return r.select(V.rounded("m_low", 4).alias("m_low"), V.rounded("m_high", 4).alias("m_high"), "k_min", "k_max")



#: The objective with the means of labels below k as centroids, for each k: a trace that SQL can have too.
TRACE_SQL = C_SQL + """, ks AS (SELECT cid + 1 AS k FROM c WHERE cid > 0), d AS (SELECT k, e.id, min(list_distance(v, c) ** 2) AS d FROM ks JOIN c ON cid < k, e GROUP BY k, e.id), t AS (SELECT k, sum(d) AS objective FROM d GROUP BY k)"""


def trace_of_labels(spark, sf_dir) -> DataFrame:
    """(k, objective), all ks in one pass."""
    rows = embeddings(spark, sf_dir)
    c = _matrix_of(centroids(rows))
    sums = kmeans.cluster_sums(rows, *[c[:k] for k in range(2, len(c) + 1)])
    return sums.groupBy((F.col("model") + 2).cast("long").alias("k")).agg(F.sum("objective").alias("objective"))


@query(TRACE_SQL + ", l AS (SELECT *, lead(k) OVER (ORDER BY k) AS k2, lead(objective) OVER (ORDER BY k) AS j2 FROM t) SELECT k, round(CASE WHEN objective <= 0 OR k2 IS DISTINCT FROM k + 1 THEN 0 ELSE (objective - j2) / objective END, 9) AS gain FROM l")
def elbow_gains(spark, sf_dir):
    return reports.gains(trace_of_labels(spark, sf_dir)).withColumn("gain", V.rounded("gain", 9))


@query(TRACE_SQL + " SELECT k, round(coalesce(lag(objective) OVER w - 2 * objective + lead(objective) OVER w, '-infinity'::DOUBLE), 5) AS bend FROM t WINDOW w AS (ORDER BY k)")
def elbow_bends(spark, sf_dir):
    return reports.bends(trace_of_labels(spark, sf_dir)).withColumn("bend", F.when(F.col("bend") > float("-inf"), V.rounded("bend", 5)).otherwise(F.col("bend")))


def _objectives(spark, sf_dir):
    """The objective of a k-means of all rows for each k from 2 to 12."""
    placed = materialise(kmeans.with_position(embeddings(spark, sf_dir).select("id", "vector"), "id"), "placed")
    ks = list(range(2, 13))
    found = kmeans.kmeans_each(placed, placed.count(), ks, kmeans.PROBE_ITERATIONS)
    return spark.createDataFrame([(k, j) for k, (_, j) in zip(ks, found)], "k long, objective double")


@query()
def kmeans_elbow_gains(spark, sf_dir):
    return reports.gains(_objectives(spark, sf_dir))


@query()
def kmeans_elbow_bends(spark, sf_dir):
    return reports.bends(_objectives(spark, sf_dir))


@query()
def kmeans_stability(spark, sf_dir):
    """Several seeds, as many clusters as labels."""
    rows = embeddings(spark, sf_dir)
    return agreement.evaluate_stability(rows, rows.select("label").distinct().count())


@query()
def kmeans_top(spark, sf_dir):
    """The whole top layer: choice of k and assignments."""
    return kmeans.cluster_top(embeddings(spark, sf_dir))[0]


@query()
def kmeans_groups(spark, sf_dir):
    """The mid layer: every label clustered by itself."""
    return kmeans.cluster_groups(embeddings(spark, sf_dir).select("id", "vector", F.col("label").alias("top_id")))
