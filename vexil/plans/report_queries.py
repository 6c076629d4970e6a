"""Queries of the remaining reports, validators and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators import checks, hierarchy, reports, store
from vexil.plans.event_queries import KIND, _log
from vexil.plans.registry import query, table
from vexil.plans.search_queries import L_SQL, TRACE_SQL, _layers, _members, embeddings, trace_of_labels
from vexil.streaming import jobs


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""WITH r AS (SELECT event_type, event_id % 2 AS side, median(value) AS m, list_sort(list(value))[round_even((count(*) - 1) * 0.95, 0)::BIGINT + 1] AS p, stddev_pop(value) / median(value) AS v FROM events GROUP BY ALL)
SELECT a.event_type, CASE WHEN a.m > b.m * 1.01 THEN 'median' WHEN a.p > b.p * 1.01 THEN 'p95' ELSE 'variance' END AS reason FROM r a JOIN r b ON a.event_type = b.event_type AND a.side = 1 AND b.side = 0 WHERE a.m > b.m * 1.01 OR a.p > b.p * 1.01 OR a.v > 0.35""")
def regressions(spark, sf_dir):
    side = lambda r: reports.run_statistics(_events(spark, sf_dir).where(F.col("event_id") % 2 == r), "event_type", "value")
    return reports.regressions(side(1), side(0), "event_type", 0.01, 0.01)


@query("""WITH a AS (SELECT event_type, avg(value) AS estimate FROM events WHERE event_id % 2 = 0 GROUP BY event_type), b AS (SELECT event_type, avg(value) AS actual FROM events WHERE event_id % 2 = 1 GROUP BY event_type)
SELECT event_type, round(estimate, 6) AS estimate, round(actual, 6) AS actual, round(actual - estimate, 6) AS delta, round(100 * (actual - estimate) / estimate, 6) AS percent FROM a JOIN b USING (event_type)""")
def estimate_errors(spark, sf_dir):
    side = lambda r, n: _events(spark, sf_dir).where(F.col("event_id") % 2 == r).groupBy("event_type").agg(F.avg("value").alias(n))
    r = reports.estimate_errors(side(0, "estimate"), side(1, "actual"), "event_type")
    return r.select("event_type", *[V.rounded(c, 6).alias(c) for c in ("estimate", "actual", "delta", "percent")])


@query("SELECT count(*) FILTER (WHERE event_type = 'signup')::BIGINT AS inserted, max(user_id) AS clusters, round(sum(value), 3) AS latency_ms FROM events")
def run_summary(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.when(F.col("event_type") == "signup", 1).alias("inserted"), F.col("user_id").alias("clusters"), F.col("value").alias("elapsed_ms"))
    return reports.run_summary(e).withColumn("latency_ms", V.rounded("latency_ms", 3))


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(*) >= 65 AS eligible, sum(value) AS ms FROM events GROUP BY user_id)
SELECT count(*) FILTER (WHERE eligible) AS processed, count(*) FILTER (WHERE NOT eligible) AS skipped, coalesce(sum(n) FILTER (WHERE eligible), 0)::BIGINT AS vectors, round(sum(n) FILTER (WHERE eligible) * 1000.0 / sum(ms) FILTER (WHERE eligible), 6) AS vectors_per_s FROM g""")
def second_level_summary(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("elapsed_ms")).withColumn("eligible", F.col("n") >= 65)
    return hierarchy.second_level_summary(g).withColumn("vectors_per_s", V.rounded("vectors_per_s", 6))


@query("""SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def telemetry_lines(spark, sf_dir):
    return reports.telemetry_json(_events(spark, sf_dir).select("event_id", "user_id", "event_type"))


@query(TRACE_SQL + """, b AS (SELECT 1::BIGINT AS k_min, 9::BIGINT AS k_max, 5::BIGINT AS chosen_k UNION ALL SELECT 1, 99, 50)
SELECT k_min, k_max, chosen_k, round(coalesce(t.objective, (SELECT min(objective) FROM t)), 5) AS objective FROM b LEFT JOIN t ON k = chosen_k""")
def cluster_stats(spark, sf_dir):
    rows = spark.createDataFrame([(1, 9, 5), (1, 99, 50)], "k_min long, k_max long, chosen_k long")
    return hierarchy.cluster_stats(rows, trace_of_labels(spark, sf_dir)).withColumn("objective", V.rounded("objective", 5))


@query("""WITH i AS (SELECT DISTINCT user_id AS id FROM events), m AS (SELECT user_id AS id, arg_max(props, event_id) AS metadata FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT id, metadata, id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) AS deleted FROM i LEFT JOIN m USING (id)""")
def metadata_and_tombstones(spark, sf_dir):
    e = _events(spark, sf_dir).withColumnsRenamed({"user_id": "id", "event_id": "line"})
    return store.attach(e.select("id").distinct(), e.where("event_type = 'view'").select("id", "line", F.col("props").alias("metadata")), e.where("event_type = 'error' AND value > 60").select("id"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 11 = 0")
def missing_vectors(spark, sf_dir):
    rows, tops, _, _ = _layers(spark, sf_dir)
    return hierarchy.missing_vectors(tops, rows.where("id % 11 <> 0"))


@query(L_SQL + " SELECT id FROM members m JOIN gates g USING (top_id, mid_id) WHERE gate = 'stop' AND id % 2 = 0")
def membership_without_final(spark, sf_dir):
    _, _, _, gates = _layers(spark, sf_dir)
    none = F.lit(V.NONE).cast("long")
    members = _members(spark, sf_dir).withColumn("final_id", F.when(F.col("id") % 2 == 0, none).otherwise(F.col("final_id")))
    return hierarchy.membership_violations(members, gates).select("id")


@query(L_SQL + " SELECT 'duplicate_id' AS reason, 0::BIGINT AS n UNION ALL SELECT 'parents', count(*) FROM (SELECT mid_id % 3 FROM members GROUP BY 1 HAVING count(DISTINCT top_id) > 1)")
def membership_report(spark, sf_dir):
    return checks.membership_violations(_members(spark, sf_dir).withColumn("mid_id", F.col("mid_id") % 3))


@query("SELECT vec_id AS id, label::BIGINT AS cid FROM embeddings WHERE label > 6")
def assignments_without_centroid(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", F.col("label").alias("cid"))
    return checks.assignment_violations(e, e.where("cid <= 6").select("cid").distinct()).select("id", "cid")


@query("SELECT vec_id AS id, label::BIGINT AS k_min, 5::BIGINT AS k_max, (label + vec_id % 2)::BIGINT AS chosen_k FROM embeddings WHERE label > 5 OR label + vec_id % 2 > 5 OR label < 1")
def bounds_violations(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("id", F.col("label").alias("k_min"), F.lit(5).cast("long").alias("k_max"), (F.col("label") + F.col("id") % 2).alias("chosen_k"))
    return checks.bounds_violations(rows)


@query("SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: round(x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 5)) AS unit FROM embeddings")
def normalised_vectors(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", F.transform(V.normalise("vector"), lambda x: V.rounded(x, 5)).alias("unit"))


@query("SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: (x * 1000)::BIGINT), ',') AS csv, list_transform(embedding, lambda x: (x * 1000)::BIGINT::FLOAT) AS vector FROM embeddings")
def csv_vectors(spark, sf_dir):
    c = embeddings(spark, sf_dir).select("id", V.to_csv(F.transform("vector", lambda x: F.rint(x * F.lit(1000).cast("float")).cast("long"))).alias("csv"))
    return c.withColumn("vector", V.parse_csv("csv"))


@query("SELECT event_id, user_id::DOUBLE AS ram_used_mb, 200.0::DOUBLE AS ram_total_mb, (user_id % 100)::DOUBLE AS gpu_percent, [(event_id % 7)::DOUBLE, NULL] AS cpu_percent FROM events")
def monitor_lines(spark, sf_dir):
    e = _events(spark, sf_dir)
    line = F.format_string("RAM %d/200MB CPU [%d%%@729,off] GR3D_FREQ %d%% CPU@40C", F.col("user_id"), F.col("event_id") % 7, F.col("user_id") % 100)
    return reports.monitor_values(e.select("event_id", line.alias("line"))).select("event_id", "ram_used_mb", "ram_total_mb", "gpu_percent", "cpu_percent")


@query("SELECT user_id AS name, min(event_id)::VARCHAR AS expected, CASE WHEN user_id % 3 > 0 THEN max(event_id)::VARCHAR END AS found FROM events GROUP BY user_id HAVING user_id % 3 = 0 OR min(event_id) <> max(event_id)")
def checksum_mismatches(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.col("user_id").alias("name")).agg(F.min("event_id").cast("string").alias("a"), F.max("event_id").cast("string").alias("b"))
    return checks.checksum_mismatches(e.select("name", F.col("a").alias("digest")), e.where("name % 3 > 0").select("name", F.col("b").alias("digest")))


@query("SELECT event_id AS job_id, CASE WHEN event_type = 'view' THEN 'error' ELSE 'done' END AS status, CASE WHEN event_type <> 'view' THEN 'echo(task=' || event_type || ')' END AS result FROM events")
def echo_results(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("task"))
    return jobs.echo(e)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    return jobs.windowed_counts(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("window.start").alias("hour"), "event_type", "n", V.rounded("total", 4).alias("total"))


@query("SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT id FROM (SELECT user_id AS id, arg_max(event_type, event_id) AS t FROM events WHERE event_type <> 'view' GROUP BY user_id) WHERE t <> 'error')")
def deletes_of_missing(spark, sf_dir):
    return store.delete_missing(_events(spark, sf_dir).select(F.col("user_id").alias("id")).distinct(), store.replay(_log(spark, sf_dir)))


@query(f"SELECT status, count(*) AS n FROM (SELECT {KIND} AS status FROM events) GROUP BY status")
def events_by_type(spark, sf_dir):
    return reports.rows_by_key(_events(spark, sf_dir).select(F.expr(KIND).alias("status")), "status")
