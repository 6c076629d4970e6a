"""Queries of the clustering pipeline and its layers, of store changes, jobs and the functions around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vexil.functions import text as T
from vexil.functions import vectors as V
from vexil.operators import agreement, batching, checks, hierarchy, kmeans, pipeline, reports, store
from vexil.plans.event_queries import LOG_SQL, _log
from vexil.plans.registry import query, table
from vexil.plans.search_queries import E_SQL, TRACE_SQL, embeddings, trace_of_labels
from vexil.storage import materialise
from vexil.streaming import jobs


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _rows(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", "vector")


@query()
def full_pipeline_membership(spark, sf_dir):
    """Ingest, top, mid, lower, final and membership, all of the engine's own clusterings."""
    return pipeline.run(_rows(spark, sf_dir), gate=16).members


@query()
def full_pipeline_counts(spark, sf_dir):
    return hierarchy.counts_by_level(pipeline.run(_rows(spark, sf_dir), gate=16).members)


@query()
def lower_split(spark, sf_dir):
    """Leaves of mid clusters that are split once more."""
    rows = embeddings(spark, sf_dir)
    return pipeline.lower_split(rows, rows.select("id", F.col("label").alias("mid_id")), 16)[0]


@query()
def second_level(spark, sf_dir):
    """Each label clustered again by itself."""
    rows = embeddings(spark, sf_dir)
    return pipeline.second_level(rows, rows.select("id", F.col("label").alias("top_id")))[0]


@query()
def elbow_search(spark, sf_dir):
    """The trace of both stages and the refit."""
    k, fallback, _, trace = kmeans.elbow_search(_rows(spark, sf_dir), 2, 24)
    return spark.createDataFrame([(n, float(j), stage, n == k, fallback) for n, j, stage in trace], "k long, objective double, stage string, chosen boolean, fallback boolean")


@query()
def kmeans_without_empty(spark, sf_dir):
    return kmeans.kmeans_no_empty(_rows(spark, sf_dir), 16)[0]


@query()
def knee_of_sample(spark, sf_dir):
    k, tried = kmeans.knee_of_sample(_rows(spark, sf_dir))
    return spark.createDataFrame([(n, n == k) for n in tried], "k long, chosen boolean")


@query()
def cluster_health(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return pipeline.cluster_health(agreement.evaluate_stability(rows, rows.select("label").distinct().count()).drop("runs"))


KS = (2, 4, 8)


@query(f"""{E_SQL}, p AS (SELECT id, v, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM e), ks AS (SELECT unnest([{", ".join(map(str, KS))}]) AS k),
starts AS (SELECT k, c, p.v FROM ks, range(8) t(c), p WHERE c < k AND pos = c * n // k),
near AS (SELECT k, id, p.v, c FROM (SELECT k, p.id, p.v, c, row_number() OVER (PARTITION BY k, p.id ORDER BY list_distance(p.v, s.v), c) AS r FROM starts s, p) AS p WHERE r = 1),
x AS (SELECT k, c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near), m AS (SELECT k, c, i, avg(x) AS m FROM x GROUP BY k, c, i), means AS (SELECT k, c, list(m ORDER BY i) AS v FROM m GROUP BY k, c),
cents AS (SELECT s.k, s.c, coalesce(m.v, s.v) AS v FROM starts s LEFT JOIN means m USING (k, c))
SELECT k::BIGINT AS k, round(avg(d), 6) AS objective FROM (SELECT k, id, min(list_distance(p.v, c.v) ** 2) AS d FROM cents c, p GROUP BY k, id) GROUP BY k""")
def refined_objectives(spark, sf_dir):
    """The objective after one refinement of the starting rows."""
    placed = materialise(kmeans.with_position(_rows(spark, sf_dir), "id"), "placed")
    found = kmeans.refined_objective(placed, placed.count(), list(KS))
    return spark.createDataFrame([(k, round(j, 6)) for k, j in zip(KS, found)], "k long, objective double")


@query(TRACE_SQL + """, b AS (SELECT unnest([3, 99, 4, 5]) AS k_value, unnest(['coarse', 'fine', 'guess', 'fine']) AS phase), j AS (SELECT b.*, t.objective FROM b LEFT JOIN t ON t.k = b.k_value)
SELECT k_value::BIGINT AS k, CASE WHEN phase NOT IN ('coarse', 'fine') THEN 'phase' ELSE 'objective' END AS reason FROM j WHERE phase NOT IN ('coarse', 'fine') OR objective IS NULL UNION ALL SELECT 77, 'chosen_k'""")
def trace_violations(spark, sf_dir):
    tried = spark.createDataFrame([(3, "coarse"), (99, "fine"), (4, "guess"), (5, "fine")], "k long, phase string")
    return checks.trace_violations(tried.join(trace_of_labels(spark, sf_dir), "k", "left"), 77)


@query("SELECT 'rows' AS reason, count(*) FILTER (WHERE vec_id % 9 > 0) AS n FROM embeddings UNION ALL SELECT 'unknown_centroid', count(*) FROM embeddings WHERE vec_id % 9 > 0 AND label > 6")
def clustering_violations(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", F.col("label").alias("cid"))
    return checks.clustering_violations(e.where("id % 9 > 0"), e.where("cid <= 6").select("cid").distinct(), e.count())


@query("SELECT count(*) AS n, min(label)::BIGINT AS least, max(label)::BIGINT AS most, count(*) AS distinct_ids FROM (SELECT DISTINCT label FROM embeddings WHERE label <> 1) HAVING max(label) <> count(*) - 1")
def centroid_number_violations(spark, sf_dir):
    return checks.centroid_number_violations(embeddings(spark, sf_dir).where("label <> 1").select(F.col("label").alias("cid")).distinct()).withColumnRenamed("distinct", "distinct_ids")


@query("SELECT label::BIGINT AS k_min, (vec_id % 4)::BIGINT AS k_max, CASE WHEN label < 1 OR vec_id % 4 < 1 THEN 'zero' ELSE 'order' END AS reason FROM embeddings WHERE label < 1 OR vec_id % 4 < 1 OR label > vec_id % 4")
def id_estimate_violations(spark, sf_dir):
    return checks.id_estimate_violations(embeddings(spark, sf_dir).select(F.col("label").alias("k_min"), (F.col("id") % 4).alias("k_max")))


@query("""WITH m AS (SELECT max(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x)))) AS m FROM embeddings)
SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: greatest(-127, least(127, round_even(x / (m / 127), 0)))::TINYINT) AS codes FROM embeddings, m""")
def int8_tensor_codes(spark, sf_dir):
    """Codes by one scale for the whole table."""
    rows = embeddings(spark, sf_dir)
    scale = rows.agg(V.tensor_scale("vector")).first()[0]
    return rows.select("id", V.quantise_int8("vector", F.lit(scale)).alias("codes"))


@query(LOG_SQL + ", gone AS (SELECT id FROM state WHERE NOT deleted AND id % 7 = 0) SELECT id, CASE WHEN id % 7 = 1 THEN 'patched' ELSE metadata END AS metadata FROM state WHERE NOT deleted AND id NOT IN (SELECT id FROM gone)")
def log_with_deletes_and_updates(spark, sf_dir):
    """The live rows after deletes and metadata updates have been appended to the log."""
    log = materialise(_log(spark, sf_dir), "log")
    alive = store.live(store.replay(log))
    log = store.append_deletes(log, alive.where("id % 7 = 0").select(F.col("id").alias("pos"), "id"))
    log = store.append_updates(log, alive.where("id % 7 = 1").select(F.col("id").alias("pos"), "id", F.lit("patched").alias("metadata")))
    return store.live(store.replay(log)).select("id", "metadata")


@query(LOG_SQL + " SELECT (SELECT max(lsn) FROM log) + row_number() OVER (ORDER BY vec_id) AS lsn, vec_id AS id FROM embeddings")
def appended_inserts(spark, sf_dir):
    log = _log(spark, sf_dir)
    last = log.agg(F.max("lsn")).first()[0]
    batch = embeddings(spark, sf_dir).select(F.col("id").alias("pos"), "id", "vector", F.lit(None).cast("string").alias("metadata"))
    return store.append_inserts(log, batch).where(F.col("lsn") > last).select("lsn", "id")


@query(LOG_SQL + " SELECT DISTINCT user_id AS id FROM events WHERE user_id IN (SELECT id FROM state WHERE NOT deleted)")
def present_ids(spark, sf_dir):
    return store.present(_events(spark, sf_dir).select(F.col("user_id").alias("id")).distinct(), store.replay(_log(spark, sf_dir)))


def _requests(spark, sf_dir):
    key = F.when(F.col("event_type") != "error", F.concat_ws(":", "user_id", "event_type"))
    return _events(spark, sf_dir).select(F.col("event_id").alias("job_id"), F.lit("tool").alias("task"), F.col("props").alias("payload"), key.alias("idem_key"), F.col("ts").cast("timestamp").alias("created"))


FIRST_SQL = "WITH f AS (SELECT event_id AS job_id, CASE WHEN event_type = 'error' THEN event_id ELSE first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS existing FROM events)"


@query(FIRST_SQL + " SELECT job_id, existing, existing <> job_id AS deduplicated FROM f")
def created_jobs(spark, sf_dir):
    return jobs.created(_requests(spark, sf_dir))["answers"]


@query(FIRST_SQL + " SELECT job_id, 'queued' AS status, 'queued' AS type, 'jobs' AS queue FROM f WHERE existing = job_id")
def created_job_effects(spark, sf_dir):
    """The hash row, the event and the message of each new job, side by side."""
    made = jobs.created(_requests(spark, sf_dir))
    return made["jobs"].select("job_id", "status").join(made["events"].select("job_id", "type"), "job_id").join(made["queue"].select("job_id", "queue"), "job_id")


@query("""WITH e AS (SELECT user_id AS job_id, event_id, epoch_us(ts) // 1000 AS ms, epoch_us(lag(ts) OVER w) AS before, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT job_id, event_id, ms, 'event' AS type FROM e UNION ALL SELECT job_id, NULL, (before + i * 21600000000) // 1000, 'heartbeat' FROM (SELECT *, unnest(range(1, floor((gap - 1e-6) / 21600)::BIGINT + 1)) AS i FROM e WHERE gap IS NOT NULL)""")
def tail_with_heartbeats(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "event_id", "ts", F.lit("event").alias("type"))
    return jobs.with_heartbeats(e, 21600).select("job_id", "event_id", T.epoch_ms("ts").alias("ms"), "type")


@query("""WITH e AS (SELECT event_id, event_type, user_id, CASE event_type WHEN 'signup' THEN 'user ' || user_id WHEN 'click' THEN CASE WHEN user_id % 3 < 2 THEN 'file ' || (user_id % 3) END END AS text FROM events),
h AS (SELECT *, last_value(text IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM e),
r AS (SELECT *, CASE WHEN event_type = 'click' AND text IS NULL THEN 'communications source file not found' WHEN event_type = 'purchase' THEN 'file_path must resolve within project root' WHEN event_type = 'view' AND held IS NULL THEN 'no communications text is stored yet'
  WHEN event_type = 'error' THEN 'unsupported communications action: <empty>' END AS error FROM h)
SELECT event_id AS job_id, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, CASE WHEN error IS NULL AND event_type = 'view' THEN held END AS text, CASE WHEN error IS NULL THEN length(CASE WHEN event_type = 'view' THEN held ELSE text END) END AS chars, error FROM r""")
def communications(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    action = F.when(kind == "signup", "Sync_Communications ").when(kind == "view", "print_communications").when(kind != "error", "sync_communications_from_file")
    path = F.when(kind == "purchase", "notes/../../secret").otherwise(F.concat(F.lit("./notes/"), (user % 3).cast("string"), F.lit(".txt")))
    payload = F.to_json(F.struct(action.alias("action"), F.concat(F.lit("user "), user).alias("text"), path.alias("file_path")))
    files = spark.createDataFrame([("notes/0.txt", "file 0"), ("notes/1.txt", "file 1")], "path string, text string")
    return jobs.communications(_events(spark, sf_dir).select(F.col("event_id").alias("job_id"), F.col("event_id").alias("seq"), payload.alias("payload")), files)


@query("WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id FROM p WHERE r <= 5")
def last_samples(spark, sf_dir):
    return reports.last_samples(_events(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id", 5)


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def distinct_keys(spark, sf_dir):
    return reports.distinct_keys(_events(spark, sf_dir), "user_id")


@query("""WITH s AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents WHERE doc_id % 10 > 0)
SELECT (SELECT count(*) FROM documents) AS discovered, (SELECT count(*) FROM documents WHERE doc_id % 10 > 0) AS read, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS skipped, (SELECT sum(n)::BIGINT FROM s) AS sentences, (SELECT count(*) FROM s WHERE n > 0) AS batches, (SELECT sum(n)::BIGINT FROM s WHERE n > 0) AS records""")
def pipeline_counters(spark, sf_dir):
    """Every tenth file counts as undecodable; the lines of a file are its sentences and one batch."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 10 > 0, F.col("text")).alias("text"))
    lines = files.select("path", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    return reports.pipeline_counters(files, lines, lines.groupBy("path").agg(F.count(F.lit(1)).alias("n")))


@query("WITH a AS (SELECT user_id, event_id % 50 AS batch, value < 60 AS ok FROM events), f AS (SELECT user_id, min(batch) FILTER (WHERE NOT ok) AS f FROM a GROUP BY user_id) SELECT user_id, max(batch) FILTER (WHERE ok AND (f IS NULL OR batch < f)) AS batch FROM a JOIN f USING (user_id) GROUP BY user_id")
def largest_safe_batch(spark, sf_dir):
    a = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 50).alias("batch"), (F.col("value") < 60).alias("ok"))
    return batching.largest_safe_of(a, "user_id")


@query("SELECT event_id, replace(props, '\"', '\\\"') AS escaped, props AS back FROM events")
def json_escapes(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", T.json_escape("props").alias("escaped"))
    return e.withColumn("back", T.json_unescape("escaped"))


@query("""SELECT event_id AS job_id, CASE WHEN user_id % 4 = 0 THEN '{}' WHEN user_id % 4 = 1 THEN '{"_raw":"no json"}' ELSE props END AS payload, CASE WHEN event_type = 'view' THEN '[1]' END AS result, event_id * 1000 AS created_ts, CASE WHEN user_id % 2 = 0 THEN 60 END::BIGINT AS ttl_s FROM events""")
def jobs_from_hashes(spark, sf_dir):
    user = F.col("user_id")
    fields = {
        "payload": F.when(user % 4 == 0, "").when(user % 4 == 1, "no json").otherwise(F.col("props")),
        "result": F.when(F.col("event_type") == "view", "[1]").otherwise(""),
        "created_ts": (F.col("event_id") * 1000).cast("string"),
        "ttl_s": F.when(user % 2 == 0, "60").otherwise("soon"),
    }
    return _events(spark, sf_dir).select(F.col("event_id").alias("job_id"), *T.job_from_hash(fields))


@query("SELECT event_id, '[' || repeat('#', f) || repeat('-', 10 - f) || ']' AS bar, epoch_us(ts) // 1000 AS ms, user_id % 3 = 0 AS flag FROM (SELECT *, floor(least(1, value / 50) * 10)::INT AS f FROM events)")
def bars_and_flags(spark, sf_dir):
    flag = F.when(F.col("user_id") % 3 == 0, " Yes").when(F.col("user_id") % 3 == 1, "off")
    return _events(spark, sf_dir).select("event_id", T.progress_bar("value", F.lit(50), 10).alias("bar"), T.epoch_ms("ts").alias("ms"), T.truthy(flag).alias("flag"))
