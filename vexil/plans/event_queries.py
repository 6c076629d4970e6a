"""Queries over events and documents: the vector log, jobs, telemetry, reports, text and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from vexil.functions import text as T
from vexil.functions import vectors as V
from vexil.operators import batching, checks, reports, store
from vexil.plans.registry import query, table
from vexil.sources import writers
from vexil.streaming import jobs

LOG_SQL = """WITH log AS (SELECT event_id + 1 AS lsn, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'update_meta' ELSE 'insert' END AS op, user_id AS id, value, props FROM events),
body AS (SELECT id, max(lsn) AS lsn, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value, arg_max(props, lsn) AS props FROM log WHERE op <> 'update_meta' GROUP BY id),
upd AS (SELECT id, max(lsn) AS lsn, arg_max(props, lsn) AS props FROM log WHERE op = 'update_meta' GROUP BY id),
state AS (SELECT b.id, CASE WHEN b.op = 'insert' THEN b.value END AS value, CASE WHEN b.op = 'insert' AND u.lsn > b.lsn THEN u.props WHEN b.op = 'insert' THEN b.props END AS metadata, b.op = 'delete' AS deleted FROM body b LEFT JOIN upd u USING (id))"""


def _log(spark, sf_dir):
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "update_meta").otherwise("insert")
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), op.alias("op"), F.col("user_id").alias("id"), F.col("value"), "props")
    insert = F.col("op") == "insert"
    return e.select("lsn", "op", "id", F.when(insert, F.array(F.col("value").cast("float"))).alias("vector"), F.when(F.col("op") != "delete", F.col("props")).alias("metadata"))


@query(LOG_SQL + " SELECT id, round(value, 4) AS value, metadata, deleted FROM state")
def log_replay(spark, sf_dir):
    return store.replay(_log(spark, sf_dir)).select("id", V.rounded(F.col("vector")[0].cast("double"), 4).alias("value"), "metadata", "deleted")


@query(LOG_SQL + " SELECT id, metadata FROM state WHERE NOT deleted")
def live_rows(spark, sf_dir):
    return store.live(store.replay(_log(spark, sf_dir))).select("id", "metadata")


@query(LOG_SQL + " SELECT 1::BIGINT AS dim, (SELECT count(*) FROM state WHERE NOT deleted) + (SELECT count(*) FROM log WHERE op = 'delete') AS total, (SELECT count(*) FROM state WHERE NOT deleted) AS live, (SELECT count(*) FROM log WHERE op = 'delete') AS tombstones")
def store_stats(spark, sf_dir):
    return store.stats(_log(spark, sf_dir))


@query("SELECT 5000::BIGINT AS checkpoint_lsn, greatest(max(event_id) + 1, 5000) AS last_lsn, count(*) FILTER (WHERE event_id + 1 > 5000) AS entries FROM events")
def wal_stats(spark, sf_dir):
    return store.wal_stats(_log(spark, sf_dir), 5000)


@query(LOG_SQL + " SELECT id, metadata FROM state WHERE id = 7 AND NOT deleted")
def get_by_id(spark, sf_dir):
    return store.get(store.replay(_log(spark, sf_dir)), 7).select("id", "metadata")


@query(LOG_SQL + ", b AS (SELECT user_id + 100 AS id FROM events WHERE event_type = 'signup') SELECT id, 'duplicate_in_batch' AS reason FROM b GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'exists' FROM b WHERE id IN (SELECT id FROM state)")
def strict_rejections(spark, sf_dir):
    batch = table(spark, sf_dir, "events").where("event_type = 'signup'").select((F.col("user_id") + 100).alias("id"))
    return store.strict_rejections(batch, store.replay(_log(spark, sf_dir)))


@query("SELECT pos, lsn, op FROM (SELECT event_id AS pos, event_id // 3 * 2 AS lsn, 'insert' AS op, max(event_id // 3 * 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE lsn <= before")
def log_violations(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.floor(F.col("event_id") / 3) * 2).alias("lsn"), F.lit("insert").alias("op"), F.col("user_id").alias("segment"))
    return store.log_violations(log)


@query("WITH m AS (SELECT user_id AS id, event_id AS seq, event_type, 0 AS side FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, event_type, 1 FROM events WHERE event_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side DESC, seq DESC) AS r FROM m) SELECT id, seq, event_type FROM r WHERE r = 1")
def base_delta_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    return store.merge_base_delta(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"))


@query("WITH r AS (SELECT user_id AS segment, event_id AS row, event_type = 'error' AS deleted FROM events), l AS (SELECT *, row - row_number() OVER (PARTITION BY segment ORDER BY row) AS island FROM r WHERE NOT deleted) SELECT segment, min(row) AS start_row, max(row) AS end_row, count(*) AS n FROM l GROUP BY segment, island")
def live_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("segment"), F.col("event_id").alias("row"), (F.col("event_type") == "error").alias("deleted"))
    return store.live_spans(rows, ["segment"])


@query("""WITH RECURSIVE m AS (SELECT user_id AS segment_id, floor(value)::BIGINT AS row, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT segment_id, i, 1 AS part, row AS a, row AS b, reason FROM m WHERE i = 1
UNION ALL SELECT m.segment_id, m.i, CASE WHEN m.reason = r.reason AND m.row BETWEEN r.a AND r.b + 1 THEN r.part ELSE r.part + 1 END, CASE WHEN m.reason = r.reason AND m.row BETWEEN r.a AND r.b + 1 THEN r.a ELSE m.row END,
  CASE WHEN m.reason = r.reason AND m.row BETWEEN r.a AND r.b + 1 THEN greatest(r.b, m.row) ELSE m.row END, m.reason FROM r JOIN m ON m.segment_id = r.segment_id AND m.i = r.i + 1)
SELECT segment_id, min(a) AS start_row, max(b) AS end_row, min(reason) AS reason FROM r GROUP BY segment_id, part""")
def dirty_ranges(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select(F.col("user_id").alias("segment_id"), F.col("event_id").alias("seq"), F.floor(F.col("value")).alias("row"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("reason"))
    return store.dirty_ranges(marks)


KIND = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'view' THEN 'running' ELSE 'message' END"


def _job_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.expr(KIND).alias("type"), "ts", "value")


@query(f"WITH j AS (SELECT user_id AS job_id, event_id, {KIND} AS type FROM events), m AS (SELECT *, coalesce(max((type IN ('done', 'error', 'canceled'))::INT) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM j) SELECT job_id, event_id, type FROM m WHERE ended = 0")
def events_until_terminal(spark, sf_dir):
    return reports.until_terminal(_job_events(spark, sf_dir)).select("job_id", "event_id", "type")


@query(f"SELECT user_id AS job_id, event_id, {KIND} AS type FROM events WHERE user_id = 7 AND event_id > 1000 ORDER BY event_id LIMIT 20")
def events_after(spark, sf_dir):
    return reports.events_after(_job_events(spark, sf_dir), 7, 1000, 20).select("job_id", "event_id", "type")


COMMAND = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'run' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'cancel' END"


@query(f"""WITH RECURSIVE c AS (SELECT user_id AS job_id, event_id AS seq, {COMMAND} AS command, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT job_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS command, NULL::VARCHAR AS before, 'none' AS status FROM (SELECT DISTINCT job_id FROM c)
UNION ALL SELECT c.job_id, c.i, c.seq, c.command, s.status, CASE WHEN s.status = 'none' AND c.command = 'create' THEN 'queued' WHEN s.status = 'queued' AND c.command = 'run' THEN 'running'
  WHEN s.status IN ('queued', 'running') AND c.command = 'cancel' THEN 'canceled' WHEN s.status IN ('queued', 'running') AND c.command IN ('done', 'error') THEN c.command ELSE s.status END FROM s JOIN c ON c.job_id = s.job_id AND c.i = s.i + 1)
SELECT job_id, seq, command, before, status, before <> status AS applied FROM s WHERE i > 0""")
def job_states(spark, sf_dir):
    commands = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(COMMAND).alias("command"))
    return jobs.replay_states(commands)


@query("SELECT event_id AS job_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS kept_id, event_id = first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS created FROM events")
def idempotent_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created"), F.concat_ws(":", "user_id", "event_type").alias("idem_key"))
    return reports.idempotent_jobs(e)


@query("SELECT event_id AS job_id, CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'communications' ELSE 'jobs' END AS queue FROM events")
def job_routing(spark, sf_dir):
    action = F.when(F.col("user_id") % 3 == 0, " Print_Communications ").otherwise("other")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "tool").otherwise("embed").alias("task"), F.to_json(F.struct(action.alias("action"))).alias("payload"))
    return jobs.routed(e).select("job_id", "queue")


@query("SELECT count(*) FILTER (WHERE event_type = 'view') AS pending, count(*) FILTER (WHERE event_type = 'click') AS lag, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS backlog, count(*) FILTER (WHERE event_type IN ('view', 'click')) >= 200 AS refuse FROM events")
def queue_backlog(spark, sf_dir):
    return reports.backlog(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "new").otherwise("acked").alias("state")))


@query("SELECT event_id AS msg_id FROM events WHERE event_type = 'view' AND epoch_ms(TIMESTAMP '2024-01-05') - epoch_ms(ts) > 60000 ORDER BY ts, event_id LIMIT 25")
def reclaimable(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), F.col("ts").alias("delivered"), F.when(F.col("event_type") == "view", "pending").otherwise("acked").alias("state"))
    return reports.reclaimable(m, F.lit("2024-01-05").cast("timestamp")).select("msg_id")


@query("SELECT event_id AS msg_id, CASE WHEN user_id % 9 = 0 THEN 'job_id' WHEN event_type = 'error' THEN 'unknown_task' WHEN user_id % 5 = 0 THEN 'payload_no_json' END AS reason FROM events WHERE user_id % 9 = 0 OR event_type = 'error' OR user_id % 5 = 0")
def message_violations(spark, sf_dir):
    u = F.col("user_id")
    m = table(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), F.when(u % 9 == 0, " ").otherwise(u.cast("string")).alias("job_id"), F.when(F.col("event_type") == "error", "nothing").otherwise("tool").alias("task"), F.when(u % 5 == 0, "{").otherwise(F.col("props")).alias("payload"))
    return checks.message_violations(m)


@query("SELECT event_id AS src_msg_id, user_id AS job_id, event_type AS task, props AS payload, 'worker-1' AS consumer, 'queue' AS src_stream, 'workers' AS src_group FROM events WHERE event_type = 'error'")
def dead_letters(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("msg_id"), "ts", F.lit("failed").alias("error"), F.lit("").alias("traceback"), F.col("user_id").alias("job_id"), F.col("event_type").alias("task"), F.col("props").alias("payload"))
    return reports.dead_letters(e, "queue", "workers", "worker-1").select("src_msg_id", "job_id", "task", "payload", "consumer", "src_stream", "src_group")


@query("SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(list_sort(list(value))[round_even((count(value) - 1) * 0.95, 0)::BIGINT + 1], 6) AS p95, round(stddev_pop(value) / median(value), 6) AS variance_ratio FROM events GROUP BY event_type")
def run_statistics(spark, sf_dir):
    r = reports.run_statistics(table(spark, sf_dir, "events"), "event_type", "value")
    return r.select("event_type", "n", *[V.rounded(c, 6).alias(c) for c in ("median", "p95", "variance_ratio")])


@query("WITH m AS (SELECT event_type, median(value) FILTER (WHERE user_id % 2 = 0) AS a, median(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY event_type) SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, round(100 * (a - b) / a, 6) AS percent FROM m")
def ab_improvement(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    r = reports.improvement(e, "event_type", "side", "value")
    return r.select("event_type", *[V.rounded(c, 6).alias(c) for c in ("a", "b", "percent")])


@query("WITH l AS (SELECT user_id, list_sort(list(value)) AS v, avg(value) AS m FROM events GROUP BY user_id) SELECT user_id, round(greatest(1, CASE WHEN len(v) < 4 THEN m ELSE v[floor(0.75 * (len(v) - 1))::BIGINT + 1] END), 6) AS estimate FROM l")
def timing_estimate(spark, sf_dir):
    return reports.timing_estimate(table(spark, sf_dir, "events"), "user_id", "value", 60).withColumn("estimate", V.rounded("estimate", 6))


@query("SELECT event_type, round(sum(value), 3) AS seconds, round(100 * sum(value) / sum(sum(value)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def latency_report(spark, sf_dir):
    r = reports.latency_report(table(spark, sf_dir, "events"), "event_type", "value")
    return r.select("event_type", V.rounded("seconds", 3).alias("seconds"), V.rounded("percent", 6).alias("percent"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS elapsed FROM (SELECT event_id, user_id, greatest(value - 5, 0) AS value FROM events)")
def elapsed_clamped(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.col("value") - 5)
    return reports.elapsed_clamped(e, "user_id", "event_id", "value").select("event_id", "elapsed")


@query("SELECT event_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS elapsed_s FROM events")
def since_first(spark, sf_dir):
    return reports.since_first(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "elapsed_s")


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, coalesce(max(n) >= 6 AND avg(value) FILTER (WHERE i >= n - n // 3) > 1.15 * avg(value) FILTER (WHERE i < n // 3), FALSE) AS throttled FROM p GROUP BY user_id")
def throttling(spark, sf_dir):
    return reports.throttling(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, len(v) >= 5 AND v[-5] < v[-4] AND v[-4] < v[-3] AND v[-3] < v[-2] AND v[-2] < v[-1] AND v[-1] - v[-5] > 0.1 * list_max(v) AS leak FROM l")
def memory_leaks(spark, sf_dir):
    return reports.leaks(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("WITH t AS (SELECT user_id % 20 AS batch, sum(event_id % 7 + 1) / sum(value) AS s FROM events GROUP BY 1) SELECT min(batch) AS batch FROM t WHERE s >= 0.95 * (SELECT max(s) FROM t)")
def recommended_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("batch"), (F.col("event_id") % 7 + 1).alias("n"), F.col("value").alias("seconds"), F.col("value").alias("mb"))
    return reports.recommended(reports.throughput(e))


@query("SELECT (SELECT max(user_id) FROM events) AS largest, (SELECT user_id FROM events ORDER BY value, event_id LIMIT 1) AS fastest, (SELECT max(user_id) FROM events WHERE value <= 1.05 * (SELECT min(value) FROM events)) AS near")
def probe_winners(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("batch"), F.col("value").alias("latency"))
    a, b, c = (reports.probe_winner(e, s).withColumnRenamed("batch", n) for s, n in (("max_successful", "largest"), ("min_latency", "fastest"), ("epsilon", "near")))
    return a.crossJoin(b).crossJoin(c)


@query("WITH c AS (SELECT user_id AS stage_id, sum(value) FILTER (WHERE event_id % 2 = 1) AS now, sum(value) FILTER (WHERE event_id % 2 = 0) AS old FROM events GROUP BY user_id) SELECT stage_id, round(now, 4) AS elapsed_ms, round(old, 4) AS previous_ms, round(now - old, 4) AS delta_ms FROM c WHERE now IS NOT NULL")
def against_previous(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda r: e.where(F.col("event_id") % 2 == r).groupBy(F.col("user_id").alias("stage_id")).agg(F.sum("value").alias("elapsed_ms"))
    r = reports.against_previous(side(1), side(0))
    return r.select("stage_id", *[V.rounded(c, 4).alias(c) for c in ("elapsed_ms", "previous_ms", "delta_ms")])


STAGE = "CASE event_type WHEN 'signup' THEN 'stage_start' WHEN 'purchase' THEN 'stage_end' WHEN 'error' THEN 'stage_fail' ELSE 'other' END"


@query(f"WITH e AS (SELECT user_id AS run, event_id // 100 AS stage_id, event_id AS seq, {STAGE} AS t FROM events), c AS (SELECT run, stage_id, count(*) FILTER (WHERE t = 'stage_start') AS s, count(*) FILTER (WHERE t IN ('stage_end', 'stage_fail')) AS e, min(seq) FILTER (WHERE t = 'stage_start') AS a, max(seq) FILTER (WHERE t IN ('stage_end', 'stage_fail')) AS b FROM e GROUP BY run, stage_id) SELECT run, stage_id, CASE WHEN s <> 1 THEN 'starts' WHEN e <> 1 THEN 'ends' ELSE 'order' END AS reason FROM c WHERE s <> 1 OR e <> 1 OR b < a")
def telemetry_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 100).alias("stage_id"), F.col("event_id").alias("seq"), F.expr(STAGE).alias("event_type"))
    return reports.telemetry_violations(e)


@query("SELECT doc_id AS key, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def key_differences(spark, sf_dir):
    return checks.key_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("doc_id", "key")


@query("SELECT a.event_id, a.user_id AS left_user, b.u AS right_user FROM events a JOIN (SELECT event_id, CASE WHEN event_id % 97 = 5 THEN user_id + 1 ELSE user_id END AS u FROM events) b USING (event_id) WHERE a.user_id <> b.u ORDER BY event_id LIMIT 1")
def first_difference(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_id", "user_id")
    b = a.withColumn("user_id", F.when(F.col("event_id") % 97 == 5, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return checks.first_difference(a, b, "event_id", "user_id").withColumnsRenamed({"left": "left_user", "right": "right_user"})


PARA_SQL = """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(160))), lambda x: x <> '') AS ps FROM documents)"""


@query(PARA_SQL + " SELECT doc_id, generate_subscripts(ps, 1)::INTEGER - 1 AS para, length(unnest(ps))::INTEGER AS char_len FROM p")
def paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs("text")).alias("para", "p")).select("doc_id", "para", F.length("p").alias("char_len"))


@query()
def sentences(spark, sf_dir):
    """Sentence rows with packed ids."""
    rows = T.sentence_rows(table(spark, sf_dir, "documents")).withColumn("shard_doc_num", (F.col("doc_id") % 65536).cast("int"))
    return rows.select("doc_id", "doc_para_num", "para_line", "char_len", "text", T.pack_id().cast("string").alias("packed"))


ID_SQL = "SELECT doc_id, doc_id % 1000 AS para_line, least(65535, n_chars) AS char_len, doc_id % 200000 AS doc_para_num, doc_id % 16384 AS shard_num, doc_id % 65536 AS shard_doc_num FROM documents"


def _ids(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d, (d % 1000).alias("para_line"), T.clamp_length(F.col("n_chars")).alias("char_len"), (d % 200000).alias("doc_para_num"), (d % 16384).alias("shard_num"), (d % 65536).alias("shard_doc_num"))


@query(f"WITH i AS ({ID_SQL}) SELECT doc_id, (shard_doc_num::HUGEINT * 18446744073709551616 + shard_num::HUGEINT * 1125899906842624 + doc_para_num::HUGEINT * 4294967296 + char_len * 65536 + para_line)::VARCHAR AS packed FROM i")
def pack_ids(spark, sf_dir):
    return _ids(spark, sf_dir).select("doc_id", T.pack_id().cast("string").alias("packed"))


@query(ID_SQL)
def unpack_ids(spark, sf_dir):
    return _ids(spark, sf_dir).select("doc_id", T.pack_id().alias("p")).select("doc_id", *T.unpack_id(F.col("p")))


BAND = "CASE WHEN n_chars < 16 THEN '[0,16)' " + " ".join(f"WHEN n_chars < {b} THEN '[{a},{b})'" for a, b in zip(T.EDGES, T.EDGES[1:])) + " ELSE '[1024,inf)' END"


@query(f"SELECT doc_id, {' + '.join(f'(n_chars >= {e})::INT' for e in T.EDGES)} AS bucket, {BAND} AS label FROM documents")
def length_bands(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.bucket("n_chars").alias("bucket"), T.band_label("n_chars").alias("label"))


S_SQL = PARA_SQL + ", s AS (SELECT doc_id, generate_subscripts(ps, 1)::INTEGER AS i, least(65535, length(unnest(ps)))::INTEGER AS len FROM p)"


def _pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs("text")).alias("i", "p"))
    return rows.select("doc_id", (F.col("i") + 1).alias("i"), T.clamp_length(F.length("p")).alias("char_len"))


@query(S_SQL.replace("WITH p", "WITH RECURSIVE p") + """, r AS (SELECT doc_id, i, len, 0 AS batch, 1 AS n, len AS longest FROM s WHERE i = 1
UNION ALL SELECT s.doc_id, s.i, s.len, CASE WHEN r.n = 16 OR greatest(r.longest, s.len)::BIGINT * (r.n + 1) > 2048 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n = 16 OR greatest(r.longest, s.len)::BIGINT * (r.n + 1) > 2048 THEN 1 ELSE r.n + 1 END,
  CASE WHEN r.n = 16 OR greatest(r.longest, s.len)::BIGINT * (r.n + 1) > 2048 THEN s.len ELSE greatest(r.longest, s.len) END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
SELECT doc_id, i, len AS char_len, batch FROM r""")
def greedy_batches(spark, sf_dir):
    return batching.greedy_batches(_pieces(spark, sf_dir), "doc_id", ["i"], 16, 2048)


@query(S_SQL.replace("WITH p", "WITH RECURSIVE p") + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len, i) AS j FROM s), r AS (SELECT doc_id, i, j, len, 0 AS batch, 1 AS n FROM o WHERE j = 1
UNION ALL SELECT o.doc_id, o.i, o.j, o.len, CASE WHEN r.n = 16 OR o.len::BIGINT * (r.n + 1) > 2048 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n = 16 OR o.len::BIGINT * (r.n + 1) > 2048 THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.doc_id = r.doc_id AND o.j = r.j + 1)
SELECT doc_id, i, len AS char_len, batch FROM r""")
def dynamic_batches(spark, sf_dir):
    return batching.dynamic_batches(_pieces(spark, sf_dir), "doc_id", ["i"], 16, 2048)


@query()
def natural_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.least("n_chars", F.lit(65535)).alias("char_len")).where("lang IS NOT NULL AND char_len IS NOT NULL")
    return batching.bands(docs, "lang")


@query(f"WITH b AS (SELECT lang, {BAND} AS band, n_chars::DOUBLE AS x FROM documents), g AS (SELECT lang, band, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM b GROUP BY lang, band) SELECT lang, round(1 - (sum(q) - sum(s * s / n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS fit FROM g GROUP BY lang")
def variance_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("char_len"), T.band_label("n_chars").alias("band"))
    return batching.fit_of_bands(docs, "lang", "band").withColumn("fit", V.rounded("fit", 6))


@query("WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents), w AS (SELECT DISTINCT lang, c * n // 20 AS pos FROM p, range(20) t(c)) SELECT doc_id, p.lang FROM p JOIN w ON p.lang = w.lang AND p.pos = w.pos")
def sampled_positions(spark, sf_dir):
    return batching.sampled_positions(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 20).select("doc_id", "lang")


@query("SELECT event_id, starts_with(trim(props), '{') AND ends_with(trim(props), '}') AS json, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.looks_like_json("props").alias("json"), F.get_json_object("props", "$.k").alias("k"))


@query("""WITH d AS (SELECT sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS d FROM labels), p AS (SELECT substr(d, 1, 3) AS p, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM d GROUP BY 1)
SELECT sum(n)::BIGINT AS rows, sha256(string_agg(d, '' ORDER BY p)) AS digest FROM p""")
def table_digest(spark, sf_dir):
    return writers.digest(table(spark, sf_dir, "labels"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM (SELECT event_id, floor(value * 100)::BIGINT AS s FROM events)")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.duration(F.col("value") * 100).alias("took"))
