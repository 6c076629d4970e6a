"""Jobs as streams of events: creation with idempotency keys, a state machine per job, routing, reclaim, dead letters, replayable tables.

Commands lie in (job_id, seq, ts, command, data): create, run, done, error, cancel. A job's state is created by the first
create; run only starts a queued job; a job that has ended takes nothing more, save that cancel wins over a later end.
What has no effect is skipped with the state it met. State leaves ttl_s after its last change, in event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from vexil.operators.order import with_last_before
from vexil.operators.reports import route

NEXT = {("none", "create"): "queued", ("queued", "run"): "running", ("queued", "cancel"): "canceled", ("running", "cancel"): "canceled", ("queued", "done"): "done", ("queued", "error"): "error", ("running", "done"): "done", ("running", "error"): "error"}
STATES = "job_id long, seq long, command string, before string, status string, applied boolean"


def transition(status: str, command: str) -> tuple[str, bool]:
    """The status after a command, and whether it had an effect."""
    new = NEXT.get((status, command))
    return (new, True) if new else (status, False)


def job_states(commands: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """STATES of a stream of commands(job_id, seq, ts, command); within a batch, commands of a job are taken in order of seq."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("seq")
        status, out = state.get[0] if state.exists else "none", []
        for r in rows.itertuples():
            new, applied = transition(status, r.command)
            out.append((key[0], r.seq, r.command, status, new, applied))
            status = new
        if status != "none":
            state.update((status,))
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_s * 1000)
        yield pd.DataFrame(out, columns=["job_id", "seq", "command", "before", "status", "applied"])

    marked = commands.withWatermark("ts", f"{ttl_s} seconds")
    return marked.groupBy("job_id").applyInPandasWithState(step, STATES, "status string", "append", GroupStateTimeout.EventTimeTimeout)


def replay_states(commands: DataFrame) -> DataFrame:
    """The same of a finished table, on the JVM: a fold over each job's commands in order."""
    cases = " ".join(f"WHEN acc.status = '{a}' AND x.command = '{c}' THEN '{b}'" for (a, c), b in NEXT.items())
    fold = F.expr(f"""aggregate(c, struct('none' AS status, cast(array() AS array<struct<before: string, status: string>>) AS h),
        (acc, x) -> named_struct('status', CASE {cases} ELSE acc.status END, 'h', concat(acc.h, array(named_struct('before', acc.status, 'status', CASE {cases} ELSE acc.status END)))))""").getField("h")
    lists = commands.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("seq", "command"))).alias("c"))
    rows = lists.select("job_id", F.explode(F.arrays_zip("c", fold.alias("h"))).alias("z"))
    return rows.select("job_id", F.col("z.c.seq").alias("seq"), F.col("z.c.command").alias("command"), F.col("z.h.before").alias("before"), F.col("z.h.status").alias("status"), (F.col("z.h.before") != F.col("z.h.status")).alias("applied"))


def new_jobs(requests: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """A stream of requests(job_id, ts, idem_key, ...), the first of each key within ttl; requests without a key are their own."""
    keyed = requests.withColumn("__k", F.coalesce("idem_key", F.concat(F.lit("job:"), F.col("job_id").cast("string"))))
    return keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["__k"]).drop("__k")


def created(requests: DataFrame, known: DataFrame | None = None, ttl_s: int = 3600) -> dict[str, DataFrame]:
    """What creating jobs amounts to, all from one decision: requests(job_id, task, payload, idem_key, created) by whether their key is new.

    answers (job_id, existing) names for each request the job that stands for it; jobs has the hash row of each new job,
    events its queued event, queue its message, keys the idempotency keys with the time until which they hold. known has
    keys of earlier batches (idem_key, job_id, until); a key that has lapsed by a request's time binds no more. A null key
    makes no requests alike.
    """
    rows = requests.select("job_id", "task", "payload", "idem_key", "created")
    if known is not None:
        held = known.select(F.col("idem_key").alias("__k"), F.col("job_id").alias("__job"), F.col("until").alias("__until"))
        rows = rows.join(held, (F.col("idem_key") == F.col("__k")) & (F.col("created") < F.col("__until")), "left").drop("__k", "__until")
    else:
        rows = rows.withColumn("__job", F.lit(None).cast(requests.schema["job_id"].dataType))
    first = rows.where("idem_key IS NOT NULL AND __job IS NULL").groupBy("idem_key").agg(F.min_by("job_id", F.struct("created", "job_id")).alias("__first"))
    rows = rows.join(first, "idem_key", "left").withColumn("kept", F.coalesce("__job", "__first", "job_id"))
    new = rows.where(F.col("kept") == F.col("job_id"))
    none = F.lit("")
    ms = F.unix_millis(F.col("created").cast("timestamp"))
    return {
        "answers": rows.select("job_id", F.col("kept").alias("existing"), (F.col("kept") != F.col("job_id")).alias("deduplicated")),
        "jobs": new.select("job_id", "task", "payload", F.lit("queued").alias("status"), ms.alias("created_ts"), ms.alias("updated_ts"), F.lit(ttl_s).alias("ttl_s"), none.alias("result"), none.alias("error")),
        "events": new.select("job_id", F.lit("queued").alias("type"), ms.alias("ts"), F.lit("gateway.queued").alias("step"), F.to_json(F.struct("task")).alias("data")),
        "queue": new.select("job_id", "task", "payload", route(F.col("task"), F.col("payload")).alias("queue")),
        "keys": new.where("idem_key IS NOT NULL").select("idem_key", "job_id", (F.col("created") + F.make_interval(secs=F.lit(ttl_s))).alias("until")),
    }


def with_heartbeats(events: DataFrame, every_s: int = 15) -> DataFrame:
    """The events of a job's tail (job_id, event_id, ts, type) with a heartbeat for each every_s seconds that pass without one, up to the job's last event. Heartbeats have no event_id."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    beats = F.floor((F.col("__gap") - 1e-6) / every_s).cast("int")
    idle = events.withColumn("__gap", gap).withColumn("__before", F.lag("ts").over(w)).where(beats >= 1)
    filled = idle.select("job_id", F.lit(None).cast("long").alias("event_id"), F.explode(F.sequence(F.lit(1), beats)).alias("__i"), "__before")
    at = F.timestamp_micros(F.unix_micros(F.col("__before").cast("timestamp")) + F.col("__i").cast("long") * every_s * 1_000_000)
    own = events.select("job_id", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "type")
    return own.unionByName(filled.select("job_id", "event_id", at.alias("ts"), F.lit("heartbeat").alias("type")))


def communications(commands: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(job_id, status, text, chars, error) of commands(job_id, seq, payload) of the communications worker. sync_communications stores payload.text, sync_communications_from_file the text of a file, print_communications answers with what was stored last before it. files has (path, text) with paths relative to the root; a path that leaves it fails."""
    action = F.lower(F.trim(F.coalesce(F.get_json_object("payload", "$.action"), F.lit(""))))
    wanted = F.trim(F.coalesce(F.get_json_object("payload", "$.file_path"), F.lit("")))
    rows = commands.select("job_id", "seq", action.alias("action"), F.get_json_object("payload", "$.text").alias("given"), F.when(wanted == "", "communications.txt").otherwise(wanted).alias("path"))
    rows = rows.withColumn("path", F.regexp_replace("path", r"^(?:\./)+", ""))
    if files is not None:
        rows = rows.join(files.select("path", F.col("text").alias("found")), "path", "left")
    else:
        rows = rows.withColumn("found", F.lit(None).cast("string"))
    outside = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    text = F.when(F.col("action") == "sync_communications", F.col("given")).when((F.col("action") == "sync_communications_from_file") & ~outside, F.col("found"))
    held = with_last_before(rows.withColumn("text", text), "text", "held", "seq")
    printing = F.col("action") == "print_communications"
    shown = F.when(printing, F.col("held")).otherwise(F.col("text"))
    error = F.when(F.col("action") == "sync_communications", F.when(F.col("given").isNull(), "sync_communications requires payload.text (string)"))
    error = F.when(F.col("action") == "sync_communications_from_file", F.when(outside, "file_path must resolve within project root").when(F.col("found").isNull(), "communications source file not found")).otherwise(error)
    error = F.when(printing, F.when(F.col("held").isNull(), "no communications text is stored yet")).otherwise(error)
    known = F.col("action").isin("sync_communications", "sync_communications_from_file", "print_communications")
    error = F.when(known, error).otherwise(F.concat(F.lit("unsupported communications action: "), F.when(F.col("action") == "", "<empty>").otherwise(F.col("action"))))
    done = held.withColumn("error", error).withColumn("shown", shown)
    ok = F.col("error").isNull()
    return done.select("job_id", F.when(ok, "done").otherwise("error").alias("status"), F.when(ok & printing, F.col("shown")).alias("text"), F.when(ok, F.length("shown")).alias("chars"), "error")


def routed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("queue", route(F.col("task"), F.col("payload")))


def upsert_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Keeps the last row by order of each key of a stream in a published table. A batch that comes again is not applied again. Every batch rewrites the table, so it is for tables of keys (jobs, offsets), not of events; the version before the last is deleted."""
    from vexil.sources import writers
    from vexil.storage import drop_table

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = writers.read_small(spark, f"{path}/batch.current")
        if done is not None and int(done) >= number:
            return
        old = writers.published(spark, path, "table")
        rows = batch if old is None else old.unionByName(batch)
        rest = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(rows.columns)
        before = writers.read_small(spark, f"{path}/table.current")
        writers.publish(last, path, "table")
        writers.write_text(spark, f"{path}/batch.current", str(number))
        if before and (stale := writers.read_small(spark, f"{path}/stale.current")):
            drop_table(spark, stale)  # the version before the last: no reader began with it since two batches
        if before:
            writers.write_text(spark, f"{path}/stale.current", before)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """Events as files arrive in a folder; files bounds how many a batch takes."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def echo(jobs: DataFrame) -> DataFrame:
    """(job_id, status, result): what the worker answers; a job without a task fails."""
    ok = F.coalesce(F.trim("task") != "", F.lit(False))
    return jobs.select("job_id", F.when(ok, "done").otherwise("error").alias("status"), F.when(ok, F.concat(F.lit("echo(task="), F.col("task"), F.lit(")"))).alias("result"))


def with_failures(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """Jobs whose answer is an error, for dead_letters."""
    return jobs.join(answers.where("status = 'error'").select("job_id"), "job_id", "left_semi")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An addition: counts and sums by event type in windows of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
