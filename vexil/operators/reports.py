"""Reports on runs: percentiles, comparisons, timing, telemetry and its rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TERMINAL = ("done", "error", "canceled")


def at_rounded_place(values: Column, p: float) -> Column:
    """Of a sorted array, the value at place (n - 1) p, halves to even."""
    return F.element_at(values, (F.bround((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def run_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, median, p95, variance_ratio): variance_ratio is the population deviation over the median, 0 for a median of 0."""
    # values and how often they occur, so that a group holds each distinct value once; the value at a place is the first whose running count passes it
    good = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(group).orderBy("__x"))
    placed = good.withColumn("__u", upto).withColumn("n", F.sum("__c").over(Window.partitionBy(group)))
    found = placed.groupBy(group).agg(F.max("n").alias("n"), F.expr("percentile(__x, 0.5, __c)").alias("median"), F.min(F.when(F.col("__u") > F.bround((F.col("n") - 1) * F.lit(0.95)), F.col("__x"))).alias("p95"), (F.sum("__c") * 1.0).alias("__w"), F.sum(F.col("__x") * F.col("__c")).alias("__t"))
    spread = placed.join(found.select(group, (F.col("__t") / F.col("__w")).alias("__m")), group).groupBy(group).agg(F.sqrt(F.sum(F.col("__c") * (F.col("__x") - F.col("__m")) ** 2) / F.sum("__c")).alias("__s"))
    return found.join(spread, group).select(group, "n", "median", "p95", F.when(F.col("median") != 0, F.col("__s") / F.col("median")).otherwise(0.0).alias("variance_ratio"))


def regressions(current: DataFrame, baseline: DataFrame, group: str, median: float = 0.10, p95: float = 0.15, ratio: float = 0.35) -> DataFrame:
    """(group, reason) where current passes the headroom over baseline."""
    b = baseline.select(group, F.col("median").alias("__m"), F.col("p95").alias("__p"))
    reason = F.when(F.col("median") > F.col("__m") * (1 + median), "median").when(F.col("p95") > F.col("__p") * (1 + p95), "p95").when(F.col("variance_ratio") > ratio, "variance")
    return current.join(b, group).select(group, reason.alias("reason")).where("reason IS NOT NULL")


def improvement(rows: DataFrame, group: str, side: str, value: str) -> DataFrame:
    """(group, a, b, percent): medians of sides a and b, and by how much b is below a."""
    found = rows.groupBy(group).agg(*[F.expr(f"percentile(CASE WHEN {side} = '{s}' THEN {value} END, 0.5)").alias(s) for s in ("a", "b")])
    return found.withColumn("percent", F.when(F.col("a") > 0, 100 * (F.col("a") - F.col("b")) / F.col("a")))


def timing_estimate(rows: DataFrame, group: str, value: str, default: float, last: int | None = None, order: str | None = None) -> DataFrame:
    """(group, estimate): the mean of fewer than 4 samples, else the value at place floor(0.75 (n - 1)); 1 at least; the default without samples. With last, only that many latest in order count."""
    rows = rows.select(group, value, *([order] if order else []))
    if last is not None:
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("__r") <= last)
    found = rows.groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("v"), F.avg(value).alias("mean"))
    n = F.size("v")
    at = F.element_at("v", (F.floor(0.75 * (n - 1)) + 1).cast("int"))
    return found.select(group, F.when(n == 0, F.lit(float(default))).otherwise(F.greatest(F.lit(1.0), F.when(n < 4, F.col("mean")).otherwise(at))).alias("estimate"))


def estimate_errors(estimates: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """(group, estimate, actual, delta, percent)."""
    delta = F.col("actual") - F.col("estimate")
    return estimates.join(actual, group).select(group, "estimate", "actual", delta.alias("delta"), F.when(F.col("estimate") != 0, 100 * delta / F.col("estimate")).alias("percent"))


def throughput(rows: DataFrame) -> DataFrame:
    """(batch, sentences_per_s, mean_latency_s, peak_mb) of rows(batch, n, seconds, mb)."""
    return rows.groupBy("batch").agg((F.sum("n") / F.sum("seconds")).alias("sentences_per_s"), F.avg("seconds").alias("mean_latency_s"), F.max("mb").alias("peak_mb"))


def pipeline_counters(files: DataFrame, sentences: DataFrame, batches: DataFrame) -> DataFrame:
    """One row of a text ingest: files(path, text) discovered, read and skipped (text is null), sentences, batches and records, of sentences(path) and batches(n)."""
    f = files.agg(F.count(F.lit(1)).alias("discovered"), F.count("text").alias("read"), F.count_if(F.col("text").isNull()).alias("skipped"))
    s = sentences.agg(F.count(F.lit(1)).alias("sentences"))
    b = batches.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
    return f.join(s).join(b)  # a row each


def rows_by_key(rows: DataFrame, key: str) -> DataFrame:
    """(key, n)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def distinct_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.countDistinct(key).alias("n"))


def last_samples(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The n latest rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def recommended(speeds: DataFrame, within: float = 0.05) -> DataFrame:
    """(batch): the smallest whose throughput is within a share of the best."""
    best = F.max("sentences_per_s").over(Window.partitionBy())
    return speeds.withColumn("__b", best).where(F.col("sentences_per_s") >= (1 - within) * F.col("__b")).agg(F.min("batch").alias("batch"))


def probe_winner(rows: DataFrame, strategy: str, epsilon: float = 0.05) -> DataFrame:
    """(batch) of rows(seq, batch, latency): max_successful, min_latency (the first of equals) or epsilon (the largest within 1 + epsilon of the best)."""
    if strategy == "max_successful":
        return rows.agg(F.max("batch").alias("batch"))
    if strategy == "min_latency":
        return rows.agg(F.min_by("batch", F.struct("latency", "seq")).alias("batch"))
    if strategy == "epsilon":
        best = F.min("latency").over(Window.partitionBy())
        return rows.withColumn("__b", best).where(F.col("latency") <= (1 + epsilon) * F.col("__b")).agg(F.max("batch").alias("batch"))
    raise ValueError(f"no such strategy: {strategy}")


def throttling(rows: DataFrame, group: str, order: str, value: str, least: int = 6, ratio: float = 1.15) -> DataFrame:
    """(group, throttled): the mean of the last third is above ratio times that of the first, for least rows at least."""
    w = Window.partitionBy(group)
    placed = rows.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__t", F.floor(F.col("__n") / 3))
    first, last = (F.avg(F.when(c, F.col(value))) for c in (F.col("__i") < F.col("__t"), F.col("__i") >= F.col("__n") - F.col("__t")))
    return placed.groupBy(group).agg(F.coalesce((F.max("__n") >= least) & (last > ratio * first), F.lit(False)).alias("throttled"))


def leaks(rows: DataFrame, group: str, order: str, value: str, share: float = 0.1) -> DataFrame:
    """(group, leak): the last five values rise strictly, by more than a share of the peak."""
    latest = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("v"), F.max(value).alias("peak"))
    five = latest.where("size(v) >= 5").select(group, "peak", F.transform(F.slice("v", -5, 5), lambda x: x[value]).alias("v"))
    rising = F.forall(F.sequence(F.lit(1), F.lit(4)), lambda i: F.element_at("v", i + 1) > F.element_at("v", i))
    five = five.select(group, (rising & (F.element_at("v", 5) - F.element_at("v", 1) > share * F.col("peak"))).alias("leak"))
    return latest.select(group).join(five, group, "left").select(group, F.coalesce("leak", F.lit(False)).alias("leak"))


def latency_report(rows: DataFrame, label: str, seconds: str, total: float | None = None) -> DataFrame:
    """(label, seconds, percent) of the whole; a whole of 0 or less counts as 1."""
    sums = rows.groupBy(label).agg(F.sum(seconds).alias("seconds"))
    whole = F.lit(float(total)) if total is not None else F.sum("seconds").over(Window.partitionBy())
    return sums.select(label, "seconds", (100 * F.col("seconds") / F.when(whole > 0, whole).otherwise(1.0)).alias("percent"))


def elapsed_clamped(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """rows with elapsed: the running maximum of the value; what is negative or not finite counts 0."""
    v = F.when(F.isnan(value) | F.col(value).isNull() | (F.col(value) < 0) | (F.abs(value) == float("inf")), 0.0).otherwise(F.col(value))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("elapsed", F.max(v).over(w))


def until_terminal(events: DataFrame, group: str = "job_id", order: str = "event_id", kind: str = "type") -> DataFrame:
    """Events of each job up to its first terminal one."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.col(kind).isin(*TERMINAL).cast("int")).over(w)
    return events.withColumn("__e", F.coalesce(ended, F.lit(0))).where("__e = 0").drop("__e")


def events_after(events: DataFrame, job_id, last_id: int, count: int) -> DataFrame:
    """The next events of a job behind last_id, count at most."""
    return events.where((F.col("job_id") == job_id) & (F.col("event_id") > last_id)).orderBy("event_id").limit(count)


def gains(trace: DataFrame) -> DataFrame:
    """(k, gain) of trace(k, objective): (J(k) - J(k+1)) / J(k), 0 where J(k) <= 0 or k + 1 is lacking."""
    w = Window.orderBy("k")
    nxt = F.when(F.lead("k").over(w) == F.col("k") + 1, F.lead("objective").over(w))
    return trace.select("k", F.when((F.col("objective") <= 0) | nxt.isNull(), 0.0).otherwise((F.col("objective") - nxt) / F.col("objective")).alias("gain"))


def bends(trace: DataFrame) -> DataFrame:
    """(k, bend): J(k-1) - 2 J(k) + J(k+1), minus infinity at the ends."""
    w = Window.orderBy("k")
    b = F.lag("objective").over(w) - 2 * F.col("objective") + F.lead("objective").over(w)
    return trace.select("k", F.coalesce(b, F.lit(float("-inf"))).alias("bend"))


def since_first(rows: DataFrame, group: str, ts: str) -> DataFrame:
    """rows with elapsed_s since the first time of the group."""
    first = F.min(ts).over(Window.partitionBy(group))
    return rows.withColumn("elapsed_s", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6)


def against_previous(current: DataFrame, previous: DataFrame, key: str = "stage_id") -> DataFrame:
    """(key, elapsed_ms, previous_ms, delta_ms); null without a finite previous value of 0 or more."""
    good = previous.where("elapsed_ms >= 0 AND NOT isnan(elapsed_ms) AND abs(elapsed_ms) < double('infinity')").select(key, F.col("elapsed_ms").alias("previous_ms"))
    return current.join(good, key, "left").select(key, "elapsed_ms", "previous_ms", (F.col("elapsed_ms") - F.col("previous_ms")).alias("delta_ms"))


def telemetry_violations(events: DataFrame) -> DataFrame:
    """(run, stage_id, reason): a stage without exactly one start, without exactly one end (completed, failed or skipped), or with its end before its start."""
    start, end = F.col("event_type") == "stage_start", F.col("event_type").isin("stage_end", "stage_fail", "stage_skip")
    per = events.groupBy("run", "stage_id").agg(F.count_if(start).alias("s"), F.count_if(end).alias("e"), F.min(F.when(start, F.col("seq"))).alias("a"), F.max(F.when(end, F.col("seq"))).alias("b"))
    reason = F.when(F.col("s") != 1, "starts").when(F.col("e") != 1, "ends").when(F.col("b") < F.col("a"), "order")
    return per.select("run", "stage_id", reason.alias("reason")).where("reason IS NOT NULL")


def telemetry_json(events: DataFrame) -> DataFrame:
    """(line): one JSON line an event."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("line"))


def run_summary(events: DataFrame) -> DataFrame:
    """(inserted, clusters, latency_ms) with 0 for what is lacking."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return events.agg(z(F.sum("inserted")).alias("inserted"), z(F.max("clusters")).alias("clusters"), F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)).alias("latency_ms"))


def backlog(messages: DataFrame, limit: int = 200) -> DataFrame:
    """(pending, lag, backlog, refuse) of messages(state): refuse where the backlog reaches the limit; a limit of 0 never does."""
    found = messages.agg(F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "new").alias("lag"))
    return found.withColumn("backlog", F.col("pending") + F.col("lag")).withColumn("refuse", (F.lit(limit) > 0) & (F.col("backlog") >= limit))


def reclaimable(messages: DataFrame, now: Column, idle_s: int = 60, count: int = 25) -> DataFrame:
    """The messages delivered but not acknowledged that have been idle longest, count a pass."""
    idle = F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("delivered").cast("timestamp"))
    return messages.where((F.col("state") == "pending") & (idle > idle_s * 1000)).orderBy("delivered", "msg_id").limit(count)


def idempotent_jobs(jobs: DataFrame) -> DataFrame:
    """(job_id, kept_id, created): jobs of one idempotency key are the first of them; a null key makes none alike."""
    first = F.min_by("job_id", F.struct("created", "job_id")).over(Window.partitionBy("idem_key"))
    kept = F.when(F.col("idem_key").isNull(), F.col("job_id")).otherwise(first)
    return jobs.select("job_id", kept.alias("kept_id"), (kept == F.col("job_id")).alias("created"))


def route(task: Column, payload: Column) -> Column:
    """The queue of a job."""
    action = F.lower(F.trim(F.coalesce(F.get_json_object(payload, "$.action"), F.lit(""))))
    return F.when((task == "tool") & action.isin("sync_communications", "sync_communications_from_file", "print_communications"), "communications").otherwise("jobs")


def dead_letters(failed: DataFrame, source: str, group: str, consumer: str) -> DataFrame:
    """The record of each message that failed: where it came from, why, and its content."""
    return failed.select(F.lit(source).alias("src_stream"), F.lit(group).alias("src_group"), F.col("msg_id").alias("src_msg_id"), F.lit(consumer).alias("consumer"), "ts", "error", "traceback", "job_id", "task", "payload", F.to_json(F.struct("job_id", "task", "payload")).alias("raw"))


MONITOR = {
    "ram_used_mb": r"RAM (\d+)/\d+MB",
    "ram_total_mb": r"RAM \d+/(\d+)MB",
    "swap_used_mb": r"SWAP (\d+)/\d+MB",
    "swap_total_mb": r"SWAP \d+/(\d+)MB",
    "emc_percent": r"EMC_FREQ (\d+)%",
    "gpu_percent": r"GR3D_FREQ (\d+)%",
    "power_mw": r"VDD_\w*IN\w* (\d+)mW",
}


def monitor_values(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with the numbers of a board monitor's line, the CPU loads as an array, and temperatures as a map; null where absent."""
    number = lambda p: F.regexp_extract(column, p, 1).try_cast("double")
    cpu = F.transform(F.split(F.regexp_extract(column, r"CPU \[([^\]]*)\]", 1), ","), lambda x: F.regexp_extract(x, r"(\d+)%", 1).try_cast("double"))
    heat = F.regexp_extract_all(column, F.lit(r"(\w+)@(-?[\d.]+)C"), 0)
    # FREQ may carry a list of clocks after the percentage: 45%@[1300,1300]
    return lines.select("*", *[number(p).alias(n) for n, p in MONITOR.items()], cpu.alias("cpu_percent"), F.map_from_entries(F.transform(heat, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)@", 1).alias("k"), F.regexp_extract(x, r"@(-?[\d.]+)C", 1).cast("double").alias("v")))).alias("celsius"))
