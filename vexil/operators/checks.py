"""Validators: each gives the rows, or counts, that violate a rule; none means valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators.order import with_previous

TASKS = ("tool", "embed", "cluster", "search")
PAYLOAD_MOST = 200_000


def embedding_violations(rows: DataFrame, dim: int, low: float = 0.999, high: float = 1.001) -> DataFrame:
    """(id, reason) of rows(id, vector): another dimension, an element that is not finite, or a norm outside low .. high."""
    finite = F.coalesce(V.all_finite("vector"), F.lit(False))
    reason = F.when(~V.has_dimension("vector", dim), "dimension").when(~finite, "not_finite").when(~V.within_norm("vector", low, high), "norm")
    return rows.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def renormalised(rows: DataFrame, low: float = 0.95, high: float = 1.05) -> DataFrame:
    """(id, vector, norm_ok): vectors of length 1, whose length is checked again after the cast to float."""
    unit = rows.select("id", F.transform(V.normalise("vector"), lambda x: x.cast("float")).alias("vector"))
    return unit.withColumn("norm_ok", V.within_norm("vector", low, high))


def order_violations(rows: DataFrame, by: str = "pos") -> DataFrame:
    """Rows whose id is not above the one before them in order of by."""
    return with_previous(rows.select(by, "id"), F.col("id"), "before", by).where("before IS NOT NULL AND id <= before").select(by, "id", "before")


def vector_report(rows: DataFrame, low: float = 0.95, high: float = 1.05) -> DataFrame:
    """One row on rows(id, vector): n, distinct ids, rows not finite, norms out of range, least, greatest and mean norm."""
    r = rows.select("id", V.norm("vector").alias("norm"), V.all_finite("vector").alias("finite"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count_if(~F.col("finite")).alias("not_finite"), F.count_if(~F.col("norm").between(low, high)).alias("norm_out"), F.min("norm").alias("norm_min"), F.max("norm").alias("norm_max"), F.avg("norm").alias("norm_mean"))


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b, mismatches) of two id tables (pos, id): places with different ids, or with one side only."""
    both = a.select("pos", F.col("id").alias("x")).join(b.select("pos", F.col("id").alias("y")), "pos", "full_outer")
    return both.agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("mismatches"))


def assignment_violations(assignments: DataFrame, centroids: DataFrame) -> DataFrame:
    """Assignments to a cluster that has no centroid."""
    return assignments.join(centroids.select("cid"), "cid", "left_anti")


def bounds_violations(rows: DataFrame) -> DataFrame:
    """Rows with k_min above k_max, or chosen_k outside."""
    return rows.where("k_min > k_max OR chosen_k < k_min OR chosen_k > k_max OR k_min < 1")


def id_estimate_violations(rows: DataFrame) -> DataFrame:
    """(k_min, k_max, reason) of estimates of the range of k that are empty or turned round."""
    reason = F.when((F.col("k_min") < 1) | (F.col("k_max") < 1), "zero").when(F.col("k_min") > F.col("k_max"), "order")
    return rows.select("k_min", "k_max", reason.alias("reason")).where("reason IS NOT NULL")


def trace_violations(trace: DataFrame, chosen_k: int | None = None) -> DataFrame:
    """(k, reason) of a trace (k, objective, phase): an unknown phase, an objective that is no finite number of 0 or more, and a chosen k that was never tried."""
    j = F.col("objective")
    reason = F.when(~F.col("phase").isin("coarse", "fine") | F.col("phase").isNull(), "phase").when(j.isNull() | F.isnan(j) | (j < 0) | (j == float("inf")), "objective")
    found = trace.select(F.col("k").cast("long").alias("k"), reason.alias("reason")).where("reason IS NOT NULL")
    if chosen_k is None:
        return found
    lacking = trace.agg(F.count_if(F.col("k") == chosen_k).alias("n")).where("n = 0").select(F.lit(chosen_k).cast("long").alias("k"), F.lit("chosen_k").alias("reason"))
    return found.unionByName(lacking)


def stability_violations(rows: DataFrame) -> DataFrame:
    """Rows of stability() whose figures can't be: outside 0 .. 1, a negative deviation or drift, or not finite."""
    share = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1 + 1e-9)
    least = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0)
    return rows.where(share("mean_nmi") | share("mean_jaccard") | least("std_nmi") | least("mean_drift"))


def centroid_number_violations(centroids: DataFrame) -> DataFrame:
    """(n, least, most, distinct) where the numbers cid are not 0 .. n - 1, each once."""
    found = centroids.agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("least"), F.max("cid").alias("most"), F.countDistinct("cid").alias("distinct"))
    return found.where("n > 0 AND (least <> 0 OR most <> n - 1 OR distinct <> n)")


def clustering_violations(assignments: DataFrame, centroids: DataFrame, expected: int) -> DataFrame:
    """(reason, n) of a clustering of expected rows: another number of assignments, no centroids, or assignments to centroids that don't exist. No rows expected are always right."""
    if not expected:
        return assignments.select(F.lit("").alias("reason"), F.lit(0).cast("long").alias("n")).limit(0)
    rows = assignments.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected).select(F.lit("rows").alias("reason"), "n")
    none = centroids.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no_centroids").alias("reason"), "n")
    lost = assignment_violations(assignments, centroids).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("unknown_centroid").alias("reason"), "n")
    return rows.unionByName(none).unionByName(lost)


def gate_violations(bounds: DataFrame) -> DataFrame:
    """Rows of hierarchy.k_bounds_table whose gate doesn't fit the stage: none at stages 1 and 2, stop or continue at stage 3."""
    fits = F.when(F.col("stage") < 3, F.col("gate") == "none").otherwise(F.col("gate").isin("stop", "continue"))
    return bounds.where(~F.coalesce(fits, F.lit(False)))


def membership_violations(members: DataFrame) -> DataFrame:
    """(reason, n): ids twice, or parents that a mid cluster has more than one of."""
    twice = members.groupBy("id").count().where("count > 1").agg(F.lit("duplicate_id").alias("reason"), F.count(F.lit(1)).alias("n"))
    parents = members.groupBy("mid_id").agg(F.countDistinct("top_id").alias("p")).where("p > 1").agg(F.lit("parents").alias("reason"), F.count(F.lit(1)).alias("n"))
    return twice.unionByName(parents)


def message_violations(messages: DataFrame) -> DataFrame:
    """(msg_id, reason): a field that is missing or blank, an unknown task, or a payload that is too long or no JSON."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.when(blank("job_id"), "job_id").when(blank("task"), "task").when(~F.col("task").isin(*TASKS), "unknown_task")
    reason = reason.when(F.length("payload") > PAYLOAD_MOST, "payload_too_long").when(F.col("payload").isNotNull() & F.expr("try_parse_json(payload) IS NULL"), "payload_no_json")
    return messages.select("msg_id", reason.alias("reason")).where("reason IS NOT NULL")


def first_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right) of the first key at which two tables differ or one lacks it."""
    both = a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right"))).orderBy(key).limit(1)


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one table has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def checksum_mismatches(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, expected, found) where the digest differs or the file is missing."""
    joined = manifest.select("name", F.col("digest").alias("expected")).join(files.select("name", F.col("digest").alias("found")), "name", "left")
    return joined.where(~F.col("expected").eqNullSafe(F.col("found")))
