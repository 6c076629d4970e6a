"""The layers below the top one, and what is reported about them: mid numbers, gates, final clusters, membership, bounds, counts.

Tables: assignments (id, top_id), mids (id, top_id, mid) with mid from 0 in each top cluster. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexil.functions.vectors import NONE

GATE = 32


def bounds(rows: DataFrame) -> DataFrame:
    """rows(n) with k_min and k_max, as kmeans.k_bounds has them."""
    low = F.when(F.col("n") > 0, F.greatest(F.lit(1), F.least(F.lit(32), F.col("n")))).otherwise(0).cast("long")
    return rows.withColumn("k_min", low).withColumn("k_max", F.greatest("k_min", F.least(F.lit(256), F.col("n"))).cast("long"))


def mid_ids(mids: DataFrame) -> DataFrame:
    """(id, top_id, mid_id): numbers that run on from one top cluster to the next. The offsets are a running sum over one row for each top cluster."""
    sizes = mids.groupBy("top_id").agg((F.max("mid") + 1).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("top_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return mids.join(sizes.select("top_id", before.alias("offset")), "top_id").select("id", "top_id", (F.col("mid") + F.col("offset")).cast("long").alias("mid_id"))


def lower_gate(mids: DataFrame, threshold: int = GATE) -> DataFrame:
    """(top_id, mid_id, n, gate): a branch of at most threshold rows stops, others continue."""
    return mids.groupBy("top_id", "mid_id").agg(F.count(F.lit(1)).alias("n")).withColumn("gate", F.when(F.col("n") <= threshold, "stop").otherwise("continue"))


def gate_by_size(branches: DataFrame, least: int = 64) -> DataFrame:
    """The other gate: a branch of least rows or more continues."""
    return branches.withColumn("gate", F.when(F.col("n") >= least, "continue").otherwise("stop"))


def gate_counts(gates: DataFrame) -> DataFrame:
    """(stop, continue, processed)."""
    return gates.agg(F.count_if(F.col("gate") == "stop").alias("stop"), F.count_if(F.col("gate") == "continue").alias("continue"), F.coalesce(F.sum("n"), F.lit(0)).alias("processed"))


def final_clusters(gates: DataFrame) -> DataFrame:
    """(final_id, top_id, mid_id, n) of the branches that stop, numbered from 0. Numbers are given to branches, not rows."""
    order = F.row_number().over(Window.orderBy("top_id", "mid_id")) - 1
    return gates.where("gate = 'stop'").select(order.cast("long").alias("final_id"), "top_id", "mid_id", "n")


def final_assignments(mids: DataFrame, finals: DataFrame) -> DataFrame:
    """(id, final_id)."""
    return mids.join(finals.select("top_id", "mid_id", "final_id"), ["top_id", "mid_id"]).select("id", "final_id")


def missing_vectors(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Assigned ids without a live vector; any is an error."""
    return assignments.select("id").join(vectors.select("id"), "id", "left_anti")


def membership(ids: DataFrame, tops: DataFrame, mids: DataFrame, lower: DataFrame, finals: DataFrame) -> DataFrame:
    """(id, top_id, mid_id, lower_id, final_id) of all ids with top and mid of the same parent; lower_id is the number of a branch that continues, final_id of one that stops, NONE otherwise. lower has (top_id, mid_id, gate, lower_id). An id without a top or mid cluster, or with a mid cluster of another parent, fails the query."""
    joined = ids.select("id").join(tops, "id", "left").join(mids.select("id", F.col("top_id").alias("parent"), "mid_id"), "id", "left")
    whole = F.col("top_id").isNotNull() & F.col("mid_id").isNotNull() & F.col("parent").eqNullSafe(F.col("top_id"))
    failed = F.raise_error(F.concat(F.lit("no whole path of clusters for id "), F.col("id").cast("string"))).cast("long")
    joined = joined.withColumn("top_id", F.when(whole, F.col("top_id")).otherwise(failed))
    branch = joined.join(lower.where("gate = 'continue'").select("top_id", "mid_id", "lower_id"), ["top_id", "mid_id"], "left")
    fill = lambda c: F.coalesce(F.col(c), F.lit(NONE)).cast("long").alias(c)
    return branch.join(finals.select("top_id", "mid_id", "final_id"), ["top_id", "mid_id"], "left").select("id", "top_id", "mid_id", fill("lower_id"), fill("final_id"))


def membership_violations(members: DataFrame, lower: DataFrame) -> DataFrame:
    """Rows of a branch that stops without a final id."""
    return members.join(lower.where("gate = 'stop'").select("top_id", "mid_id"), ["top_id", "mid_id"], "left_semi").where(F.col("final_id") == NONE)


def lower_ids(gates: DataFrame) -> DataFrame:
    """gates with lower_id, numbers of all branches from 0 in order."""
    return gates.withColumn("lower_id", (F.row_number().over(Window.orderBy("top_id", "mid_id")) - 1).cast("long"))


def k_bounds_table(total: DataFrame, tops: DataFrame, gates: DataFrame) -> DataFrame:
    """(stage, source_id, n, gate, k_min, k_max): one row for the top stage (1), one for each top cluster (2) and each branch (3), where a branch that stops has both bounds 1."""
    top = bounds(total.agg(F.count(F.lit(1)).alias("n"))).select(F.lit(1).alias("stage"), F.lit(0).cast("long").alias("source_id"), "n", F.lit("none").alias("gate"), "k_min", "k_max")
    mid = bounds(tops.groupBy("top_id").agg(F.count(F.lit(1)).alias("n"))).select(F.lit(2).alias("stage"), F.col("top_id").alias("source_id"), "n", F.lit("none").alias("gate"), "k_min", "k_max")
    low = bounds(gates)
    stop = F.col("gate") == "stop"
    low = low.select(F.lit(3).alias("stage"), F.col("mid_id").alias("source_id"), "n", "gate", F.when(stop, 1).otherwise(F.col("k_min")).cast("long").alias("k_min"), F.when(stop, 1).otherwise(F.col("k_max")).cast("long").alias("k_max"))
    return top.unionByName(mid).unionByName(low)


def rows_by_stage(table: DataFrame) -> DataFrame:
    return table.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))


def counts_by_level(members: DataFrame) -> DataFrame:
    """(level, cluster_id, n) for top, mid, final and all, by grouping sets."""
    rows = members.groupingSets([["top_id"], ["mid_id"], ["final_id"], []], "top_id", "mid_id", "final_id").agg(F.count(F.lit(1)).alias("n"), F.grouping("top_id").alias("gt"), F.grouping("mid_id").alias("gm"), F.grouping("final_id").alias("gf"))
    level = F.when(F.col("gt") == 0, "top").when(F.col("gm") == 0, "mid").when(F.col("gf") == 0, "final").otherwise("all")
    return rows.select(level.alias("level"), F.coalesce("top_id", "mid_id", "final_id", F.lit(-1)).cast("long").alias("cluster_id"), "n")


def empty_violations(branches: DataFrame) -> DataFrame:
    """Branches without rows."""
    return branches.where("n <= 0 OR n IS NULL")


def group_order(assignments: DataFrame) -> DataFrame:
    """(place, top_id, n): clusters by size falling, number rising."""
    sizes = assignments.groupBy("top_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "top_id")))


def second_level_eligibility(groups: DataFrame, least: int = 8) -> DataFrame:
    """groups(n, live) with eligible and the reason why not."""
    need = max(8, least)
    reason = F.when(F.col("n") < need, "too_few_vectors").when(F.col("live") < need, "too_few_live_vectors")
    return groups.withColumn("reason", reason).withColumn("eligible", F.isnull("reason"))


def second_level_summary(groups: DataFrame) -> DataFrame:
    """Totals of groups(n, eligible, elapsed_ms): processed, skipped, vectors, vectors a second."""
    done = F.col("eligible")
    ms = F.sum(F.when(done, F.col("elapsed_ms")))
    n = F.coalesce(F.sum(F.when(done, F.col("n"))), F.lit(0))
    return groups.agg(F.count_if(done).alias("processed"), F.count_if(~done).alias("skipped"), n.alias("vectors"), F.when(ms > 0, n * 1000.0 / ms).otherwise(0.0).alias("vectors_per_s"))


def cluster_stats(bounds_row: DataFrame, trace: DataFrame) -> DataFrame:
    """bounds_row(k_min, k_max, chosen_k) with the objective at chosen_k, else the least of the trace."""
    at = trace.select(F.col("k"), "objective")
    best = trace.agg(F.min("objective").alias("least"))
    return bounds_row.join(F.broadcast(at.withColumnRenamed("k", "chosen_k")), "chosen_k", "left").crossJoin(best).select("k_min", "k_max", "chosen_k", F.coalesce("objective", "least").alias("objective"))
