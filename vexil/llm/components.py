"""Connected components of an edge table by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.common import drop_table, stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the least of u and all its partners. The aggregate combines before its shuffle, so a hub with many partners does no harm."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return edges.join(least, "u")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for each node that has an edge in edges(u, v), both LONG; root is the least node of the component.

    Needs about log(diameter) rounds, each of two joins; every round is written to the shared folder and the one before
    deleted. Loops and repeated edges do no harm; an edge with a null is left out; no edges give no rows. Unfinished
    components are never returned: without an end after most_rounds it raises.
    """
    spark = edges.sparkSession
    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    now, path = stored(edges.dropna().where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = now.select(state.alias("s")).first()[0]
    for _ in range(most_rounds):
        if not before[0]:
            break
        large = _with_least(_both_ways(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mins = _with_least(large)
        small = mins.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old = path
        now, path = stored(small, "edges")
        drop_table(spark, old)
        after = now.select(state.alias("s")).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components of {before[0]} edges not found in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
