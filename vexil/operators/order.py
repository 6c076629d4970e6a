"""Rows in a total order without one task that sees them all: range partitions, counted or summed up, and what is carried from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexil.storage import materialise


def _laid(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")


def _before(column: Column | str) -> Column:
    """Over all range partitions before; the window has a row for each of them."""
    return F.sum(column).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))


def with_position(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, their place from 0 in the order of the columns. Range partitions are counted, so no task sees all rows."""
    laid, part = _laid(rows, order), F.shiftright("__at", 33)
    offsets = laid.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(_before("__n"), F.lit(0)).alias("__before"))
    joined = laid.join(F.broadcast(offsets), part == F.col("__p"))  # a row for each partition
    return joined.select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("pos"))


def with_previous(rows: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """rows with the value of the row before in the order of the columns; null for the first."""
    laid = _laid(rows, order).withColumn("__p", F.shiftright("__at", 33)).withColumn("__v", value)
    last = laid.groupBy("__p").agg(F.max_by(F.struct("__v"), "__at").alias("__l"))
    carried = last.select("__p", F.last("__l").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).getField("__v").alias("__c"))
    own = Window.partitionBy("__p").orderBy("__at")
    first = F.row_number().over(own) == 1
    lagged = laid.withColumn("__lag", F.lag("__v").over(own)).withColumn("__first", first)
    return lagged.join(F.broadcast(carried), "__p").select(*rows.columns, F.when(F.col("__first"), F.col("__c")).otherwise(F.col("__lag")).alias(name))


def with_last_before(rows: DataFrame, value: str, name: str, *order: str) -> DataFrame:
    """rows with the last value that is not null of all rows before in the order of the columns."""
    laid = _laid(rows, order).withColumn("__p", F.shiftright("__at", 33))
    top = laid.groupBy("__p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at"))).alias("__t"))
    carried = top.select("__p", F.last("__t", True).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))
    own = F.last(value, True).over(Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    return laid.withColumn("__own", own).join(F.broadcast(carried), "__p").select(*rows.columns, F.coalesce("__own", "__c").alias(name))


def with_greatest_before(rows: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """rows with the greatest value of all rows before in the order of the columns; null where there is none."""
    laid = _laid(rows, order).withColumn("__p", F.shiftright("__at", 33)).withColumn("__v", value)
    top = laid.groupBy("__p").agg(F.max("__v").alias("__t"))
    carried = top.select("__p", F.max("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))
    own = F.max("__v").over(Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    return laid.withColumn("__own", own).join(F.broadcast(carried), "__p").select(*rows.columns, F.greatest("__own", "__c").alias(name))
