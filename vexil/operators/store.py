"""A vector table as a log of operations: upsert, strict insert, delete, metadata update, replay, checkpoint, statistics.

The log has lsn LONG, op (insert, delete, update_meta), id LONG, vector, metadata. A snapshot has id, vector, metadata
and holds everything up to checkpoint_lsn.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vexil.operators.order import with_greatest_before, with_position
from vexil.sources import writers

OPS = ("insert", "delete", "update_meta")


def with_empty_snapshot(log: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    return snapshot if snapshot is not None else log.select("id", "vector", "metadata").limit(0)


def replay(log: DataFrame, snapshot: DataFrame | None = None, checkpoint_lsn: int = 0) -> DataFrame:
    """(id, vector, metadata, deleted): the state of every id seen, tombstones included.

    Entries up to checkpoint_lsn are part of the snapshot and not applied. The last insert or delete decides on vector
    and existence; metadata are those of the last insert or update since then, whole (an update replaces). An update of
    an id that isn't there has no effect. One aggregate by id; partial aggregates combine before the shuffle.
    """
    base = with_empty_snapshot(log, snapshot).select(F.lit(checkpoint_lsn).cast("long").alias("lsn"), F.lit("insert").alias("op"), "id", "vector", "metadata")
    entries = base.unionByName(log.where(F.col("lsn") > checkpoint_lsn).select("lsn", "op", "id", "vector", "metadata"))
    body = F.struct("lsn", "op", "vector", "metadata")
    last = F.max_by(F.when(F.col("op") != "update_meta", body), F.when(F.col("op") != "update_meta", F.col("lsn")))
    update = F.max_by(F.when(F.col("op") == "update_meta", F.struct("lsn", "metadata")), F.when(F.col("op") == "update_meta", F.col("lsn")))
    state = entries.groupBy("id").agg(last.alias("e"), update.alias("u")).where("e is not null")
    newer = F.coalesce(F.col("u.lsn") > F.col("e.lsn"), F.lit(False)) & (F.col("e.op") == "insert")
    return state.select("id", F.col("e.vector").alias("vector"), F.when(newer, F.col("u.metadata")).otherwise(F.col("e.metadata")).alias("metadata"), (F.col("e.op") == "delete").alias("deleted"))


def live(state: DataFrame) -> DataFrame:
    return state.where("not deleted").drop("deleted")


def get(state: DataFrame, id: int, tombstones: bool = False) -> DataFrame:
    """The row of an id; a deleted one only if asked for."""
    rows = state.where(F.col("id") == id)
    return rows if tombstones else rows.where("not deleted")


def checkpoint(log: DataFrame, root: str, snapshot: DataFrame | None = None, checkpoint_lsn: int = 0) -> int:
    """Publishes the live rows, in ranges of id, as a new version of the snapshot below root and gives the lsn they hold; log entries up to it may go. Readers of the version before, this job among them, are not disturbed."""
    last = max(checkpoint_lsn, log.agg(F.max("lsn")).first()[0] or 0)
    rows = live(replay(log.where(F.col("lsn") <= last), snapshot, checkpoint_lsn))
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writers.publish(rows.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("checkpoint_lsn", F.lit(last).cast("long")), root, "snapshot")
    return last


def stats(log: DataFrame, snapshot: DataFrame | None = None, checkpoint_lsn: int = 0) -> DataFrame:
    """live, tombstones (deletes logged since the checkpoint, of absent ids too), total = both, and the dimension."""
    state = live(replay(log, snapshot, checkpoint_lsn)).agg(F.count(F.lit(1)).alias("live"), F.max(F.size("vector")).cast("long").alias("dim"))
    dead = log.agg(F.count_if((F.col("op") == "delete") & (F.col("lsn") > checkpoint_lsn)).alias("tombstones"))
    return state.crossJoin(dead).select("dim", (F.col("live") + F.col("tombstones")).alias("total"), "live", "tombstones")


def wal_stats(log: DataFrame, checkpoint_lsn: int = 0) -> DataFrame:
    return log.agg(F.lit(checkpoint_lsn).cast("long").alias("checkpoint_lsn"), F.greatest(F.coalesce(F.max("lsn"), F.lit(0)), F.lit(checkpoint_lsn)).cast("long").alias("last_lsn"), F.count_if(F.col("lsn") > checkpoint_lsn).alias("entries"))


def log_violations(log: DataFrame) -> DataFrame:
    """Entries that make a log invalid: lsn not above all before it (in column pos, the order of the file), or an unknown op."""
    if "segment" in log.columns:  # segment after segment: what the greatest lsn of another one is doesn't matter
        value = F.struct("segment", "lsn")
        marked = with_greatest_before(log, value, "b", "segment", "pos").withColumn("before", F.when(F.col("b.segment").eqNullSafe(F.col("segment")), F.col("b.lsn")))
    else:
        marked = with_greatest_before(log, F.col("lsn"), "before", "pos")
    return marked.where((F.col("lsn") <= F.col("before")) | ~F.col("op").isin(*OPS)).select("pos", "lsn", "op")


def strict_rejections(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, reason) of what makes a strict batch fail as a whole: an id twice in the batch, or one that exists, tombstones included."""
    twice = batch.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_in_batch").alias("reason"))
    there = batch.select("id").distinct().join(existing.select("id"), "id", "left_semi").select("id", F.lit("exists").alias("reason"))
    return twice.unionByName(there)


def append_inserts(log: DataFrame, batch: DataFrame, mode: str = "upsert") -> DataFrame:
    """The log with the batch (pos, id, vector, metadata) behind it, numbered on in order of pos. Mode strict raises if strict_rejections finds any."""
    if mode not in ("upsert", "strict"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "strict" and (bad := strict_rejections(batch, replay(log)).take(1)):
        raise ValueError(f"id {bad[0].id}: {bad[0].reason}")
    return log.unionByName(_numbered(log, batch, "insert", "id", "vector", "metadata"))


def _numbered(log: DataFrame, batch: DataFrame, op: str, *columns) -> DataFrame:
    """Entries of the batch behind the log, numbered on in order of pos by range partitions."""
    last = log.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]
    placed = with_position(batch.withColumnRenamed("pos", "__pos"), "__pos")
    return placed.select((F.col("pos") + F.lit(last + 1)).cast("long").alias("lsn"), F.lit(op).alias("op"), *columns)


def append_deletes(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The log with a delete of each of ids (pos, id) behind it, in order of pos. Raises if one of them has no live row."""
    if bad := delete_missing(ids, replay(log)).take(1):
        raise ValueError(f"id {bad[0].id}: not found")
    kind = log.schema["vector"].dataType
    return log.unionByName(_numbered(log, ids, "delete", "id", F.lit(None).cast(kind).alias("vector"), F.lit(None).cast("string").alias("metadata")))


def append_updates(log: DataFrame, patches: DataFrame) -> DataFrame:
    """The log with an update of the metadata of each of patches (pos, id, metadata) behind it, in order of pos. Raises if one of them has no live row."""
    if bad := delete_missing(patches, replay(log)).take(1):
        raise ValueError(f"id {bad[0].id}: not found")
    kind = log.schema["vector"].dataType
    return log.unionByName(_numbered(log, patches, "update_meta", "id", F.lit(None).cast(kind).alias("vector"), "metadata"))


def present(ids: DataFrame, state: DataFrame) -> DataFrame:
    """The ids that have a live row; missing and deleted ones are left out."""
    return ids.join(live(state).select("id"), "id", "left_semi")


def delete_missing(ids: DataFrame, state: DataFrame) -> DataFrame:
    """Ids whose delete is an error because no live row has them."""
    return ids.select("id").join(live(state).select("id"), "id", "left_anti")


def merge_base_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of base and delta (id, seq, ...), the later line of an id winning, those of delta above all of base."""
    both = base.withColumn("__side", F.lit(0)).unionByName(delta.withColumn("__side", F.lit(1)))
    rest = [c for c in base.columns if c != "id"]
    picked = both.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("__side", "seq")).alias("r"))
    return picked.select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def attach(ids: DataFrame, metadata: DataFrame, tombstones: DataFrame) -> DataFrame:
    """ids with the last metadata line of each and whether it is deleted."""
    last = metadata.groupBy("id").agg(F.max_by("metadata", "line").alias("metadata"))
    dead = tombstones.select("id").distinct().withColumn("deleted", F.lit(True))
    return ids.join(last, "id", "left").join(dead, "id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def live_spans(rows: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """(start_row, end_row, n) of runs of neighbouring live rows; rows has row and deleted. Islands are found within each of the partition columns, by places in the order of these and row, so that no partition comes in one task."""
    by = partition or []
    marked = with_position(rows.where("not deleted").select(*by, "row"), *by, "row").withColumn("island", F.col("row") - F.col("pos"))
    return marked.groupBy(*by, "island").agg(F.min("row").alias("start_row"), F.max("row").alias("end_row"), F.count(F.lit(1)).alias("n")).drop("island")


class VectorStore:
    """A vector table below a folder: a published snapshot and a log of what came since. Every change is a file of the log, so flush has nothing to wait for."""

    COLUMNS = "lsn long, op string, id long, vector array<float>, metadata string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.opened = spark, root, False

    def init(self) -> VectorStore:
        """Makes an empty table; raises if there is one."""
        if writers.read_small(self.spark, f"{self.root}/store.current") is not None:
            raise ValueError(f"{self.root} holds a table")
        writers.write_text(self.spark, f"{self.root}/store.current", "1")
        return self.open()

    def open(self) -> VectorStore:
        if writers.read_small(self.spark, f"{self.root}/store.current") is None:
            raise ValueError(f"{self.root} holds no table")
        self.opened = True
        return self

    def close(self) -> None:
        self.opened = False

    def _open(self) -> None:
        if not self.opened:
            raise ValueError("the table is not open")

    def log(self) -> DataFrame:
        self._open()
        path, fs = writers._fs(self.spark, f"{self.root}/log")
        return self.spark.read.schema(self.COLUMNS).parquet(f"{self.root}/log") if fs.exists(path) else self.spark.createDataFrame([], self.COLUMNS)

    def snapshot(self) -> tuple[DataFrame | None, int]:
        """The snapshot and the lsn it holds."""
        self._open()
        rows = writers.published(self.spark, self.root, "snapshot")
        lsn = writers.read_small(self.spark, f"{self.root}/snapshot.lsn")
        return (None if rows is None else rows.drop("checkpoint_lsn")), int(lsn or 0)

    def state(self) -> DataFrame:
        rows, lsn = self.snapshot()
        return replay(self.log(), rows, lsn)

    def _append(self, op: str, batch: DataFrame, *columns) -> None:
        log = self.log()
        base = log.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]
        floor = self.spark.createDataFrame([(max(base, self.snapshot()[1]),)], "lsn long")
        writers.append_log(_numbered(floor, batch, op, *columns).select("lsn", "op", F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), "metadata"), f"{self.root}/log")

    def insert(self, batch: DataFrame, mode: str = "upsert") -> None:
        """batch(pos, id, vector, metadata). Mode strict raises if strict_rejections finds any."""
        if mode == "strict" and (bad := strict_rejections(batch, self.state()).take(1)):
            raise ValueError(f"id {bad[0].id}: {bad[0].reason}")
        self._append("insert", batch, "id", "vector", "metadata")

    def remove(self, ids: DataFrame) -> None:
        """ids(pos, id)."""
        if bad := delete_missing(ids, self.state()).take(1):
            raise ValueError(f"id {bad[0].id}: not found")
        self._append("delete", ids, "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"))

    def update_metadata(self, patches: DataFrame) -> None:
        """patches(pos, id, metadata)."""
        if bad := delete_missing(patches, self.state()).take(1):
            raise ValueError(f"id {bad[0].id}: not found")
        self._append("update_meta", patches, "id", F.lit(None).cast("array<float>").alias("vector"), "metadata")

    def flush(self) -> None:
        """Changes are on the shared file system when their call returns."""
        self._open()

    def checkpoint(self) -> int:
        """Publishes a snapshot of all changes so far. The lsn is written after the snapshot: after a crash in between, entries that the snapshot holds are applied to it once more, with the same result."""
        rows, lsn = self.snapshot()
        last = checkpoint(self.log(), self.root, rows, lsn)
        writers.write_text(self.spark, f"{self.root}/snapshot.lsn", str(last))
        return last


def dirty_ranges(marks: DataFrame) -> DataFrame:
    """(segment_id, start_row, end_row, reason) from marks (segment_id, seq, row, reason): a mark extends the last range if that has the same reason and row lies within or right behind it; else it begins one. One pass over the marks of a segment in order, in Arrow batches; what a segment's marks amount to may be long, so they are streamed and never held in a row."""
    schema = T.StructType([marks.schema["segment_id"], T.StructField("start_row", T.LongType()), T.StructField("end_row", T.LongType()), T.StructField("reason", T.StringType())])

    def run(batches):
        last, out = None, []
        for b in batches:
            for segment, row, reason in zip(*(b.column(c).to_pylist() for c in ("segment_id", "row", "reason"))):
                if last is not None and last[0] == segment and last[3] == reason and last[1] <= row <= last[2] + 1:
                    last[2] = max(last[2], row)
                else:
                    if last is not None:
                        out.append(last)
                    last = [segment, row, row, reason]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], arrow)
                out = []
        if last is not None:
            out.append(last)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], arrow)

    arrow = to_arrow_schema(schema)
    rows = marks.select("segment_id", "seq", F.col("row").cast("long").alias("row"), "reason")
    return rows.repartition("segment_id").sortWithinPartitions("segment_id", "seq").mapInArrow(run, schema)
