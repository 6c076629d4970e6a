"""Sinks: logs and snapshots by commit, artifacts with digests and manifests, precisions, feeds, reports."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.functions import vectors as V
from vexil.sources.readers import FEED


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole or not at all: beside it first, then renamed over it in one step, so that at any moment there is the old one or the new one."""
    p, fs = _fs(spark, path)
    side, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(side, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename_over(spark, side, p, fs)


def rename_over(spark: SparkSession, side, p, fs) -> None:
    """One step of the file system: FileContext's rename with OVERWRITE."""
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(option, 1)
    over[0] = option.OVERWRITE
    uri = p.toUri() if p.toUri().getScheme() else fs.getUri()
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()).rename(side, p, over)


def read_small(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    return "\n".join(r.value for r in spark.read.text(path).collect()) if fs.exists(p) else None


def publish(df: DataFrame, root: str, name: str) -> str:
    """Writes a version of a table below root and then moves the pointer to it: readers see the old one or the new one."""
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    write_text(df.sparkSession, f"{root}/{name}.current", path)
    return path


def published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    path = read_small(spark, f"{root}/{name}.current")
    return spark.read.parquet(path) if path else None


COMMIT_POLICIES = ("auto", "strict_per_record", "batch_group_commit")


def append_log(entries: DataFrame, path: str, per_commit: int | None = None, policy: str = "auto") -> None:
    """Appends log entries; with per_commit, as many rows at most to each file. The policy strict_per_record has a file for each entry, batch_group_commit one for each partition; auto is the latter."""
    if policy not in COMMIT_POLICIES:
        raise ValueError(f"no such policy: {policy}")
    rows = 1 if policy == "strict_per_record" else per_commit or 0
    entries.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def truncate_log(spark: SparkSession, path: str, root: str, upto: int) -> str:
    """Publishes the log without the entries up to an lsn that a snapshot holds."""
    return publish(spark.read.parquet(path).where(F.col("lsn") > upto), root, "log")


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): SHA-256 of the sorted row digests; independent of partitions and file layout."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = df.select(row.alias("d")).groupBy(F.substring("d", 1, 3).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def write_artifact(df: DataFrame, root: str, name: str) -> DataFrame:
    """Publishes a table and gives its manifest row (name, rows, bytes, digest); bytes are those of the files written."""
    spark, path = df.sparkSession, publish(df, root, name)
    p, fs = _fs(spark, path)
    size = fs.getContentSummary(p).getLength()
    return digest(spark.read.parquet(path)).select(F.lit(name).alias("name"), "rows", F.lit(size).cast("long").alias("bytes"), "digest")


def manifest(rows: DataFrame) -> DataFrame:
    """(manifest): one JSON object of all manifest rows, of which there is one for each artifact."""
    return rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("artifacts"))).alias("manifest"))


def read_artifact(spark: SparkSession, root: str, name: str, expected: DataFrame | None = None) -> DataFrame:
    """A published table. With the manifest rows that it should have, other rows or another digest fail."""
    table = published(spark, root, name)
    if table is None:
        raise ValueError(f"no artifact {name} below {root}")
    if expected is not None:
        want, got = expected.where(F.col("name") == name).first(), digest(table).first()
        if want is None or (want["rows"], want["digest"]) != (got["rows"], got["digest"]):
            raise ValueError(f"artifact {name} doesn't agree with its manifest")
    return table


def json_artifact(df: DataFrame, path: str) -> None:
    """A table as JSON lines, the form of the first generation's artifacts."""
    df.write.mode("overwrite").json(path)


def monitor_csv(values: DataFrame, path: str) -> None:
    """The parsed lines of a board monitor as CSV with a header; CPU loads are joined by blanks, temperatures are one column a sensor."""
    sensors = sorted(r[0] for r in values.select(F.explode(F.map_keys("celsius"))).distinct().limit(1000).collect())
    plain = [c for c in values.columns if c not in ("celsius", "cpu_percent")]
    heat = [F.col("celsius")[s].alias(f"celsius_{s}") for s in sensors]
    values.select(*plain, F.array_join("cpu_percent", " ").alias("cpu_percent"), *heat).write.mode("overwrite").option("header", True).csv(path)


def _through(lists: pd.Series, kind, convert) -> pd.Series:
    """convert of the elements of all lists, cut into lists again; null lists stay null."""
    real = lists.notna().to_numpy()
    own = lists[real].to_list()
    if not own:
        return pd.Series([None] * len(lists), dtype=object)
    ends = np.cumsum([len(x) for x in own])
    out = np.empty(len(lists), dtype=object)
    for i, x in zip(np.flatnonzero(real), np.split(convert(np.concatenate([np.asarray(x, kind) for x in own])), ends[:-1])):
        out[i] = x
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.ShortType()))
def half_bits(v: pd.Series) -> pd.Series:
    """The bits of an array of floats as half floats, all arrays of a batch at once."""
    return _through(v, np.float32, lambda x: x.astype(np.float16).view(np.int16))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half_bits(b: pd.Series) -> pd.Series:
    return _through(b, np.int16, lambda x: x.view(np.float16).astype(np.float32))


def precisions(rows: DataFrame) -> DataFrame:
    """(id, vector, half, codes, scale): the same vectors in three precisions."""
    return rows.select("id", "vector", half_bits("vector").alias("half"), V.quantise_int8("vector").alias("codes"), V.int8_scale("vector").alias("scale"))


def binary_feed_bytes(ids, vectors) -> bytes:
    """A feed as readers.binary_feed takes it."""
    x = np.asarray(vectors, "<f4")
    r = np.zeros(len(x), np.dtype([("id", "<u8"), ("v", "<f4", (x.shape[1],))]))
    r["id"], r["v"] = ids, x
    return FEED + struct.pack("<HIQ", 1, r.dtype.itemsize, len(r)) + r.tobytes()


def sentence_embedding_bytes(packed, vectors) -> bytes:
    """Records as readers.sentence_embeddings takes them; ids beyond 80 bits or values that half floats can't hold fail."""
    x = np.asarray(vectors, np.float32)
    if any(not 0 <= int(i) < 1 << 80 for i in packed) or not np.isfinite(x.astype(np.float16)).all():
        raise ValueError("an id or a value is out of range")
    r = np.zeros(len(x), np.dtype([("low", "<u8"), ("high", "<u2"), ("v", "<f2", (x.shape[1],))]))
    r["low"], r["high"], r["v"] = [int(i) & (1 << 64) - 1 for i in packed], [int(i) >> 64 for i in packed], x
    return r.tobytes()


def write_baseline(rows: DataFrame, path: str) -> None:
    """The elapsed time of each stage, one file of JSON lines in order of stage_id, three decimals."""
    rows.select("stage_id", F.round("elapsed_ms", 3).alias("elapsed_ms")).orderBy("stage_id").coalesce(1).write.mode("overwrite").json(path)
