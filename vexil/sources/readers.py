"""Readers: vectors as JSON lines, binary feeds and parallel files, text files, logs, telemetry; and generators of test vectors."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.functions import vectors as V

FEED = b"V3BI"
TEXT_EXTENSIONS = (".txt", ".md")
MOST_BYTES = 50 * 1024 * 1024


def jsonl_vectors(spark: SparkSession, path: str, dim: int, strict: bool = True) -> DataFrame:
    """(id, vector) of lines {"embedding_id", "vector"}; blank lines are skipped. Strict: a bad line or another dimension fails the query."""
    rows = spark.read.schema("embedding_id long, vector array<float>, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    fits = V.has_dimension("vector", dim) & F.col("embedding_id").isNotNull()
    if strict:
        broken = F.raise_error(F.concat(F.lit("bad vector of id "), F.coalesce(F.col("embedding_id").cast("string"), F.lit("?"))))
        return rows.select(F.col("embedding_id").alias("id"), F.when(fits, F.col("vector")).otherwise(broken).alias("vector"))
    return rows.where(fits).select(F.col("embedding_id").alias("id"), "vector")


def jsonl_csv_vectors(spark: SparkSession, path: str, dim: int | None = None, id_field: str = "embedding_id") -> DataFrame:
    """(id, vector, metadata) of lines {id_field, "vec_csv", "meta_json"}; lines of another dimension are left out."""
    rows = spark.read.schema(f"{id_field} long, vec_csv string, meta_json string").json(path)
    out = rows.select(F.col(id_field).alias("id"), V.parse_csv("vec_csv").alias("vector"), F.col("meta_json").alias("metadata")).where("id IS NOT NULL AND vector IS NOT NULL")
    return out.where(V.has_dimension("vector", dim)) if dim else out


def _records(data: bytes, dtype: np.dtype, path: str) -> np.ndarray:
    if len(data) % dtype.itemsize:
        raise ValueError(f"{path}: {len(data)} bytes are no whole number of records of {dtype.itemsize}")
    return np.frombuffer(data, dtype)


def _decode(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield from decode(p, data)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _lists(x: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), kind))


def binary_feed(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, vector) of feeds: magic, version 1, record size, count, then id and floats, little-endian. Anything wrong with header or size fails."""
    dtype = np.dtype([("id", "<u8"), ("v", "<f4", (dim,))])

    def decode(p, data):
        if len(data) < 18 or data[:4] != FEED:
            raise ValueError(f"{p}: no feed")
        version, size, count = struct.unpack("<HIQ", data[4:18])
        if version != 1 or size != dtype.itemsize or len(data) - 18 != size * count:
            raise ValueError(f"{p}: version {version}, record size {size}, count {count} don't fit {len(data)} bytes of dimension {dim}")
        r = np.frombuffer(data[18:], dtype)
        if len(r) and r["id"].max() > np.iinfo(np.int64).max:
            raise ValueError(f"{p}: an id beyond 2**63 - 1")
        for s in range(0, len(r), 4096):
            part = r[s : s + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part["id"].astype(np.int64)), _lists(part["v"], pa.float32())], ["id", "vector"])

    return _decode(spark, path, decode, "id long, vector array<float>")


def sentence_embeddings(spark: SparkSession, path: str, dim: int = 2048) -> DataFrame:
    """(record, packed, vector) of fixed-width records: an 80-bit id, then half floats. packed is DECIMAL(25,0)."""
    dtype = np.dtype([("low", "<u8"), ("high", "<u2"), ("v", "<f2", (dim,))])

    def decode(p, data):
        from decimal import Decimal

        r = _records(data, dtype, p)
        for s in range(0, len(r), 4096):
            part = r[s : s + 4096]
            ids = [Decimal((int(h) << 64) | int(w)) for h, w in zip(part["high"], part["low"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(part))), pa.array(ids, pa.decimal128(25, 0)), _lists(part["v"].astype(np.float32), pa.float32())], ["record", "packed", "vector"])

    return _decode(spark, path, decode, "record long, packed decimal(25,0), vector array<float>")


def parallel_files(spark: SparkSession, ids: str, vectors: str, metadata: str, dim: int) -> DataFrame:
    """(id, vector, metadata) of three files read side by side; different numbers of rows fail, and so does a path that is no single file, since places count within a file."""
    for path in (ids, vectors, metadata):
        if spark.read.format("binaryFile").load(path).select("path").limit(2).count() != 1:
            raise ValueError(f"{path} is no single file")
    u = _decode(spark, ids, lambda p, d: [pa.RecordBatch.from_arrays([pa.array(np.arange(len(d) // 8)), pa.array(_records(d, np.dtype("<u8"), p).astype(np.int64))], ["pos", "id"])], "pos long, id long")

    def floats(p, d):
        x = _records(d, np.dtype(("<f4", (dim,))), p).reshape(-1, dim)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), _lists(x, pa.float32())], ["pos", "vector"])

    v = _decode(spark, vectors, floats, "pos long, vector array<float>")
    lines = lambda p, d: [pa.RecordBatch.from_arrays([pa.array(np.arange(len(x := d.decode().splitlines()))), pa.array(x, pa.string())], ["pos", "metadata"])]
    m = _decode(spark, metadata, lines, "pos long, metadata string")
    counts = {u.count(), v.count(), m.count()}
    if len(counts) > 1:
        raise ValueError(f"numbers of rows differ: {sorted(counts)}")
    return u.join(v, "pos").join(m, "pos").select("id", "vector", "metadata")


def discover_text(spark: SparkSession, directory: str, extensions: Sequence[str] = TEXT_EXTENSIONS, recursive: bool = False, skip_hidden: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, content) of text files: by extension in any case, not hidden, not empty, not above most_bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory).where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    ends = [F.lower("path").endswith(e.lower()) for e in extensions]
    wanted = ends[0]
    for e in ends[1:]:
        wanted |= e
    files = files.where(wanted)
    if skip_hidden:
        files = files.where(~F.col("path").rlike(r"/\.[^/]+"))
    return files.select("path", "length", "content")


def read_text(files: DataFrame) -> DataFrame:
    """(path, text): files that are no valid UTF-8 have a null text."""
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))


def operation_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of a vector table, as store.replay takes it."""
    return spark.read.schema("lsn long, op string, id long, vector array<float>, metadata string").parquet(path)


def baseline(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(stage_id, elapsed_ms) of the previous run, malformed lines left out; and why there is none: no_previous_run_baseline, baseline_empty or baseline_parse_failed."""
    schema = "stage_id string, elapsed_ms double"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema), "no_previous_run_baseline"
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*").where("stage_id IS NOT NULL AND elapsed_ms >= 0 AND NOT isnan(elapsed_ms) AND elapsed_ms < double('infinity')")
    if rows.take(1):
        return rows, None
    return rows, "baseline_parse_failed" if lines.take(1) else "baseline_empty"


def vector_argument(text: str, dim: int) -> list[float]:
    """A vector given as comma-separated numbers; an empty or bad token, or another dimension, fails."""
    out = [float(x) for x in text.split(",")]
    if len(out) != dim:
        raise ValueError(f"{len(out)} numbers, not {dim}")
    return out


def uniform(spark: SparkSession, rows: int, dim: int, seed: int = 1337) -> DataFrame:
    """(id, vector): ids from 1, values in [0, 1) drawn from hashes, the same for any partitioning."""
    value = lambda i: (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 24)).cast("double") / float(1 << 24)).cast("float")
    return spark.range(1, rows + 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("vector"))


def sentence_embedding_count(spark: SparkSession, path: str, dim: int = 2048) -> DataFrame:
    """(path, records) of fixed-width files, by their lengths; a length that is no whole number of records fails."""
    width = 10 + 2 * dim
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    broken = F.raise_error(F.concat("path", F.lit(": no whole number of records"))).cast("long")
    return files.select("path", F.when(F.col("length") % width == 0, (F.col("length") / width).cast("long")).otherwise(broken).alias("records"))


def discovery_counts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(discovered, read, undecodable) of discover_text and read_text."""
    found = files.agg(F.count(F.lit(1)).alias("discovered"))
    return found.join(texts.agg(F.count("text").alias("read"), F.count_if(F.col("text").isNull()).alias("undecodable")))


def synthetic(spark: SparkSession, rows: int, dim: int, clusters: int = 32, noise: float = 0.04, outliers: float = 0.0, seed: int = 1337) -> DataFrame:
    """(id, vector, cluster): unit vectors around random centres, and a share of outliers far from all. The same for any partitioning: all is drawn from hashes."""
    unit = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)
    base = spark.range(1, rows + 1).withColumn("cluster", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(clusters)).cast("int"))
    base = base.withColumn("far", unit(F.lit(seed + 1), F.col("id")) < outliers)

    def element(i):
        centre = 2 * unit(F.lit(seed + 2), F.col("cluster"), i) - 1
        own = F.sqrt(-2 * F.log(unit(F.lit(seed + 3), F.col("id"), i) + 1e-12)) * F.cos(2 * F.pi() * unit(F.lit(seed + 4), F.col("id"), i))
        return F.when(F.col("far"), 8 * unit(F.lit(seed + 5), F.col("id"), i) - 4).otherwise(centre + noise * own)

    raw = base.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), element))
    return raw.select("id", F.transform(V.normalise("vector"), lambda x: x.cast("float")).alias("vector"), F.when(F.col("far"), -1).otherwise(F.col("cluster")).alias("cluster"))
