"""Line dedup over levelled sorted runs of line hashes.

Documents come in BATCHES ranges of doc_id. Of each batch the first place of every line (by 128-bit hash) is kept if
the runs written so far don't have it: the batch is merge-anti-joined with each run, and what is new becomes a run of
level 0, sorted and bucketed by hash so that later joins need neither a shuffle nor a sort of it. When a level holds
FANOUT runs they are compacted to one run of the next level. Altogether each line stays at its first place in order of
(doc_id, line number). The ranges bear on the size of a batch only, not on the result.

Runs can be kept: LineRuns.open(spark, root) finds what was added under root before, and add_batch gives a later batch
without the lines that any earlier one had, at the cost of that batch and one read of the runs.

Lines are what LF separates, compared exactly. Defined results: blank lines (only spaces) are never removed and never
counted; a document that loses its last non-blank line goes; one that had none from the start stays as it is; a null
text stays null. doc_id may be of any type that can be ordered; null doc_ids form the start of the order. Rows equal in
doc_id and text are one document: each of them comes out alike. Rows with equal doc_id and other text are ordered by text
hash. Texts of any length are handled whole; an empty table gives an empty one. Other columns pass through.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.common import SMALL_BATCHES, drop_table, materialise, partitions_for, set_aside, settings, shared_dir, text_key

BATCHES, FANOUT, SAMPLE = 8, 4, 4000
PLACE = ["doc_id", "key", "line_no"]
#: A bucket of a run is one sorted file, so that its order can be relied on.
ORDERED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


class LineRuns:
    """The levels: lists of (table, path) of bucketed tables of (h1, h2, doc_id, key, line_no). A manifest under root says which runs there are; a new one is written before the runs it replaces are deleted."""

    def __init__(self, spark, buckets: int, root: str | None = None):
        self.spark, self.buckets, self.levels, self.version, self.columns = spark, buckets, [[]], 0, ""
        self.root = root or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"

    @classmethod
    def open(cls, spark, root: str, buckets: int | None = None) -> LineRuns:
        """The runs under root as the last whole manifest has them; none if there is none."""
        runs = cls(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().toString() for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest-*")) or []]
        for name in sorted(names, reverse=True):
            try:
                found = json.loads("".join(r.value for r in spark.read.text(name).collect()))
            except ValueError:
                continue  # was not finished
            runs.buckets, runs.version, runs.columns = found["buckets"], found["version"], found["columns"]
            runs.levels = [[(runs._register(path), path) for path in level] for level in found["levels"]]
            break
        return runs

    def _register(self, path: str) -> str:
        name = f"run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        self.columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def _publish(self) -> None:
        self.version += 1
        body = json.dumps({"version": self.version, "buckets": self.buckets, "columns": self.columns, "levels": [[path for _, path in level] for level in self.levels]})
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest-{self.version:012d}")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(body.encode()))
        out.close()

    def all(self) -> list[tuple[str, str]]:
        return [r for level in self.levels for r in level]

    def insert(self, firsts: DataFrame) -> tuple[str, str]:
        """Merge-anti-joins the first places of a batch with every run and adds the rest as a run."""
        for name, _ in self.all():
            firsts = firsts.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        with settings(self.spark, ORDERED):
            run = self._write(firsts)
        self.levels[0].append(run)
        self._publish()
        return run

    def compact(self) -> None:
        """Full levels become one run of the next."""
        level = 0
        while len(self.levels[level]) >= FANOUT:
            old = self.levels[level]
            merged = self.spark.table(old[0][0])
            for name, _ in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            self.levels[level] = []
            self._publish()
            for name, path in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                drop_table(self.spark, path)
            level += 1

    def close(self) -> list[str]:
        """The tables leave the catalog; their files, whose paths it gives, stay."""
        for name, _ in self.all():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return [path for _, path in self.all()]


def batch_edges(docs: DataFrame, batches: int) -> list:
    """Up to batches - 1 values of doc_id that cut the table in ranges of about equal size, from the SAMPLE rows of least random number."""
    if batches < 2:
        return []
    sample = docs.where("doc_id is not null").select("doc_id", F.rand(7).alias("r")).orderBy("r").limit(SAMPLE).select("doc_id")
    ids = [r[0] for r in sample.orderBy("doc_id").collect()]
    return sorted({ids[len(ids) * i // batches] for i in range(1, batches)}) if ids else []


def line_hashes(docs: DataFrame, batches: int) -> DataFrame:
    """(h1, h2, doc_id, key, line_no, batch) of every non-blank line."""
    batch = F.lit(0)
    for e in batch_edges(docs, batches):
        batch = batch + F.when(F.col("doc_id") > F.lit(e), 1).otherwise(0)
    lines = docs.select("doc_id", text_key().alias("key"), batch.alias("batch"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length(F.trim("line")) > 0)
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), *PLACE, "batch")


def first_of(lines: DataFrame) -> DataFrame:
    """The first place of each line of a batch."""
    return lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("p")).select("h1", "h2", "p.*")


def first_places(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, key, line_no) of the lines that stay."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    hashed = line_hashes(docs, batches)
    hashed.write.partitionBy("batch").parquet(path)
    table, runs = spark.read.schema(hashed.schema).parquet(path), LineRuns(spark, partitions_for(docs))
    for b in range(batches):
        runs.insert(first_of(table.where(F.col("batch") == b)))
        runs.compact()
    drop_table(spark, path)
    schema = spark.table(runs.all()[0][0]).schema
    return spark.read.schema(schema).parquet(*runs.close()).select(*PLACE)


def deduplicate(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with the lines that occurred before taken out of their text, without documents that lost all."""
    return with_lines(docs, first_places(docs, batches))


def add_batch(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """The same for a batch that comes after all those added to runs: lines that these had go too. The result is written before the runs are compacted."""
    name, _ = runs.insert(first_of(line_hashes(docs, 1).drop("batch")))
    with settings(docs.sparkSession, SMALL_BATCHES):
        left = materialise(with_lines(docs, docs.sparkSession.table(name).select(*PLACE)), "batch")
    runs.compact()
    return left


def with_lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with only the lines at places, and blank ones, in their text; without documents that had other lines and keep none."""
    keep = places.groupBy("doc_id", "key").agg(F.collect_list("line_no").alias("__keep")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__kept_key"), "__keep")
    columns = docs.columns
    docs, back = set_aside(docs)
    marked = docs.withColumn("__key", text_key())
    joined = marked.join(keep, marked["doc_id"].eqNullSafe(keep["__id"]) & (marked["__key"] == keep["__kept_key"]), "left").select(*docs.columns, "__keep")

    names = docs.columns

    def run(rows):
        for batch in rows:
            texts, use, out = batch.column("text").to_pylist(), [], []
            for text, keep in zip(texts, batch.column("__keep").to_pylist()):
                if text is None or not text.strip(" \n"):
                    use.append(True)
                    out.append(text)
                    continue
                lines, wanted = text.split("\n"), set(keep or ())
                left = lines if len(wanted) == len(lines) else [x for i, x in enumerate(lines) if i in wanted or not x.strip(" ")]
                use.append(bool(wanted))
                out.append("\n".join(left))
            columns = [pa.array(out, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(use, pa.bool_()))

    return back(joined.mapInArrow(run, docs.schema)).select(columns)


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS place, trim(line, ' ') = '' AS blank FROM lines
)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n_lines
FROM placed WHERE place = 1 OR blank
GROUP BY doc_id
HAVING count(*) FILTER (WHERE NOT blank) > 0 OR doc_id NOT IN (SELECT doc_id FROM placed WHERE NOT blank)
"""
