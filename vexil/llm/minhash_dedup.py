"""MinHash near-dedup with b-bit signatures.

Words (folded, without punctuation) make shingles of SHINGLE words, each a 32-bit hash. HASHES random linear maps give as
many minima; ROWS minima make a band, whose hash is a bucket. Of each minimum only the low BITS bits are kept, packed to
HASHES * BITS / 8 bytes a document. Documents that share a bucket are candidates; their similarity is estimated by
counting equal fields by bit counts and correcting for chance: (equal / HASHES - 2**-BITS) / (1 - 2**-BITS). Candidates
at or above the threshold are joined, and the connected components are the groups.

Documents of equal minima (exact copies above all) are one node from the start, so thousands of copies cost no pairs.
Equal buckets of several bands are compared once. A bucket of more than CHUNK nodes is compared chunk by chunk against
itself, in as many tasks as it has pairs of chunks: no pair is left out.

Defined results: a null text counts as empty; a text without words is never a copy, and all its rows stay. A text of
fewer words than a shingle is one shingle; texts of any length are read whole. Rows that are equal in doc_id and text
are copies of each other; rows with equal doc_id and other text are documents of their own. The row with the least
(doc_id, text hash) of a group stays, a null doc_id before others. Capitals of all alphabets count as small letters. An
empty table gives no rows. Other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vexil.llm.common import SMALL_BATCHES, U64, WORDS, documents_of, materialise, mix, set_aside, settings, string_buffers, sub_batches, text_key, token_hashes
from vexil.llm.components import connected_components

SHINGLE, HASHES, ROWS, BITS = 3, 256, 4, 2
THRESHOLD = 0.4
CHUNK = 2048
_rng = np.random.default_rng(20240229)
SLOPES = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
FIELDS = U64(0x5555555555555555)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of each document, and the n + 1 offsets."""
    h, at = token_hashes(data, offsets, WORDS, fold=True)
    doc, words = documents_of(at), np.diff(at)
    n = np.where(words == 0, 0, np.maximum(words - SHINGLE + 1, 1))
    x = h.copy()
    for i in range(1, SHINGLE):
        same = doc[:-i] == doc[i:]
        x[:-i] += np.where(same, h[i:] * U64(2 * i + 1), U64(0))
    first = np.arange(len(h)) - np.repeat(at[:-1], words)
    return (mix(x[first < np.repeat(n, words)]) >> U64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(n)])


def minima(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of HASHES minima for each document that has a shingle."""
    starts = at[:-1][np.diff(at) > 0]
    out, v = np.empty((HASHES, len(starts)), dtype=np.uint32), np.empty_like(x)
    for i in range(HASHES):
        np.multiply(x, SLOPES[i], out=v)
        np.add(v, SHIFTS[i], out=v)
        np.minimum.reduceat(v, starts, out=out[i])
    return np.ascontiguousarray(out.T)


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each (remixed) minimum, as unsigned 64-bit words."""
    low = (mix(m.astype(U64)) & U64((1 << BITS) - 1)).reshape(len(m), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=U64) * U64(BITS))).sum(axis=2, dtype=U64)


def bands(m: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band; the number of the band is part of it."""
    x = m.astype(U64).reshape(len(m), -1, ROWS)
    key = np.broadcast_to(np.arange(1, x.shape[1] + 1, dtype=U64), x.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + x[:, :, i])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures, corrected for fields that agree by chance."""
    x = a ^ b
    for i in range(1, BITS):
        x = x | ((a ^ b) >> U64(i))
    field = U64(sum(1 << i for i in range(0, 64, BITS)))
    equal = 1 - np.bitwise_count(x & field).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, signature, buckets) of each document that has a word."""
    source = docs.select("doc_id", text_key().alias("key"), F.lower("text").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            batch = batch.select(["doc_id", "key"])
            for a, b in sub_batches(offsets):
                x, at = shingles(data, offsets[a : b + 1])
                has = np.flatnonzero(np.diff(at) > 0)
                if not len(has):
                    continue
                m = minima(x, at)
                key, low = bands(m), pack(m)
                node = mix((key * (np.arange(key.shape[1], dtype=U64) * U64(2) + U64(1))).sum(axis=1, dtype=U64))
                part = batch.slice(a, b - a).take(pa.array(has))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(node.view(np.int64)), pa.array([r.tobytes() for r in low], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * key.shape[1]), pa.array(key.view(np.int64).ravel()))],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def _runs(batches, key: str):
    """Sorted batches as (keys, table) with no key cut in two."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        rest = t.slice(cut)
        if cut:
            yield k[:cut], t.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest.column(key).to_numpy(), rest


def candidate_sets(nodes: DataFrame) -> DataFrame:
    """(set, node): the distinct buckets of two nodes or more, the large ones as pairs of chunks."""

    def run(batches):
        seen: set[int] = set()
        for k, t in _runs(batches, "bucket"):
            node = t.column("node").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(starts, len(k)))
            names, members = [], []
            marks = np.add.reduceat(mix(node.view(U64)), starts)  # the sum doesn't depend on the order
            for s, n, mark in zip(starts[sizes > 1], sizes[sizes > 1], marks[sizes > 1]):
                if int(mark) in seen:
                    continue
                seen.add(int(mark))
                own = node[s : s + n]
                if n <= 2 * CHUNK:
                    names.append(np.full(n, mark))
                    members.append(own)
                else:
                    own = np.sort(own)
                    chunks = [own[i : i + CHUNK] for i in range(0, n, CHUNK)]
                    for i in range(len(chunks)):
                        for j in range(i + 1, len(chunks)):
                            both = np.concatenate([chunks[i], chunks[j]])
                            names.append(np.full(len(both), mix(np.array([mark + U64(i * 1_000_003 + j + 1)]))[0]))
                            members.append(both)
                if sum(map(len, names[-1:])) and len(names) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(members))], ["set", "node"])
                    names, members = [], []
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(members))], ["set", "node"])
            if len(seen) > 1_000_000:
                seen.clear()

    exploded = nodes.select("node", F.explode("buckets").alias("bucket"))
    return exploded.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "set long, node long").distinct()


def tree_edges(node: np.ndarray, sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of all pairs at or above the threshold; all pairs are seen, until connected."""
    rest, edges = np.arange(len(node)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = estimate(sig[rest], sig[i]) >= threshold
            if near.any():
                edges += [(int(node[i]), int(node[j])) for j in rest[near]]
                queue += rest[near].tolist()
                rest = rest[~near]
    return edges


def verified_edges(sets: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of candidates whose estimated similarity is the threshold at least; of each set a spanning forest."""

    def run(batches):
        for k, t in _runs(batches, "set"):
            node = t.column("node").to_numpy()
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), U64).reshape(len(node), -1)
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(starts, len(k)))
            two = starts[sizes == 2]
            near = two[estimate(sig[two], sig[two + 1]) >= threshold]
            edges = [np.stack([node[near], node[near + 1]], axis=1)]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                if found := tree_edges(node[s : s + n], sig[s : s + n], threshold):
                    edges.append(np.array(found))
            e = np.concatenate(edges)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["u", "v"])

    return sets.join(nodes.select("node", "signature"), "node").repartition("set").sortWithinPartitions("set").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, copies, node, root) of all documents with words, and the signatures by node."""
    with settings(docs.sparkSession, SMALL_BATCHES):
        signed = materialise(signatures(docs), "signatures")
    nodes = signed.groupBy("node").agg(F.first("signature").alias("signature"), F.first("buckets").alias("buckets"))
    roots = connected_components(verified_edges(candidate_sets(nodes), nodes, threshold))
    rows = signed.groupBy("doc_id", "key", "node").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), signed


def _removed(rows: DataFrame) -> DataFrame:
    """Of groups of two rows or more, each document with its keeper; a keeper only where its own row is repeated."""
    first = F.min(F.struct("doc_id", "key", "node"))
    keepers = rows.groupBy("root").agg(first.alias("k"), F.sum("copies").alias("n")).where("n > 1").select("root", F.col("k.doc_id").alias("keeper_id"), F.col("k.key").alias("keeper_key"), F.col("k.node").alias("keeper_node"))
    same = F.col("doc_id").eqNullSafe(F.col("keeper_id")) & (F.col("key") == F.col("keeper_key"))
    return rows.join(keepers, "root").where(~same | (F.col("copies") > 1)).withColumn("is_keeper", same)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keeper_id, similarity) of each document that goes; similarity is the estimate against the keeper, which may lie below the threshold where a chain of copies leads to it."""
    rows, signed = groups(docs, threshold)
    gone = _removed(rows)
    by_node = signed.groupBy("node").agg(F.first("signature").alias("signature"))
    pairs = gone.join(by_node, "node").join(by_node.select(F.col("node").alias("keeper_node"), F.col("signature").alias("keeper_signature")), "keeper_node")

    @F.pandas_udf("double")
    def similarity(a, b):
        x, y = (np.frombuffer(b"".join(s), U64).reshape(len(s), -1) for s in (a, b))
        import pandas as pd

        return pd.Series(np.round(estimate(x, y), 4))

    return pairs.select("doc_id", "keeper_id", similarity("signature", "keeper_signature").alias("similarity"))


def _identity(id: str = "doc_id", key: str = "__key") -> list:
    """Columns without nulls that tell rows apart, so that a join and a window on them share one shuffle."""
    return [F.coalesce(F.col(id).cast("string"), F.lit("")).alias("__i"), F.col(id).isNull().alias("__null"), F.col(key).alias("__k")]


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that near_duplicates names: one row of each group stays, with all its columns.

    Texts are shuffled once, by what tells rows apart: the marks of rows that go, or that are repeated, are joined there
    and of repeated rows the first is taken.
    """
    rows, _ = groups(docs, threshold)
    marks = _removed(rows).select(*_identity("doc_id", "key"), F.col("is_keeper").alias("__once"))
    columns = docs.columns
    docs, back = set_aside(docs)
    names, same = docs.columns, ["__i", "__null", "__k"]
    marked = docs.withColumn("__key", text_key()).select("*", *_identity()).join(marks, same, "left")
    left = marked.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy("__k"))).where("__once is null or __once and __n = 1")
    return left.select(names).transform(back).select(columns)
