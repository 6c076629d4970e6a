"""Exact search: one query, many queries, and centroids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vexil.functions import vectors as V
from vexil.operators import kmeans

TOP_K = 10
#: Queries of at most so many values are broadcast and centroids too; more queries meet the rows by blocks.
BROADCAST_VALUES = 4_000_000
#: Queries are broadcast only if they are at most so many, as a task keeps the best of each.
BROADCAST_QUERIES = 1000
#: Rows and queries of a block, and scores held at once.
BLOCK_ROWS, BLOCK_SCORES = 16_384, 8_000_000


def score(vector: Column | str, query: Column | str, metric: str) -> Column:
    """dot is raw, without scaling; cosine is 0 for vectors without length."""
    if metric not in ("dot", "cosine"):
        raise ValueError(f"no such metric: {metric}")
    return V.finite_score(V.dot(vector, query) if metric == "dot" else V.cosine(vector, query))


def search_exact(vectors: DataFrame, query: Sequence[float], k: int = TOP_K, metric: str = "dot", id_column: str = "embedding_id", vector_column: str = "vector") -> DataFrame:
    """(id, score): the k best, score falling, id rising. k < 1, no rows or a query of another dimension give no rows; vectors of another dimension are passed over."""
    if k < 1:
        return vectors.select(id_column, F.lit(0.0).alias("score")).limit(0)
    fitting = vectors.where(V.has_dimension(vector_column, len(query)))
    return fitting.select(id_column, score(vector_column, V.literal_vector(query), metric).alias("score")).orderBy(F.desc("score"), F.asc(id_column)).limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, metric: str = "dot", id_column: str = "embedding_id", vector_column: str = "vector") -> DataFrame:
    """(query_id, id, score, rank) for queries(query_id, query). Few queries are broadcast: each task keeps the k best of its rows for each, by matrix product. Many meet the rows by pairs of blocks. The best are merged by rank."""
    if k < 1:
        return vectors.crossJoin(queries.limit(0)).select("query_id", id_column, F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    if metric not in ("dot", "cosine"):
        raise ValueError(f"no such metric: {metric}")
    queries = queries.where("query is not null")
    n, values = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("query")), F.lit(0))).first()
    if n > BROADCAST_QUERIES or values > BROADCAST_VALUES:
        scored = _by_blocks(vectors, queries, n, k, metric, id_column, vector_column)
    else:
        rows = queries.select("query_id", V.doubles("query").alias("query")).toArrow()
        ids, q = rows.column("query_id").to_pylist(), rows.column("query").to_pylist()
        dims = sorted({len(x) for x in q})
        groups = {n: ([i for i, x in zip(ids, q) if len(x) == n], np.array([x for x in q if len(x) == n])) for n in dims}
        shared = vectors.sparkSession.sparkContext.broadcast(groups)

        def run(batches):
            best: dict = {}
            for batch in batches:
                lists, own = batch.column(vector_column), batch.column(id_column).to_numpy(zero_copy_only=False)
                sizes = np.diff(lists.offsets.to_numpy())
                flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
                for n, (names, matrix) in shared.value.items():
                    pick = np.flatnonzero(sizes == n)
                    if not len(pick):
                        continue
                    pick = pick[np.argsort(own[pick], kind="stable")]
                    x = flat[(starts[pick][:, None] + np.arange(n)).ravel()].reshape(-1, n)
                    i, j, score = _best_of(matrix, x, k, metric, BLOCK_SCORES)
                    for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
                        name = names[int(i[at[0]])]
                        best[name] = sorted([*best.get(name, []), *zip((-score[at]).tolist(), own[pick[j[at].astype(int)]].tolist())])[:k]
            out = [(name, i, -d) for name, found in best.items() for d, i in found]
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", id_column, "score"])

        usable = vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).cast("long").alias(id_column), vector_column)
        scored = usable.mapInArrow(run, f"query_id long, {id_column} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_column))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of(q: np.ndarray, x: np.ndarray, k: int, metric: str, most: int) -> np.ndarray:
    """Places of queries, places of rows and scores of the k best rows x of each query q, which settle ties by their place. Few queries are taken at a time, so that their scores, the copies of them and the masks are most values together."""
    found, (ql, xl) = [np.zeros((3, 0))], (np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
    for start in range(0, len(q) if x.size else 0, step := max(1, most // (4 * max(1, len(x))))):
        s = q[start : start + step] @ x.T
        if metric == "cosine":
            lengths = ql[start : start + step, None] * xl[None]
            s = np.where(lengths > 0, s / np.where(lengths > 0, lengths, 1), 0)
        s[~np.isfinite(s)] = -np.inf
        least = np.partition(s, len(x) - min(k, len(x)), axis=1)[:, len(x) - min(k, len(x))]
        # products of equal rows may differ by rounding: all near the k-th are scored again, each in the same way
        with np.errstate(invalid="ignore"):
            close = s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
        close |= np.isneginf(least)[:, None]
        i, j = np.nonzero(close)
        for at in range(0, len(i), 10_000):
            own, other = i[at : at + 10_000] + start, j[at : at + 10_000]
            exact = (q[own] * x[other]).sum(axis=1)
            if metric == "cosine":
                lengths = ql[own] * xl[other]
                exact = np.where(lengths > 0, exact / np.where(lengths > 0, lengths, 1), 0)
            s[own - start, other] = np.where(np.isfinite(exact), exact, -np.inf)
        order = np.lexsort((j, -s[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        found.append(np.array([i + start, j, s[i, j]]))
    return np.concatenate(found, axis=1)


def _by_blocks(vectors: DataFrame, queries: DataFrame, n_queries: int, k: int, metric: str, id_column: str, vector_column: str) -> DataFrame:
    """(query_id, id, score): the k best of each block of rows for each query. Rows and queries of a dimension are cut into blocks by hash; each pair of blocks is a group."""
    usable = vectors.where(F.col(vector_column).isNotNull())
    row_blocks, query_blocks = max(1, -(-usable.count() // BLOCK_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))
    block = lambda column, blocks: F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select(F.size("query").alias("__n"), block("query_id", query_blocks).alias("__q"), every(row_blocks).alias("__r"), F.col("query_id").alias("a"), V.doubles("query").alias("x"))
    right = usable.select(F.size(vector_column).alias("__n"), every(query_blocks).alias("__q"), block(id_column, row_blocks).alias("__r"), F.col(id_column).alias("b"), V.doubles(vector_column).alias("y"))
    schema = T.StructType([T.StructField("query_id", left.schema["a"].dataType), T.StructField(id_column, right.schema["b"].dataType), T.StructField("score", T.DoubleType())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def best(one: pa.Table, two: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0))]
        if one.num_rows and two.num_rows:
            two = two.sort_by("b")  # places follow the ids, so that they settle ties
            q, x = matrix(one.column("x")), matrix(two.column("y"))
            found.append(_best_of(q, x, k, metric, BLOCK_SCORES))
        i, j, s = np.concatenate(found, axis=1)
        return pa.Table.from_arrays([one.column("a").take(pa.array(i.astype(np.int64))), two.column("b").take(pa.array(j.astype(np.int64))), pa.array(s)], names=schema.names)

    keys = ["__n", "__q", "__r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)


def top_centroids(vectors: DataFrame, centroids: DataFrame, m: int = 2, id_column: str = "embedding_id", vector_column: str = "vector") -> DataFrame:
    """(id, top): the m centroids of highest dot product in order, the lower number first among equals."""
    return _best_centroids(vectors, centroids, m, id_column, vector_column).select(id_column, F.col("cids").alias("top"))


def _best_centroids(vectors: DataFrame, centroids: DataFrame, m: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, cids, scores) by matrix products where the rows are. centroids(cid, centroid) of at most BROADCAST_VALUES are broadcast; more of them are the rows and the vectors the queries of a search by blocks."""
    n, values = centroids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()
    rows = vectors.where(F.col(vector_column).isNotNull())
    if values > BROADCAST_VALUES:
        found = search_many(centroids, rows.select(F.col(id_column).alias("query_id"), F.col(vector_column).alias("query")), m, "dot", "cid", "centroid")
        lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "cid", "score"))).alias("l"))
        return lists.select(F.col("query_id").alias(id_column), F.transform("l", lambda x: x["cid"]).alias("cids"), F.transform("l", lambda x: x["score"]).alias("scores"))
    if not n:
        return rows.select(id_column, F.lit(None).cast("array<long>").alias("cids"), F.lit(None).cast("array<double>").alias("scores")).limit(0)
    table = centroids.select("cid", V.doubles("centroid").alias("c")).toArrow().sort_by("cid")
    shared = vectors.sparkSession.sparkContext.broadcast((table.column("cid").to_numpy(), np.array(table.column("c").to_pylist())))

    def run(batches):
        cids, c = shared.value
        width = min(m, len(cids))
        for b in batches:
            if b.num_rows:
                x = b.column(vector_column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                s = x @ c.T
                top = np.argsort(-s, axis=1, kind="stable")[:, :width]
                lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, width, dtype=np.int32), pa.array(np.ascontiguousarray(a).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(id_column), lists(cids[top]), lists(np.take_along_axis(s, top, 1))], [id_column, "cids", "scores"])

    schema = T.StructType([rows.schema[id_column], T.StructField("cids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return rows.select(id_column, vector_column).mapInArrow(run, schema)


def top_label(vectors: DataFrame, centroids: DataFrame, id_column: str = "embedding_id", vector_column: str = "vector") -> DataFrame:
    """(id, cid, score): the best centroid by dot product."""
    best = _best_centroids(vectors, centroids, 1, id_column, vector_column)
    return best.select(id_column, F.col("cids")[0].alias("cid"), F.col("scores")[0].alias("score"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, id_column: str = "embedding_id", vector_column: str = "vector") -> DataFrame:
    """(id, cid, distance): the nearest centroid by squared distance, the lower number among equals. Up to BROADCAST_VALUES it is a k-means assignment where the rows are; beyond, as of |x - c|^2 only x c - |c|^2 / 2 depends on c in a way that matters, a search by blocks for the best product."""
    n, values = centroids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()
    rows = vectors.where(F.col(vector_column).isNotNull())
    if not n or values > BROADCAST_VALUES:
        longer = rows.select(id_column, F.concat(V.doubles(vector_column), F.array(F.lit(1.0))).alias(vector_column))
        half = F.array(-V.dot("centroid", "centroid") / 2)
        best = _best_centroids(longer, centroids.select("cid", F.concat(V.doubles("centroid"), half).alias("centroid")), 1, id_column, vector_column)
        joined = best.select(id_column, F.col("cids")[0].alias("cid")).join(rows.select(id_column, vector_column), id_column).join(centroids.select("cid", "centroid"), "cid")
        return joined.select(id_column, "cid", V.squared_distance(vector_column, "centroid").alias("distance"))
    table = centroids.select("cid", V.doubles("centroid").alias("c")).toArrow().sort_by("cid")
    shared = vectors.sparkSession.sparkContext.broadcast((table.column("cid").to_numpy(), np.array(table.column("c").to_pylist())))

    def run(batches):
        cids, c = shared.value
        for b in batches:
            if b.num_rows:
                pick, d = kmeans.assign(kmeans.matrix(b.column(vector_column)), c)
                yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array(cids[pick]), pa.array(d)], [id_column, "cid", "distance"])

    return rows.select(id_column, vector_column).mapInArrow(run, T.StructType([rows.schema[id_column], T.StructField("cid", T.LongType()), T.StructField("distance", T.DoubleType())]))


def sanity(vectors: DataFrame, query: Sequence[float], **columns: str) -> bool:
    """Whether a search of the 5 best finds anything."""
    return bool(search_exact(vectors, query, 5, **columns).take(1))
