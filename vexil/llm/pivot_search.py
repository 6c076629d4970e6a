"""Exact top-k search by pivot-table elimination: for stated queries among the vectors their k nearest others by Euclidean distance.

Pivots are chosen from a bounded sample, each as far as can be from those before it; they bear on speed only. Every
vector gets its distances to all pivots, the pivot table. By the triangle inequality the greatest difference of two
rows of that table is a lower bound of the distance of the two vectors. Vectors lie in blocks of neighbours (by nearest
pivot, cut into at most BLOCK rows or BLOCK_BYTES), each with the range of its pivot distances.

First each block is searched for the queries among its own rows, which gives every query a distance within which its k
nearest must lie. Then the queries, in chunks of at most QUERY_BYTES, are broadcast and meet the blocks where these are
read: nothing of the size of the table is shuffled, and no pairs of blocks are planned or joined. A block whose ranges
keep it farther from a query than that query's k-th best is passed over; of the others each query's candidates are
evaluated in order of their bounds until the next bound exceeds the k-th best distance, which a task carries along from
block to block. Whatever is skipped is farther than k others: the result is exact. A task gives at most k rows a query,
and these are merged by rank. The work is that of queries times rows, less what bounds eliminate; vectors without
structure leave little to eliminate, and then a pair costs one product of the two vectors.

Bounds are in single precision and allow for its rounding by SLACK of the largest pivot distance. Candidates that the
bounds leave are compared first by products of vectors less the pivots' mean, within that form's rounding error, and
distances are computed in double precision from differences, so that they are exact far from the origin too. Ties go to
the lower vec_id.

Defined results: a vector is no neighbour of itself, but a row that repeats it (same vec_id too) is one, at distance 0.
Null vectors, vectors with a null or non-finite element, of another dimension than the most common one, or with a null
id are left out, as queries and as candidates. With k or fewer others, all are returned. No vectors, no queries or k
below 1 give no rows. Other columns are ignored. There are no texts here; vectors of any length are compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexil.llm.common import materialise, partitions_for

K, PIVOTS, SAMPLE, BLOCK, CHUNK = 10, 32, 2000, 2048, 64
#: Bytes of a block's vectors, of the queries that are broadcast at once, and bounds that are held at once.
BLOCK_BYTES, QUERY_BYTES, MOST_BOUNDS = 8 << 20, 32 << 20, 1 << 21
SLACK = 1e-6
NO_ID = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_column: str, vector_column: str, asked: Column) -> DataFrame:
    """(id, v, asked) of the rows that take part."""
    good = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select(F.col("n").alias("dim"))
    return good.join(F.broadcast(sizes), F.size("v") == F.col("dim")).select("id", "v", "asked")  # sizes is one row


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """The farthest point from the mean, then always the one farthest from its nearest pivot."""
    if not len(sample):
        return sample
    nearest = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    out = []
    for i in range(min(pivots, len(sample))):
        pick = int(nearest.argmax())
        out.append(sample[pick])
        own = ((sample - sample[pick]) ** 2).sum(axis=1)
        nearest = own if i == 0 else np.minimum(nearest, own)
        if nearest.max() == 0:
            break
    return np.array(out)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of rows of a and b, from differences, so that they are the same wherever they are computed."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


class Nearest:
    """The k nearest so far of each query: distances and ids, sorted by both. limit is a distance within which the k nearest of each lie."""

    def __init__(self, queries: np.ndarray, pivots: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.q, self.pivots, self.k = queries, pivots, k
        self.d, self.i = np.full((len(queries), k), np.inf), np.full((len(queries), k), NO_ID)
        self.limit = np.full(len(queries), np.inf) if limit is None else limit.copy()

    def add(self, rows: np.ndarray, columns: np.ndarray, candidates: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (pairs of query row and candidate column) that may be among the nearest."""
        d = np.sqrt(((self.q[rows] - candidates[columns]) ** 2).sum(axis=1))
        keep = d <= self.limit[rows]
        rows, d, i = rows[keep], d[keep], ids[columns[keep]]
        if not len(rows):
            return
        hit = np.unique(rows)
        r = np.concatenate([np.repeat(hit, self.k), rows])
        d, i = np.concatenate([self.d[hit].ravel(), d]), np.concatenate([self.i[hit].ravel(), i])
        order = np.lexsort((i, d, r))
        r, d, i = r[order], d[order], i[order]
        take = (np.searchsorted(r, hit)[:, None] + np.arange(self.k)).ravel()
        self.d[hit], self.i[hit] = d[take].reshape(-1, self.k), i[take].reshape(-1, self.k)
        self.limit[hit] = np.minimum(self.limit[hit], self.d[hit, -1])


def search_block(near: Nearest, c: np.ndarray, ids: np.ndarray, c_pivots: np.ndarray, centre: np.ndarray, rows: np.ndarray, own: np.ndarray | None = None) -> None:
    """Searches a block of candidates for the queries rows; own has the column of each query that is the query itself."""
    if not len(c) or not len(rows):
        return
    slack = SLACK * (1 + float(max(near.pivots[rows].max(), c_pivots.max())))
    low, high = c_pivots.min(axis=0), c_pivots.max(axis=0)
    away = np.maximum(low - near.pivots[rows], near.pivots[rows] - high).max(axis=1)
    use = np.flatnonzero(away <= near.limit[rows] + slack)
    moved = c - centre
    squares = (moved**2).sum(axis=1)
    columns = np.ascontiguousarray(c_pivots.T)
    step = max(1, MOST_BOUNDS // len(c))
    for s in range(0, len(use), step):
        at = use[s : s + step]
        r = rows[at]
        bound, gap = np.zeros((len(r), len(c)), np.float32), np.empty((len(r), len(c)), np.float32)
        for mine, theirs in zip(near.pivots[r].T, columns):
            np.subtract(mine[:, None], theirs[None], out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        if own is not None:
            bound[np.arange(len(r)), own[at]] = np.inf
        within = near.limit[r] + slack
        bound[bound > within[:, None]] = np.inf
        shift = near.q[r] - centre
        d = (shift**2).sum(axis=1)[:, None] + squares - 2 * (shift @ moved.T)
        error = 1e-15 * (c.shape[1] + 8) * ((shift**2).sum(axis=1)[:, None] + squares)
        d -= error
        if len(c) > near.k and np.isinf(within).any():  # no limit yet: the k-th of this block is one
            d[np.isinf(bound)] = np.inf
            kth = np.partition(d + 2 * error, near.k - 1, axis=1)[:, near.k - 1]
            within = np.minimum(within, np.sqrt(np.maximum(kth, 0)) + slack)
        bound[d > (within**2)[:, None]] = np.inf
        order = np.argsort(bound, axis=1, kind="stable")
        most = int(np.isfinite(bound).sum(axis=1).max())
        for first in range(0, most, CHUNK):
            part = order[:, first : first + CHUNK]
            b = np.take_along_axis(bound, part, axis=1)
            i, j = np.nonzero(b <= np.minimum(near.limit[r] + slack, np.finfo(np.float32).max)[:, None])
            if not len(i):
                break  # every query's next bound exceeds its k-th best
            near.add(r[i], part[i, j], c, ids)


def _matrix(x: bytes, rows: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(x, kind).reshape(rows, -1)


def blocks_of(rows: DataFrame, pivots: np.ndarray, block: int, partitions: int) -> DataFrame:
    """A row for each block: its number, packed ids, marks of the queries, vectors and pivot distances."""

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                cell = distances(v, pivots).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("asked"), pa.array(cell)], ["id", "v", "asked", "cell"])

    def full(batches):
        """Runs of block rows, whatever the size of the batches."""
        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= block:
                yield pa.Table.from_batches([*held, batch.slice(0, block - n)])
                batch, held, n = batch.slice(block - n), [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield pa.Table.from_batches(held)

    def pack(batches):
        for part in full(batches):
            v = np.ascontiguousarray(part.column("v").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1))
            p = distances(v, pivots).astype(np.float32)
            asked = part.column("asked").to_numpy().astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), *[pa.array([x.tobytes()], pa.binary()) for x in (part.column("id").to_numpy(), asked, v, p)]], ["n", "ids", "asked", "vectors", "pivots"])

    celled = rows.mapInArrow(cells, "id long, v array<double>, asked boolean, cell int")
    ordered = celled.repartitionByRange(partitions, "cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")
    packed = ordered.mapInArrow(pack, "n long, ids binary, asked binary, vectors binary, pivots binary")
    return materialise(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def own_blocks(table: DataFrame, centre: np.ndarray, k: int) -> DataFrame:
    """(block, m, ids, vectors, pivots, d, i): the queries of each block that has any, with the k nearest within the block."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                asked = np.flatnonzero(np.frombuffer(r["asked"], np.uint8))
                if not len(asked):
                    continue
                v, p, ids = _matrix(r["vectors"], r["n"]), _matrix(r["pivots"], r["n"], np.float32), np.frombuffer(r["ids"], np.int64)
                near = Nearest(v[asked], p[asked], k)
                search_block(near, v, ids, p, centre, np.arange(len(asked)), asked)
                packed = (ids[asked], near.q, near.pivots, near.d, near.i)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([len(asked)]), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in packed]], names)

    names = ["block", "m", "ids", "vectors", "pivots", "d", "i"]
    return materialise(table.mapInArrow(run, "block long, m long, ids binary, vectors binary, pivots binary, d binary, i binary"), "queries")


def other_blocks(table: DataFrame, queries: DataFrame, blocks: list[int], centre: np.ndarray, k: int) -> DataFrame:
    """(block, row, neighbour_id, d) of the queries of some blocks, at most k a query and task: what may be nearer than the k nearest of the own block."""
    found = queries.where(F.col("block").between(blocks[0], blocks[-1])).select("block", "m", "vectors", "pivots", "d").toArrow().to_pylist()
    home = np.repeat([r["block"] for r in found], [r["m"] for r in found])
    row = np.concatenate([np.arange(r["m"]) for r in found])
    parts = [np.concatenate([_matrix(r[c], r["m"], kind) for r in found]) for c, kind in (("vectors", np.float64), ("pivots", np.float32), ("d", np.float64))]
    shared = table.sparkSession.sparkContext.broadcast((home, row, parts[0], parts[1], np.ascontiguousarray(parts[2][:, -1])))

    def run(batches):
        home, row, q, p, limit = shared.value
        near = Nearest(q, p, k, limit)
        for batch in batches:
            for r in batch.to_pylist():
                search_block(near, _matrix(r["vectors"], r["n"]), np.frombuffer(r["ids"], np.int64), _matrix(r["pivots"], r["n"], np.float32), centre, np.flatnonzero(home != r["block"]))
        i, j = np.nonzero(np.isfinite(near.d))
        yield pa.RecordBatch.from_arrays([pa.array(home[i]), pa.array(row[i].astype(np.int32)), pa.array(near.i[i, j]), pa.array(near.d[i, j])], ["block", "row", "neighbour_id", "d"])

    return table.select("block", "n", "ids", "vectors", "pivots").mapInArrow(run, "block long, row int, neighbour_id long, d double")


def nearest_neighbours(vectors: DataFrame, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", asked: Column | None = None, pivots: int = PIVOTS, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance) of the k nearest others of every vector for which asked holds (all of them without it); distance rounded to 6 digits, rank from 1."""
    spark = vectors.sparkSession
    schema = f"{id_column} long, neighbour_id long, rank int, distance double"
    rows = usable(vectors, id_column, vector_column, F.lit(True) if asked is None else asked)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], dtype=float)
    if not len(sample) or k < 1:
        return spark.createDataFrame([], schema)
    chosen = choose_pivots(sample, pivots)
    centre, width = chosen.mean(axis=0), chosen.shape[1]
    table = blocks_of(rows, chosen, max(1, min(block, BLOCK_BYTES // (8 * width))), partitions_for(vectors))
    queries = own_blocks(table, centre, k)

    def listed(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d = _matrix(r["d"], r["m"])
                i, j = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r["block"])), pa.array(i.astype(np.int32)), pa.array(_matrix(r["i"], r["m"], np.int64)[i, j]), pa.array(d[i, j])], ["block", "row", "neighbour_id", "d"])

    found = queries.select("block", "m", "d", "i").mapInArrow(listed, "block long, row int, neighbour_id long, d double")
    each = 8 * width + 4 * len(chosen) + 8 * k + 40
    chunk, size = [], 0
    for r in queries.select("block", "m").orderBy("block").toLocalIterator():  # a pair of numbers for each block
        if chunk and size + r.m * each > query_bytes:
            found = found.unionByName(other_blocks(table, queries, chunk, centre, k))
            chunk, size = [], 0
        chunk.append(r.block)
        size += r.m * each
    if chunk:
        found = found.unionByName(other_blocks(table, queries, chunk, centre, k))
    nearest = Window.partitionBy("block", "row").orderBy("d", "neighbour_id")
    best = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    def names(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(r["m"], r["block"])), pa.array(np.arange(r["m"], dtype=np.int32)), pa.array(np.frombuffer(r["ids"], np.int64))], ["block", "row", "id"])

    who = queries.select("block", "m", "ids").mapInArrow(names, "block long, row int, id long")
    return best.join(who, ["block", "row"]).select(F.col("id").alias(id_column), "neighbour_id", "rank", F.round("d", 6).alias("distance"))


SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS rank FROM pairs
)
SELECT vec_id, neighbour_id, rank::INTEGER AS rank, round(d, 6) AS distance FROM ranked WHERE rank <= {K}
"""
