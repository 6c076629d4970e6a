"""Deterministic k-means and the choice of k.

Vectors lie in a table (id, vector); row order is id order. A Lloyd step is one pass: each task assigns its rows by matrix
products and adds them up by cluster, the sums of a cluster are merged where its number hashes to, and only k rows reach
the driver. Several clusterings (of different k, say) take their steps in the same pass. Centroids (k x dimension) travel
as a broadcast of that size, checked against MOST_VALUES.

Empty tables give no rows. Ties between centroids go to the lower number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.operators.order import with_position
from vexil.storage import materialise

MOST_VALUES = 64_000_000
#: Groups of at most so many values are clustered within one task, larger ones by passes over the cluster.
LOCAL_VALUES = 16_000_000
PROBE_ITERATIONS, FINAL_ITERATIONS = 4, 12


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By a matrix product; a few rounding errors from the sum of squared differences."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * (x @ c.T), 0)


def assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its exact squared distance. Near ties of the matrix form are settled by differences."""
    d = squared_distances(x, c)
    best = d.min(axis=1)
    close = d <= (best + 1e-9 * (1 + best))[:, None]
    pick = d.argmin(axis=1)
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        js = np.flatnonzero(close[i])
        pick[i] = js[((x[i] - c[js]) ** 2).sum(axis=1).argmin()]
    return pick, ((x - c[pick]) ** 2).sum(axis=1)


def add_up(x: np.ndarray, pick: np.ndarray, k: int) -> np.ndarray:
    """The sum of the rows of each cluster."""
    total = np.zeros((k, x.shape[1]))
    order = np.argsort(pick, kind="stable")
    own = pick[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    if len(starts):
        total[own[starts]] = np.add.reduceat(x[order], starts, axis=0)
    return total


def _f32(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32).astype(np.float64)


def local_kmeans(x: np.ndarray, k: int, iterations: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroids, assignments and the sum of squared distances, for rows in order. Starts at rows floor(c n / k); an empty cluster takes the row farthest from its centroid; ends when no assignment changes. Assignments and sum are those of the final centroids."""
    n = len(x)
    k = min(k, n)
    if k == 0:
        return np.zeros((0, x.shape[1])), np.zeros(0, int), 0.0
    c = _f32(x[[i * n // k for i in range(k)]])
    old = None
    for _ in range(max(1, iterations)):
        now, d = assign(x, c)
        changed = old is None or bool((now != old).any())
        sums, counts = add_up(x, now, k), np.bincount(now, minlength=k)
        for e in np.flatnonzero(counts == 0):
            worst = int(d.argmax())
            now[worst], counts[e], sums[e] = e, 1, x[worst]
        c, old = _f32(sums / counts[:, None]), now
        if not changed:
            break
    now, d = assign(x, c)
    for e in np.flatnonzero(np.bincount(now, minlength=k) == 0):
        now[int(d.argmax())] = e
    return c, now, float(d.sum())


def _check(c: np.ndarray) -> None:
    if c.size > MOST_VALUES:
        raise ValueError(f"{c.size} centroid values are too many to broadcast")


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cid, distance) of the nearest centroids, by matrix products."""
    _check(centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            if b.num_rows:
                pick, d = assign(matrix(b.column("vector")), shared.value)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(pick.astype(np.int64)), pa.array(d)], ["id", "cid", "distance"])

    return vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "id long, cid long, distance double")


def cluster_sums(vectors: DataFrame, *models: np.ndarray, unit: bool = False) -> DataFrame:
    """(model, cid, n, sums, objective, far, far_vector): one row for each cluster of each model that has rows; far is its largest distance. One pass serves all models. unit scales the rows to length 1 where they are."""
    for c in models:
        _check(c)
    shared, dim = vectors.sparkSession.sparkContext.broadcast(models), models[0].shape[1]
    first = np.concatenate([[0], np.cumsum([len(c) for c in models])])
    schema = "model int, cid long, n long, sums array<double>, objective double, far double, far_vector array<double>"
    names = ["model", "cid", "n", "sums", "objective", "far", "far_vector"]

    def emit(total, n, sse, far, where):
        hit = np.flatnonzero(n)
        model = np.searchsorted(first, hit, "right") - 1
        lists = lambda m: pa.ListArray.from_arrays(np.arange(0, (len(hit) + 1) * dim, dim, dtype=np.int32), pa.array(m[hit].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(hit - first[model]), pa.array(n[hit]), lists(total), pa.array(sse[hit]), pa.array(far[hit]), lists(where)], names)

    def empty():
        k = int(first[-1])
        return np.zeros((k, dim)), np.zeros(k, np.int64), np.zeros(k), np.full(k, -1.0), np.zeros((k, dim))

    def partial(batches):
        total, n, sse, far, where = empty()
        for b in batches:
            if b.num_rows:
                x = _unit(matrix(b.column("vector"))) if unit else matrix(b.column("vector"))
                for at, c in zip(first, shared.value):
                    part = slice(at, at + len(c))
                    pick, d = assign(x, c)
                    total[part] += add_up(x, pick, len(c))
                    n[part] += np.bincount(pick, minlength=len(c))
                    sse[part] += np.bincount(pick, d, len(c))
                    order = np.argsort(-d, kind="stable")
                    cid, row = np.unique(pick[order], return_index=True)
                    better = d[order[row]] > far[at + cid]
                    far[at + cid[better]], where[at + cid[better]] = d[order[row]][better], x[order[row]][better]
        yield emit(total, n, sse, far, where)

    def merge(batches):
        total, n, sse, far, where = empty()
        for b in batches:
            if b.num_rows:
                at = first[b.column("model").to_numpy()] + b.column("cid").to_numpy()
                total += add_up(matrix(b.column("sums")), at, len(n))
                np.add.at(n, at, b.column("n").to_numpy())
                np.add.at(sse, at, b.column("objective").to_numpy())
                f, w = b.column("far").to_numpy(), matrix(b.column("far_vector"))
                for i, j in enumerate(at):
                    if f[i] > far[j]:
                        far[j], where[j] = f[i], w[i]
        yield emit(total, n, sse, far, where)

    return vectors.select("vector").mapInArrow(partial, schema).repartition("model", "cid").mapInArrow(merge, schema)


def _in_order(table: pa.Table, *keys: str) -> pa.Table:
    """A row for each cluster, sorted on the driver."""
    return table.sort_by([(k, "ascending") for k in keys])


def starting_rows(placed: DataFrame, n: int, *ks: int) -> list[np.ndarray]:
    """Rows floor(c n / k) of (pos, vector) for each k, found in one pass."""
    wanted = sorted({i * n // k for k in ks for i in range(k)})
    table = placed.sparkSession.createDataFrame([(i,) for i in wanted], "pos long")
    found = _in_order(placed.join(F.broadcast(table), "pos").select("pos", "vector").toArrow(), "pos")
    at, x = found.column("pos").to_numpy(), matrix(found.column("vector").combine_chunks())
    return [x[np.searchsorted(at, [i * n // k for i in range(k)])] for k in ks]


def kmeans_each(placed: DataFrame, n: int, ks: list[int], iterations: int) -> list[tuple[np.ndarray, float]]:
    """Centroids and objective for each k of n rows (id, vector, pos): the same steps as local_kmeans, each one pass for all ks. A clustering whose centroids stay takes no more of them."""
    ks = [min(k, n) for k in ks]
    models = [_f32(c) for c in starting_rows(placed, n, *ks)]
    going = list(range(len(ks)))
    for _ in range(max(1, iterations)):
        table = _in_order(cluster_sums(placed, *[models[m] for m in going]).toArrow(), "model", "cid")
        which, still = table.column("model").to_numpy(), []
        for i, m in enumerate(going):
            own = table.filter(pa.array(which == i))
            cid, far = own.column("cid").to_numpy(), own.column("far").to_numpy()
            new = np.zeros_like(models[m])
            new[cid] = matrix(own.column("sums").combine_chunks()) / own.column("n").to_numpy()[:, None]
            for e in sorted(set(range(ks[m])) - set(cid.tolist())):
                new[e] = np.array(own.column("far_vector")[int(far.argmax())].as_py())
            new = _f32(new)
            if not (new == models[m]).all():
                still.append(m)
            models[m] = new
        going = still
        if not going:
            break
    objectives = cluster_sums(placed, *models).groupBy("model").agg(F.sum("objective").alias("j")).collect()
    found = {r.model: float(r.j or 0) for r in objectives}
    return [(c, found.get(m, 0.0)) for m, c in enumerate(models)]


def kmeans(placed: DataFrame, n: int, k: int, iterations: int) -> tuple[np.ndarray, float]:
    return kmeans_each(placed, n, [k], iterations)[0]


def k_bounds(n: int) -> tuple[int, int]:
    """The range of k that is searched for n rows."""
    low = max(1, min(32, n)) if n else 0
    return low, max(low, min(256, n))


def k_bounds_no_empty(n: int) -> tuple[int, int]:
    """The same for the variant without empty clusters."""
    return max(2, min(32, n // 16 + 2)), max(2, min(256, n))


def choose_k(objectives: Callable[[list[int]], list[float]], low: int, high: int) -> tuple[int, list[tuple[int, float, str]]]:
    """The k of least objective among low, middle and high, then its neighbours; and the trace (k, objective, phase). The ks of a phase are asked for together."""
    trace: list[tuple[int, float, str]] = []

    def best() -> int:
        return min(trace, key=lambda t: (t[1], t[0]))[0]

    def probe(ks: list[int], phase: str) -> None:
        trace.extend((k, j, phase) for k, j in zip(ks, objectives(ks) if ks else []))

    probe(sorted({low, low + (high - low) // 2, high}), "coarse")
    middle = best()
    probe([k for k in range(max(low, middle - 1), min(high, middle + 1) + 1) if k not in {t[0] for t in trace}], "fine")
    return best(), trace


def choose_knee(objective: Callable[[int], float], low: int, high: int, coarse: float = 0.15, fine: float = 0.02) -> tuple[int, list[int]]:
    """The k of the sharpest bend J(k-1) - 2 J(k) + J(k+1): every coarse share of the range, then a window around the best. Also the ks evaluated, in order."""
    seen: dict[int, float] = {}

    def j(k: int) -> float:
        if k not in seen:
            seen[k] = objective(k)
        return seen[k]

    def bend(k: int) -> float:
        return j(k - 1) - 2 * j(k) + j(k + 1) if low < k < high else -math.inf

    def sharpest(ks) -> tuple[float, int]:
        top = (-math.inf, None)
        for k in ks:
            s = bend(k)
            if top[1] is None or s > top[0] + 1e-12 or abs(s - top[0]) < 1e-12 and k < top[1]:
                top = (s, k)
        return top

    half_up = lambda x: math.floor(x + 0.5)
    span = high - low + 1
    score, k = sharpest([*range(low, high, max(1, half_up(span * coarse))), high])
    if score == -math.inf and high > low + 1:
        k = min(max(low + (high - low) // 2, low + 1), high - 1)
    count = max(1, half_up(span * fine))
    start = max(low, k - count // 2)
    end = min(high, start + count - 1)
    start = max(low, end - count + 1) if end == high else start
    score, found = sharpest(range(start, end + 1))
    k = found if score > -math.inf else k
    j(k)
    return k, list(seen)


def lloyd_no_empty(x: np.ndarray, k: int, iterations: int = 48, least_shift: float = 1e-6) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroids, assignments and repairs: starts at row 0 and then always at the row farthest from all starts; an empty cluster takes the row farthest from its centroid among clusters of more than one."""
    n = len(x)
    k = max(1, min(k, n))
    starts, nearest = [0], np.full(n, np.inf)
    while len(starts) < k:
        nearest = np.minimum(nearest, ((x - x[starts[-1]]) ** 2).sum(axis=1))
        starts.append(int(nearest.argmax()))
    c, old, repairs = x[starts].copy(), np.zeros(n, int), 0
    for _ in range(iterations):
        now, _ = assign(x, c)
        counts, moved = np.bincount(now, minlength=k), False
        changed = bool((now != old).any())
        for e in np.flatnonzero(counts == 0):
            d = np.where(counts[now] > 1, ((x - c[now]) ** 2).sum(axis=1), -1.0)
            donor = int(d.argmax())
            if d[donor] >= 0:
                counts[now[donor]] -= 1
                now[donor], counts[e], moved = e, 1, True
                repairs += 1
        sums = add_up(x, now, k)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        shift = ((new - c) ** 2).sum(axis=1).max()
        c, old = new, now
        if not changed and not moved and shift <= least_shift and counts.all():
            break
    return c, old, repairs


def farthest_first(placed: DataFrame, k: int) -> np.ndarray:
    """Row 0 and then always the row farthest from all starts, the first of equals; one pass for each start."""
    starts = [np.array(placed.where("pos = 0").select("vector").first()[0], dtype=float)]
    while len(starts) < k:
        shared = placed.sparkSession.sparkContext.broadcast(np.array(starts))

        def run(batches, shared=shared):
            top = (-1.0, 0, None)
            for b in batches:
                if b.num_rows:
                    x, pos = matrix(b.column("vector")), b.column("pos").to_numpy()
                    d = np.min([((x - s) ** 2).sum(axis=1) for s in shared.value], axis=0)
                    i = int(np.lexsort((pos, -d))[0])
                    if d[i] > top[0] or d[i] == top[0] and pos[i] < top[1]:
                        top = (float(d[i]), int(pos[i]), x[i].tolist())
            if top[2] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([top[0]]), pa.array([top[1]]), pa.array([top[2]], pa.list_(pa.float64()))], ["d", "pos", "v"])

        best = placed.select("pos", "vector").mapInArrow(run, "d double, pos long, v array<double>").orderBy(F.desc("d"), "pos").first()
        starts.append(np.array(best["v"]))
        shared.unpersist()
    return np.array(starts)


def kmeans_no_empty(vectors: DataFrame, k: int, iterations: int = 48, least_shift: float = 1e-6) -> tuple[DataFrame, np.ndarray, int]:
    """lloyd_no_empty by passes: assignments (id, cid), centroids and repairs. Clusters left empty by a step are given, in order, the row that is farthest from its centroid among clusters of more than one; of each cluster its farthest row is the one to give, so donors come from a table of k rows."""
    placed = materialise(with_position(vectors.select("id", "vector"), "id"), "placed")
    n = placed.count()
    if not n:
        return placed.select("id", F.lit(0).cast("long").alias("cid")), np.zeros((0, 0)), 0
    k = max(1, min(k, n))
    c, repairs, moved = farthest_first(placed, k), 0, {}
    for _ in range(iterations):
        table = _in_order(cluster_sums(placed, c).toArrow(), "cid")
        cid, counts = table.column("cid").to_numpy(), np.zeros(k, np.int64)
        counts[cid] = table.column("n").to_numpy()
        sums = np.zeros_like(c)
        sums[cid] = matrix(table.column("sums").combine_chunks())
        far, where = np.full(k, -1.0), np.zeros_like(c)
        far[cid], where[cid] = table.column("far").to_numpy(), matrix(table.column("far_vector").combine_chunks())
        moved = {}
        for e in np.flatnonzero(counts == 0):
            give = np.where(counts > 1, far, -1.0)
            donor = int(give.argmax())
            if give[donor] < 0:
                continue
            sums[e], sums[donor] = where[donor], sums[donor] - where[donor]
            counts[e], counts[donor], far[donor] = 1, counts[donor] - 1, -1.0
            moved[int(e)] = where[donor]
            repairs += 1
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        shift = float(((new - c) ** 2).sum(axis=1).max())
        c = new
        if not moved and shift <= least_shift:
            break
    return assigned(placed, c).select("id", "cid"), c, repairs


def refined_objective(placed: DataFrame, n: int, ks: list[int]) -> list[float]:
    """For each k the mean squared distance after one refinement of the starting rows: two passes for all ks. An empty cluster keeps its start."""
    ks = [max(1, min(k, n)) for k in ks]
    models = starting_rows(placed, n, *ks)
    table = _in_order(cluster_sums(placed, *models).toArrow(), "model", "cid")
    which = table.column("model").to_numpy()
    for m, c in enumerate(models):
        own = table.filter(pa.array(which == m))
        c[own.column("cid").to_numpy()] = matrix(own.column("sums").combine_chunks()) / own.column("n").to_numpy()[:, None]
    found = {r.model: r.j for r in cluster_sums(placed, *models).groupBy("model").agg(F.sum("objective").alias("j")).collect()}
    return [found.get(m, 0.0) / n for m in range(len(ks))]


KNEE_SAMPLE = 512


def knee_of_sample(vectors: DataFrame) -> tuple[int, list[int]]:
    """choose_knee of refined_objective for KNEE_SAMPLE rows at most, those at places floor(c n / KNEE_SAMPLE) of the whole table: the k, and the ks evaluated. A bounded sample is worked on where it is."""
    placed = with_position(vectors.select("id", "vector"), "id")
    n = placed.count()
    m = min(n, KNEE_SAMPLE)
    if not m:
        return 0, []
    x = starting_rows(placed, n, m)[0]

    def objective(k: int) -> float:
        c = x[[i * m // k for i in range(k)]]
        pick, _ = assign(x, c)
        counts, sums = np.bincount(pick, minlength=k), add_up(x, pick, k)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        return float(assign(x, c)[1].mean())

    return choose_knee(objective, *k_bounds(m))


def spherical_kmeans(placed: DataFrame, n: int, k: int, iterations: int = 20, seed: int = 1234) -> tuple[np.ndarray, float]:
    """Unit centroids of greatest dot product, and the mean of 1 - dot. Starts at the k rows of least hash of (seed, id). An empty cluster keeps its centroid."""
    return spherical_each(placed, n, [(k, seed)], iterations)[0]


def spherical_each(placed: DataFrame, n: int, wanted: list[tuple[int, int]], iterations: int) -> list[tuple[np.ndarray, float]]:
    """spherical_kmeans for each (k, seed), all in the same passes. A clustering whose centroids stay takes no more of them."""
    models = []
    for k, seed in wanted:
        first = placed.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(min(k, n)).select("vector").toArrow()
        models.append(_unit(matrix(first.column("vector").combine_chunks())))
    going = list(range(len(models)))
    for _ in range(max(1, iterations)):
        table = _in_order(cluster_sums(placed, *[models[m] for m in going], unit=True).toArrow(), "model", "cid")
        which, still = table.column("model").to_numpy(), []
        for i, m in enumerate(going):
            own = table.filter(pa.array(which == i))
            new = models[m].copy()
            new[own.column("cid").to_numpy()] = _unit(matrix(own.column("sums").combine_chunks()))
            if np.abs(new - models[m]).max() >= 1e-12:
                models[m] = new
                still.append(m)
        going = still
        if not going:
            break
    sse = {r.model: r for r in cluster_sums(placed, *models, unit=True).groupBy("model").agg(F.sum("objective").alias("j"), F.sum("n").alias("n")).collect()}
    return [(c, float(sse[m].j / sse[m].n / 2)) for m, c in enumerate(models)]  # of unit vectors, |x - c|^2 / 2 is 1 - dot


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    from vexil.functions.vectors import normalise

    return vectors.withColumn("vector", normalise("vector"))


def paired(vectors: DataFrame, a: np.ndarray, b: np.ndarray, m: int = 2) -> DataFrame:
    """(a, b, tops_a, tops_b): for each row the best centroid by dot product and the m best in order, of two clusterings; the lower number among equals."""
    _check(a)
    _check(b)
    shared = vectors.sparkSession.sparkContext.broadcast((a, b))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"))
                tops = [np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :m].astype(np.int64) for c in shared.value]
                lists = [pa.ListArray.from_arrays(np.arange(0, t.size + 1, t.shape[1], dtype=np.int32), pa.array(t.ravel())) for t in tops]
                yield pa.RecordBatch.from_arrays([*[pa.array(t[:, 0].copy()) for t in tops], *lists], ["a", "b", "tops_a", "tops_b"])

    return vectors.select("vector").mapInArrow(run, "a long, b long, tops_a array<long>, tops_b array<long>")


def _gain(a: float, b: float) -> float:
    return 0.0 if a <= 0 else (a - b) / a


def elbow_by_bisection(objective: Callable[[int], float], grid: list[int], threshold: float = 0.08) -> tuple[int, bool]:
    """The first k of the grid from which the next gains no more than threshold of the objective, by bisection; and whether there is one (else the last)."""
    low, high, best = 0, len(grid) - 2, None
    while low <= high:
        mid = (low + high) // 2
        if _gain(objective(grid[mid]), objective(grid[mid + 1])) <= threshold:
            best, high = mid, mid - 1
        else:
            low = mid + 1
    return (grid[best], True) if best is not None else (grid[-1], False)


def elbow_stage(objective: Callable[[int], float], grid: list[int], threshold: float = 0.08, flat: float = 0.02, patience: int | None = None, epsilon: float = 0.005) -> tuple[int, bool, dict[int, float]]:
    """The k of elbow_by_bisection, whether the last k had to serve instead, and the objectives found. It serves too where the gain at the k before differs from that at k by more than flat. With patience, the search ends once so many gains in a row were low and the last two differ by epsilon at most."""
    seen: dict[int, float] = {}

    def j(k: int) -> float:
        if k not in seen:
            seen[k] = objective(k)
        return seen[k]

    low, high, best, gains, streak, last = 0, len(grid) - 2, None, {}, 0, None
    while low <= high:
        mid = (low + high) // 2
        g = gains[mid] = _gain(j(grid[mid]), j(grid[mid + 1]))
        if g <= threshold:
            best, high, streak = mid, mid - 1, streak + 1
        else:
            low, streak = mid + 1, 0
        if patience is not None and last is not None and streak >= patience and abs(g - last) <= epsilon:
            break
        last = g
    if best is None:
        return grid[-1], True, seen
    if best > 0:
        before = gains.get(best - 1)
        before = _gain(j(grid[best - 1]), j(grid[best])) if before is None else before
        if abs(before - gains[best]) > flat:
            return grid[-1], True, seen
    return grid[best], False, seen


def pruned_grid(grid: list[int], objectives: dict[int, float], threshold: float = 0.08, margin: float = 0.01) -> list[int]:
    """The part of the grid that stage B searches: around the first low gain of stage A and all gains within margin of the threshold, with a guard of a twentieth of the grid; the whole grid if fewer than two are left."""
    ks = sorted(objectives)
    gains = [(k, _gain(objectives[k], objectives[k + 1])) for k in ks if k + 1 in objectives]
    crossing = next((k for k, g in gains if g <= threshold), None)
    low, high = (crossing, crossing + 1) if crossing is not None else (grid[0], grid[-1])
    for k, g in gains:
        if abs(g - threshold) <= margin:
            low, high = min(low, k), max(high, k + 1)
    guard = max(2, len(grid) // 20)
    low, high = (low - guard if low > guard else grid[0]), min(grid[-1], high + guard)
    left = [k for k in grid if low <= k <= high]
    return left if len(left) >= 2 else grid


def elbow_search(vectors: DataFrame, low: int, high: int, iterations: int = 20, probe: int = 8, seed: int = 1234, threshold: float = 0.08, flat: float = 0.02, stride: int = 1, patience: int | None = None) -> tuple[int, bool, np.ndarray, list[tuple[int, float, str]]]:
    """The number of clusters of spherical k-means by two stages of elbow_stage: A on a sample by hash (30 % of the rows, 256 to 4096, every stride-th element), over the whole grid low .. high; B on all rows over what pruned_grid leaves of it. Then a refit of all rows with full iterations. Gives k, whether the last k had to serve, the centroids, and the trace (k, objective, stage)."""
    from vexil.functions.vectors import stride as every
    from vexil.operators.agreement import sample_by_hash

    rows = vectors.select("id", "vector")
    all_rows = materialise(unit_vectors(rows), "unit")
    part = sample_by_hash(rows, seed + 77)
    if stride > 1:
        part = part.withColumn("vector", every("vector", stride))
    part = materialise(unit_vectors(part), "sample")
    n, m = all_rows.count(), part.count()
    grid = list(range(max(1, low), min(high, n) + 1))
    if len(grid) < 2:
        raise ValueError("the grid of k needs two values at least")
    x = matrix(part.orderBy("id").select("vector").toArrow().column("vector").combine_chunks())  # a bounded sample
    of_sample = lambda k: local_spherical(x, min(k, m), probe, seed + k)[2]
    _, _, a = elbow_stage(of_sample, grid, threshold, flat, patience)
    for k in grid:
        if k not in a:
            a[k] = of_sample(k)
    left = pruned_grid(grid, a, threshold)
    k, fallback, b = elbow_stage(lambda k: spherical_kmeans(all_rows, n, k, probe, seed + k)[1], left, threshold, flat, patience)
    c, j = spherical_kmeans(all_rows, n, k, iterations, seed + k)
    return k, fallback, c, [(k, v, "a") for k, v in sorted(a.items())] + [(k, v, "b") for k, v in sorted(b.items())] + [(k, j, "refit")]


def local_spherical(x: np.ndarray, k: int, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit centroids, assignments and the mean of 1 - dot of unit rows x; starts at rows drawn by seed, an empty cluster keeps its centroid."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(max(1, iterations)):
        pick = (x @ c.T).argmax(axis=1)
        sums, counts = add_up(x, pick, k), np.bincount(pick, minlength=k)
        new = np.where(counts[:, None] > 0, _unit(sums), c)
        if np.abs(new - c).max() < 1e-12:
            break
        c = new
    dots = x @ c.T
    pick = dots.argmax(axis=1)
    return c, pick, float(1 - dots[np.arange(len(x)), pick].mean()) if len(x) else 0.0


def cluster_top(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The top layer of (id, vector): assignments (id, top_id), centroids (top_id, centroid), the trace (k, objective, phase), and the k chosen."""
    spark = vectors.sparkSession
    placed = materialise(with_position(vectors.select("id", "vector"), "id"), "placed")
    n = placed.count()
    if not n:
        return vectors.select("id", F.lit(0).cast("long").alias("top_id")).limit(0), spark.createDataFrame([], "top_id long, centroid array<float>"), spark.createDataFrame([], "k long, objective double, phase string"), 0
    k, trace = choose_k(lambda ks: [j for _, j in kmeans_each(placed, n, ks, PROBE_ITERATIONS)], *k_bounds(n))
    c, _ = kmeans(placed, n, k, FINAL_ITERATIONS)
    centroids = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], "top_id long, centroid array<float>")
    return assigned(placed, c).select("id", F.col("cid").alias("top_id")), centroids, spark.createDataFrame(trace, "k long, objective double, phase string"), k


def _without_empty(placed: DataFrame, c: np.ndarray) -> DataFrame:
    """(id, cid) of the nearest centroids; as in local_kmeans, the row farthest from its centroid takes the number of the last empty cluster."""
    near = assigned(placed, c)
    used = {r.cid for r in near.select("cid").distinct().collect()}
    empty = [e for e in range(len(c)) if e not in used]
    if not empty:
        return near.select("id", "cid")
    worst = near.orderBy(F.desc("distance"), "id").first()["id"]
    return near.select("id", F.when(F.col("id") == worst, F.lit(empty[-1])).otherwise(F.col("cid")).cast("long").alias("cid"))


def cluster_groups(vectors: DataFrame, group: str = "top_id") -> DataFrame:
    """(id, group, mid): k-means of each group by itself with its own choice of k; mid counts from 0 in each group. Groups beyond LOCAL_VALUES are clustered by passes, one after another."""
    spark = vectors.sparkSession
    sizes = vectors.groupBy(group).agg(F.sum(F.size("vector")).alias("values"), F.count(F.lit(1)).alias("n"))
    large = [(r[group], r["n"]) for r in sizes.where(F.col("values") > LOCAL_VALUES).collect()]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.array(part["vector"].tolist(), dtype=float)
        k, _ = choose_k(lambda ks: [local_kmeans(x, k, PROBE_ITERATIONS)[2] for k in ks], *k_bounds(len(x)))
        return pd.DataFrame({"id": part["id"].to_numpy(), group: part[group].to_numpy(), "mid": local_kmeans(x, k, FINAL_ITERATIONS)[1].astype("int64")})

    out = vectors
    if large:  # null is a group too
        apart = spark.createDataFrame([(g,) for g, _ in large], "__g long")
        out = vectors.join(F.broadcast(apart), F.col(group).eqNullSafe(F.col("__g")), "left_anti")
    out = out.groupBy(group).applyInPandas(run, f"id long, {group} long, mid long")
    for g, n in large:
        placed = materialise(with_position(vectors.where(F.col(group).eqNullSafe(F.lit(g).cast("long"))).select("id", "vector"), "id"), "placed")
        k, _ = choose_k(lambda ks, p=placed, n=n: [j for _, j in kmeans_each(p, n, ks, PROBE_ITERATIONS)], *k_bounds(n))
        out = out.unionByName(_without_empty(placed, kmeans(placed, n, k, FINAL_ITERATIONS)[0]).select("id", F.lit(g).cast("long").alias(group), F.col("cid").alias("mid")))
    return out
