import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators import agreement, checks, hierarchy, kmeans, search


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")


def test_exact_search_orders_by_score_then_id(spark):
    rows = spark.createDataFrame([(10, [1.0, 0.0]), (5, [1.0, 0.0]), (20, [0.5, 0.0]), (7, None), (8, [1.0])], "embedding_id long, vector array<float>")
    assert [tuple(r) for r in search.search_exact(rows, [1.0, 0.0], 3).collect()] == [(5, 1.0), (10, 1.0), (20, 0.5)]
    assert search.search_exact(rows, [1.0, 0.0], 0).count() == 0 and search.search_exact(rows, [1.0, 0.0, 0.0]).count() == 0
    assert search.sanity(rows, [1.0, 0.0]) and not search.sanity(rows.limit(0), [1.0, 0.0])
    with pytest.raises(ValueError):
        search.search_exact(rows, [1.0, 0.0], metric="l1")


def test_zero_vectors_have_cosine_zero(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, -3.0])], "embedding_id long, vector array<float>")
    assert [tuple(r) for r in search.search_exact(rows, [0.0, 1.0], metric="cosine").collect()] == [(1, 0.0), (2, -1.0)]


def test_many_queries_by_broadcast_and_by_join(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = frame(spark, rng.normal(size=(60, 5)))
    queries = frame(spark, rng.normal(size=(9, 5))).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    get = lambda: sorted((r.query_id, r.id, r.rank, round(r.score, 9)) for r in search.search_many(rows, queries, 4, id_column="id").collect())
    a = get()
    monkeypatch.setattr(search, "BROADCAST_VALUES", 0)
    assert a == get() and len(a) == 36


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_every_vector_is_searched_for_by_blocks(spark, monkeypatch, metric):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 16)).astype(np.float32)
    x[40:60], x[70] = x[3], 0
    rows = frame(spark, x).unionByName(spark.createDataFrame([(900, None), (901, [1.0, 2.0]), (902, [1.0, 2.0])], "id long, vector array<float>"))
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(search, "BLOCK_SCORES", 700)
    queries = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got: dict = {}
    for r in search.search_many(rows, queries, 12, metric, "id").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    d = x.astype(float)
    s = (d[:, None] * d[None]).sum(axis=2)
    if metric == "cosine":
        lengths = np.linalg.norm(d, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None]
        s = np.where(lengths > 0, s / np.where(lengths > 0, lengths, 1), 0)
    assert got.pop(901) == [901, 902] and got.pop(902) == [901, 902]
    assert got == {i: sorted(range(150), key=lambda j: (-s[i, j], j))[:12] for i in range(150)}


@pytest.mark.parametrize("name", ["search_every", "csv_vectors"])
def test_whole_jobs_leave_nothing_out(spark, sf_dir, name):
    import __spark_entry__

    e, got = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), __spark_entry__.queries()[name](spark, sf_dir)
    if name == "search_every":
        assert got.count() == 10 * e.count() and got.select("query_id").distinct().count() == e.count()
    else:
        assert {(r.a, r.b) for r in got.select(F.size("vector").alias("a"), F.size(F.split("csv", ",")).alias("b")).distinct().collect()} == {(64, 64)}


def brute_kmeans(x, k, iterations):
    x, n = x.astype(np.float32).astype(float), len(x)
    c = x[[i * n // k for i in range(k)]]
    for _ in range(iterations):
        a = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[a == j].mean(0) if (a == j).any() else c[j] for j in range(k)]).astype(np.float32).astype(float)
    return c, float(((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum())


def test_kmeans_passes_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(40, 4)) * 0.1 + c for c in rng.normal(size=(5, 4)) * 3])
    placed = kmeans.with_position(frame(spark, x), "id")
    assert sorted(r.pos for r in placed.collect()) == list(range(200)) and placed.where("pos <> id").count() == 0
    for k in (1, 5, 9):
        want = brute_kmeans(x, k, 6)
        got = kmeans.kmeans(placed, 200, k, 6)
        assert np.allclose(got[0], want[0], atol=1e-5) and abs(got[1] - want[1]) < 1e-3
        local = kmeans.local_kmeans(x.astype(np.float32).astype(float), k, 6)
        assert np.allclose(local[0], want[0], atol=1e-5)


def test_identical_points_and_empty_clusters():
    c, a, j = kmeans.local_kmeans(np.ones((16, 3)), 2, 4)
    assert a.tolist() == [1] + [0] * 15 and j == 0 and len(c) == 2
    c, a, repairs = kmeans.lloyd_no_empty(np.ones((6, 2)), 3)
    assert np.bincount(a, minlength=3).min() > 0 and repairs > 0


def test_no_empty_variant_finds_separate_groups():
    x = np.concatenate([np.full((5, 2), v) for v in (0.0, 10.0, 20.0)])
    _, a, _ = kmeans.lloyd_no_empty(x, 3)
    assert len({tuple(a[i : i + 5]) for i in (0, 5, 10)}) == 3 and all(len(set(a[i : i + 5])) == 1 for i in (0, 5, 10))


def test_choice_of_k():
    assert kmeans.k_bounds(0) == (0, 0) and kmeans.k_bounds(10) == (10, 10) and kmeans.k_bounds(5000) == (32, 256)
    assert kmeans.k_bounds_no_empty(100) == (8, 100)
    k, trace = kmeans.choose_k(lambda ks: [abs(k - 145) for k in ks], 32, 256)
    assert k == 144 + 1 and [t[0] for t in trace] == [32, 144, 256, 143, 145]
    j = lambda k: 100 - 10 * k if k < 7 else 40 - (k - 6) * 0.1
    assert kmeans.choose_knee(j, 2, 12)[0] == 6
    assert kmeans.elbow_by_bisection(lambda k: 1000 / k, [8, 16, 32, 64]) == (64, False)
    assert kmeans.elbow_by_bisection(lambda k: max(10, 100 - k), [8, 90, 95, 99]) == (90, True)


def test_spherical_kmeans_separates_directions(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(30, 6)) * 0.02 + np.eye(6)[i] for i in (0, 3)])
    c, j = kmeans.spherical_kmeans(frame(spark, x), 60, 2, seed=3)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and j < 0.6


def test_top_and_group_layers(spark):
    rng = np.random.default_rng(4)
    rows = frame(spark, rng.normal(size=(90, 4)))
    tops, cents, trace, k = kmeans.cluster_top(rows)
    assert tops.count() == 90 and cents.count() == k and 32 <= k <= 90 and trace.count() >= 3
    mids = kmeans.cluster_groups(rows.withColumn("top_id", (F.col("id") % 2).cast("long")))
    assert mids.count() == 90
    assert kmeans.cluster_top(rows.limit(0))[0].count() == 0


def test_large_groups_are_clustered_by_passes_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = frame(spark, rng.normal(size=(80, 3))).withColumn("top_id", F.lit(0).cast("long"))
    a = {r.id: r.mid for r in kmeans.cluster_groups(rows).collect()}
    monkeypatch.setattr(kmeans, "LOCAL_VALUES", 1)
    b = {r.id: r.mid for r in kmeans.cluster_groups(rows).collect()}
    assert a.keys() == b.keys() and sum(a[i] == b[i] for i in a) >= 76


def test_dimensions_are_sampled_from_the_whole_table(spark, tmp_path):
    import __spark_entry__

    rng = np.random.default_rng(8)
    x = rng.normal(size=(4600, 6)).astype(np.float32)
    x[:4096, 2:] *= 0.01  # the first ids lie near a plane
    rows = frame(spark, x).select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"), F.lit(0).alias("label"))
    rows.repartition(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    order = rows.select("vec_id", F.xxhash64(F.lit(1234), "vec_id").alias("h")).toPandas().sort_values(["h", "vec_id"])
    ids = order["vec_id"].to_numpy()[:4096]
    u = x[ids].astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    d = np.maximum(1e-9, 1 - np.clip(u @ u.T, -1, 1))
    np.fill_diagonal(d, np.inf)
    two = np.partition(d, 1, axis=1)[:, :2]
    want = {i: np.log(2) / np.log(b / a) for i, (a, b) in zip(ids, two) if b > a * (1 + 1e-6)}
    got = {r.id: r.m for r in __spark_entry__.queries()["local_dimensions"](spark, str(tmp_path)).collect()}
    assert got.keys() <= set(ids) and want.keys() <= got.keys() and sum(i >= 4096 for i in got) > 300
    assert sum(abs(got[i] - want[i]) <= 1e-3 * want[i] + 1e-4 for i in want) > 0.99 * len(want)


def test_groups_below_and_above_the_limit_are_alike(spark, monkeypatch):
    x = np.random.default_rng(10).normal(size=(108, 3))
    rows = frame(spark, x).withColumn("top_id", F.when(F.col("id") < 34, 0).when(F.col("id") < 69, 1).cast("long"))  # 34, 35 and, null, 39 rows
    get = lambda: {r.id: (r.top_id, r.mid) for r in kmeans.cluster_groups(rows).collect()}
    want = get()
    assert len(want) == 108 and sum(g is None for g, _ in want.values()) == 39
    for limit in (105, 104):  # null alone by passes, and with group 1
        monkeypatch.setattr(kmeans, "LOCAL_VALUES", limit)
        assert get() == want


def test_unconverged_passes_score_and_assign_as_one_task_does(spark):
    x = np.random.default_rng(11).normal(size=(90, 3)).astype(np.float32).astype(float)
    placed = kmeans.with_position(frame(spark, x), "id")
    _, a, j = kmeans.local_kmeans(x, 6, 1)
    c, got = kmeans.kmeans(placed, 90, 6, 1)
    assert abs(got - j) < 1e-6 and {r.id: r.cid for r in kmeans._without_empty(placed, c).collect()} == dict(enumerate(a.tolist()))


def test_stability_of_several_seeds_matches_brute_force(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(120, 5)).astype(np.float32)
    models, seeds, real = [], [], kmeans.spherical_kmeans

    def recorded(placed, n, k, iterations, seed):
        models.append(real(placed, n, k, iterations, seed)[0])
        seeds.append(seed)
        return models[-1], 0.0

    monkeypatch.setattr(kmeans, "spherical_kmeans", recorded)
    got = agreement.evaluate_stability(frame(spark, x), 4, runs=3, least_runs=3, iterations=3).first()
    assert got.runs == 3 and seeds == [2234, 2235, 2236]
    tops = [np.argsort(-(x.astype(float) @ c.T), axis=1, kind="stable")[:, :2] for c in models]
    found = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        p = np.zeros((4, 4))
        np.add.at(p, (tops[i][:, 0], tops[j][:, 0]), 1 / 120)
        a, b, hit = p.sum(1), p.sum(0), p > 0
        h = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
        nmi = (p[hit] * np.log(p[hit] / np.outer(a, b)[hit])).sum() / np.sqrt(h(a) * h(b))
        found.append((nmi, np.mean([len({*s} & {*t}) / len({*s} | {*t}) for s, t in zip(tops[i], tops[j])]), agreement.centroid_drift(models[i], models[j])))
    f = np.array(found)
    assert np.allclose([got.mean_nmi, got.std_nmi, got.mean_jaccard, got.mean_drift], [f[:, 0].mean(), f[:, 0].std(), f[:, 1].mean(), f[:, 2].mean()], atol=1e-9)
    assert agreement.evaluate_stability(frame(spark, x).limit(0), 4).count() == 0


def test_elbow_gains_come_from_clusterings(spark, sf_dir):
    import __spark_entry__

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(e["embedding"].tolist())
    j = {k: brute_kmeans(x, k, kmeans.PROBE_ITERATIONS)[1] for k in range(2, 13)}
    got = {r.k: r.gain for r in __spark_entry__.queries()["kmeans_elbow_gains"](spark, sf_dir).collect()}
    assert got.keys() == j.keys() and all(abs(got[k] - ((j[k] - j[k + 1]) / j[k] if k + 1 in j else 0)) < 1e-5 for k in got)


def test_hierarchy_of_an_empty_table(spark):
    mids = spark.createDataFrame([], "id long, top_id long, mid long")
    gates = hierarchy.lower_gate(hierarchy.mid_ids(mids))
    assert gates.count() == 0 and hierarchy.final_clusters(gates).count() == 0 and hierarchy.gate_counts(gates).first().processed == 0


def test_drift_matches_greedily():
    a = np.eye(3)
    assert agreement.centroid_drift(a, a[[2, 0, 1]]) == 0 and agreement.centroid_drift(a, a[:2]) == 1
    assert agreement.centroid_drift(a[:2], -a[:2]) == 1


def test_validators(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, None)], "id long, vector array<float>")
    assert {(r.id, r.reason) for r in checks.embedding_violations(rows, 2).collect()} == {(2, "norm"), (3, "dimension"), (4, "not_finite"), (5, "dimension")}
    assert checks.renormalised(rows.where("id < 3")).where("NOT norm_ok").count() == 0


def test_int8_round_trip(spark):
    rows = frame(spark, np.random.default_rng(0).normal(size=(20, 8)))
    back = rows.select("vector", V.dequantise_int8(V.quantise_int8("vector"), V.int8_scale("vector")).alias("b"))
    assert all(max(abs(x - y) for x, y in zip(r.vector, r.b)) <= max(map(abs, r.vector)) / 254 + 1e-6 for r in back.collect())


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [-1e-7, -0.0, 0.0, 2.5e-5, -2.5e-5, 1.5e-5, 0.000035, 0.123455, -0.123455, 1.000005, 0.5, 123456.789, 1e305, -1e305, float("inf"), float("nan"), None]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(V.rounded("v", 5).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))


def test_equal_neighbours_give_no_dimension(spark):
    x = np.random.default_rng(12).normal(size=(601, 61))
    near = x + 0.05 * np.random.default_rng(13).normal(size=x.shape)
    u = np.concatenate([x, near, near])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u / np.linalg.norm(u, axis=1)[:, None])], "id long, vector array<double>")
    got = {r.id for r in agreement.local_dimensions(rows).collect()}
    assert not got & set(range(601)) and got >= set(range(601, 1803))


def test_long_vectors_are_normalised_in_one_go(spark):
    import time

    x = np.random.default_rng(14).normal(size=(300, 4000)).astype(np.float32)
    rows = frame(spark, x)
    rows.select(F.sum(F.size("vector"))).collect()
    began = time.perf_counter()
    got = np.array([r.v for r in rows.select(V.normalise("vector").alias("v")).collect()])
    assert time.perf_counter() - began < 15  # the square of the length in steps takes minutes
    assert np.allclose(got, x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None], atol=1e-12)


def test_several_spherical_clusterings_share_their_passes(spark, monkeypatch):
    rows = frame(spark, np.random.default_rng(15).normal(size=(90, 5)))
    wanted, passes, real = [(3, 7), (6, 8)], [], kmeans.cluster_sums
    apart = [kmeans.spherical_kmeans(rows, 90, k, 4, seed) for k, seed in wanted]
    monkeypatch.setattr(kmeans, "cluster_sums", lambda *a, **b: passes.append(len(a) - 1) or real(*a, **b))
    for (c, j), (d, i) in zip(kmeans.spherical_each(rows, 90, wanted, 4), apart):
        assert np.allclose(c, d, atol=1e-9) and abs(i - j) < 1e-9
    assert len(passes) <= 5


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_scores_of_a_search_stay_below_their_bound(metric):
    import tracemalloc

    rng = np.random.default_rng(16)
    q, x = rng.normal(size=(2000, 8)), rng.normal(size=(4000, 8))
    x[500:520] = x[3]
    tracemalloc.start()
    i, j, s = search._best_of(q, x, 5, metric, 1_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == 10_000 and peak < 1_000_000 * 8 * 1.6  # scores, copies and masks, and what is found
    want = q[7] @ x.T / (np.linalg.norm(q[7]) * np.linalg.norm(x, axis=1) if metric == "cosine" else 1)
    assert j[i == 7].tolist() == sorted(range(4000), key=lambda t: (-round(want[t], 9), t))[:5]
