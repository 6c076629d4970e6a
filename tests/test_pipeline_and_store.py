import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.functions import text as T
from vexil.operators import batching, checks, hierarchy, kmeans, order, pipeline, reports, store
from vexil.sources import readers, writers
from vexil.streaming import jobs


def blobs(spark, n=240, dim=6, centres=5, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 5
    x = c[np.arange(n) % centres] + rng.normal(size=(n, dim)) * 0.3
    return spark.createDataFrame([(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>"), x


@pytest.fixture(scope="module")
def clusters(spark, tmp_path_factory):
    rows, _ = blobs(spark)
    root = str(tmp_path_factory.mktemp("artifacts"))
    return pipeline.run(rows, gate=3, root=root), root


def test_sql_gives_the_same_layers_from_the_assignments(clusters):
    out, _ = clusters
    con = duckdb.connect()
    tops, mids = out.top.toPandas(), out.mids.toPandas()  # noqa: F841, DuckDB reads them
    con.execute("CREATE TABLE gates AS SELECT top_id, mid_id, count(*) AS n, CASE WHEN count(*) <= 3 THEN 'stop' ELSE 'continue' END AS gate, row_number() OVER (ORDER BY top_id, mid_id) - 1 AS lower_id FROM mids GROUP BY top_id, mid_id")
    con.execute("CREATE TABLE finals AS SELECT row_number() OVER (ORDER BY top_id, mid_id) - 1 AS final_id, top_id, mid_id, n FROM gates WHERE gate = 'stop'")
    same = lambda df, sql: sorted(map(tuple, df.collect())) == sorted(con.execute(sql).fetchall())
    assert same(out.gates.select("top_id", "mid_id", "n", "gate", "lower_id"), "SELECT * FROM gates")
    assert same(out.finals.select("final_id", "top_id", "mid_id", "n"), "SELECT * FROM finals")
    assert same(
        out.members.select("id", "top_id", "mid_id", "lower_id", "final_id"),
        """SELECT t.id, t.top_id, m.mid_id, coalesce(CASE WHEN g.gate = 'continue' THEN lower_id END, 4294967295), coalesce(final_id, 4294967295)
           FROM tops t JOIN mids m USING (id) JOIN gates g ON g.mid_id = m.mid_id LEFT JOIN finals f ON f.mid_id = m.mid_id""",
    )
    assert same(hierarchy.counts_by_level(out.members).where("level = 'mid'").select("cluster_id", "n"), "SELECT mid_id, count(*) FROM mids GROUP BY 1")
    assert len(out.gates.select("gate").distinct().collect()) == 2  # both gates occur


def test_artifacts_agree_with_their_manifest(spark, clusters):
    out, root = clusters
    assert {r.name for r in out.manifest.collect()} == {"top_assignments", "centroids", "elbow_trace", "mid_assignments", "lower_gate", "final_assignments", "k_bounds", "membership"}
    assert out.manifest.where("bytes <= 0").count() == 0
    assert writers.read_artifact(spark, root, "membership", out.manifest).count() == 240
    with pytest.raises(ValueError):
        writers.read_artifact(spark, root, "membership", out.manifest.withColumn("digest", F.lit("x")))
    assert [e[3] for e in out.events] == ["stage_start", "stage_end"] * 6


def test_the_first_failing_stage_ends_the_run(spark):
    rows, _ = blobs(spark, 20)
    with pytest.raises(pipeline.StageFailed, match="ids"):
        pipeline.run(rows.unionByName(rows.limit(1)))
    with pytest.raises(pipeline.StageFailed, match="vectors"):
        pipeline.run(rows.unionByName(spark.createDataFrame([(99, [1.0])], "id long, vector array<float>")))
    empty = pipeline.run(rows.limit(0))
    assert empty.members.count() == 0 and empty.chosen_k == 0


def test_membership_of_a_broken_path_fails(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    tops = spark.createDataFrame([(1, 0), (2, 0)], "id long, top_id long")
    mids = spark.createDataFrame([(1, 0, 5)], "id long, top_id long, mid_id long")
    gates = hierarchy.lower_ids(hierarchy.lower_gate(mids))
    with pytest.raises(Exception, match="no whole path"):
        hierarchy.membership(ids, tops, mids, gates, hierarchy.final_clusters(gates)).collect()


def test_several_ks_in_one_pass_are_those_of_one_each(spark):
    rows, x = blobs(spark)
    placed = kmeans.with_position(rows, "id").cache()
    x = np.array([r.vector for r in rows.orderBy("id").collect()], dtype=float)
    for k, (c, j) in zip((3, 5, 9), kmeans.kmeans_each(placed, len(x), [3, 5, 9], 6)):
        want = kmeans.local_kmeans(x, k, 6)
        assert np.allclose(c, want[0], atol=1e-5) and abs(j - want[2]) < 1e-3
    for k, j in zip((2, 7), kmeans.refined_objective(placed, len(x), [2, 7])):
        c = x[[i * len(x) // k for i in range(k)]]
        pick = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[pick == i].mean(axis=0) if (pick == i).any() else c[i] for i in range(k)])
        assert abs(j - ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).mean()) < 1e-9


def test_passes_without_empty_clusters(spark):
    rows, _ = blobs(spark, 120)
    x = np.array([r.vector for r in rows.orderBy("id").collect()], dtype=float)
    got, c, repairs = kmeans.kmeans_no_empty(rows, 7)
    want = kmeans.lloyd_no_empty(x, 7)
    assert np.allclose(c, want[0]) and [r.cid for r in got.orderBy("id").collect()] == want[1].tolist() and repairs == want[2]
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)], "id long, vector array<float>")
    assert kmeans.kmeans_no_empty(same, 3)[1].shape == (3, 2)
    assert kmeans.kmeans_no_empty(rows.limit(0), 3)[0].count() == 0
    k, tried = kmeans.knee_of_sample(rows)
    assert k in tried and 32 <= k <= 120


def test_elbow_stages():
    j = {1: 100.0, 2: 50.0, 3: 25.0, 4: 24.0, 5: 23.5, 6: 23.2}
    assert kmeans.elbow_stage(j.__getitem__, list(j), flat=1.0)[:2] == (3, False)
    assert kmeans.elbow_stage(j.__getitem__, list(j))[:2] == (6, True)  # the gain before is too unlike
    steep = {k: 100.0 / 2**k for k in range(1, 7)}
    assert kmeans.elbow_stage(steep.__getitem__, list(steep))[:2] == (6, True)
    assert kmeans.pruned_grid(list(range(1, 60)), {k: 100.0 / k for k in range(1, 60)})[0] < 13 < kmeans.pruned_grid(list(range(1, 60)), {k: 100.0 / k for k in range(1, 60)})[-1]
    assert kmeans.pruned_grid([1, 2], {1: 5.0, 2: 4.0}) == [1, 2]
    long = {k: 10.0 + 1.0 / k for k in range(1, 200)}
    full, short = (len(kmeans.elbow_stage(long.__getitem__, list(long), patience=p)[2]) for p in (None, 2))
    assert short < full


def test_elbow_search_finds_separate_groups(spark):
    rows, _ = blobs(spark, 200, centres=4)
    k, fallback, c, trace = kmeans.elbow_search(rows, 2, 8, flat=1.0)
    assert k in (3, 4, 5) and not fallback and c.shape == (k, 6) and {t[2] for t in trace} == {"a", "b", "refit"}


def test_lower_split_and_second_level(spark):
    rows, _ = blobs(spark, 300)
    mids = rows.select("id", F.when(F.col("id") < 20, 0).otherwise(1 + F.col("id") % 2).cast("long").alias("mid_id"))
    leaves, evaluations = pipeline.lower_split(rows, mids, 64)
    assert leaves.count() == 300 and leaves.where("mid_id = 0 AND part <> -1").count() == 0 and leaves.where("mid_id > 0 AND part < 0").count() == 0
    assert {r.reason for r in evaluations.collect()} == {"size_below_split_threshold", "size_above_split_threshold", "depth_cap_reached"}
    tops = rows.select("id", F.when(F.col("id") < 5, 9).otherwise(F.col("id") % 2).cast("long").alias("top_id"))
    found, summary = pipeline.second_level(rows, tops, live=rows.where("id % 10 > 0"))
    s = {r.top_id: r for r in summary.collect()}
    assert s[9].reason == "too_few_vectors" and s[0].eligible and s[1].live < s[1].n + 1
    assert found.where("top_id = 9").count() == 0 and found.count() == s[0].live + s[1].live
    assert hierarchy.second_level_summary(summary).first().processed == 2


def test_large_second_level_clusters_go_by_passes(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "LOCAL_VALUES", 100)
    rows, _ = blobs(spark, 60, centres=3)
    found, summary = pipeline.second_level(rows, rows.select("id", F.lit(0).cast("long").alias("top_id")))
    assert found.count() == 60 and summary.first().k == found.agg(F.max("second") + 1).first()[0] or summary.first().k >= 1


def test_health_and_validators(spark):
    row = spark.createDataFrame([(0.95, 0.01, 0.9, 0.01, True)], "mean_nmi double, std_nmi double, mean_jaccard double, mean_drift double, passed boolean")
    assert pipeline.cluster_health(row).first().status == "ok" and not pipeline.cluster_health(row.limit(0)).first().available
    assert checks.stability_violations(row).count() == 0 and checks.stability_violations(row.withColumn("mean_drift", F.lit(-1.0))).count() == 1
    bounds = spark.createDataFrame([(1, "none"), (2, "stop"), (3, "continue"), (3, None)], "stage int, gate string")
    assert checks.gate_violations(bounds).count() == 2
    assert checks.clustering_violations(row.select(F.lit(1).alias("id"), F.lit(0).alias("cid")), row.select(F.lit(0).alias("cid")).limit(0), 0).count() == 0


def test_rows_in_order_without_one_task(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(r.integers(0, 100)), None if r.random() < 0.4 else str(i)) for i in r.permutation(500).tolist()]
    df = spark.createDataFrame(rows, "pos long, v long, t string").repartition(7)
    rows.sort()
    got = {x.pos: x.b for x in order.with_previous(df, F.col("v"), "b", "pos").collect()}
    assert got == {p: rows[i - 1][1] if i else None for i, (p, _, _) in enumerate(rows)}
    got = {x.pos: x.b for x in order.with_greatest_before(df, F.col("v"), "b", "pos").collect()}
    assert got == {p: max((x[1] for x in rows[:i]), default=None) for i, (p, _, _) in enumerate(rows)}
    got = {x.pos: x.b for x in order.with_last_before(df, "t", "b", "pos").collect()}
    assert got == {p: next((x[2] for x in rows[:i][::-1] if x[2]), None) for i, (p, _, _) in enumerate(rows)}
    assert order.with_previous(df.limit(0), F.col("v"), "b", "pos").count() == 0


def test_store_lifecycle(spark, tmp_path):
    table = store.VectorStore(spark, f"{tmp_path}/table")
    with pytest.raises(ValueError):
        table.open()
    table.init()
    with pytest.raises(ValueError):
        store.VectorStore(spark, f"{tmp_path}/table").init()
    batch = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, id long, vector array<float>, metadata string")
    table.insert(batch((1, [1.0], "a"), (2, [2.0], "b"), (3, [3.0], "c")))
    with pytest.raises(ValueError, match="exists"):
        table.insert(batch((2, [5.0], "x")), "strict")
    ids = lambda *i: spark.createDataFrame([(n, x) for n, x in enumerate(i)], "pos long, id long")
    table.remove(ids(2))
    with pytest.raises(ValueError, match="not found"):
        table.remove(ids(2))
    table.update_metadata(spark.createDataFrame([(0, 3, "new")], "pos long, id long, metadata string"))
    state = lambda: sorted((r.id, r.vector, r.metadata) for r in store.live(table.state()).collect())
    want = [(1, [1.0], "a"), (3, [3.0], "new")]
    assert state() == want and table.checkpoint() == 5 and state() == want
    table.insert(batch((4, [4.0], None)))
    assert state() == [*want, (4, [4.0], None)] and table.checkpoint() == 6 and state() == [*want, (4, [4.0], None)]
    again = store.VectorStore(spark, f"{tmp_path}/table").open()
    assert again.snapshot()[1] == 6
    table.close()
    with pytest.raises(ValueError, match="not open"):
        table.flush()


def test_a_small_file_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/pointer"
    writers.write_text(spark, path, "one")
    writers.write_text(spark, path, "two")
    assert writers.read_small(spark, path) == "two"

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(writers, "rename_over", crash)
    with pytest.raises(OSError):
        writers.write_text(spark, path, "three")
    assert writers.read_small(spark, path) == "two"


def test_half_floats_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, []), (4, [65504.0])], "id long, vector array<float>")
    got = rows.select("id", writers.from_half_bits(writers.half_bits("vector")).alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [[1.0, -2.5], None, [], [65504.0]]
    values = reports.monitor_values(spark.createDataFrame([("RAM 5/9MB CPU [7%@1,off] CPU@40.5C GPU@30C",)], "line string")).drop("line")
    writers.monitor_csv(values, f"{tmp_path}/csv")
    r = spark.read.option("header", True).csv(f"{tmp_path}/csv").first()
    assert r.ram_used_mb == "5.0" and r.celsius_CPU == "40.5" and r.celsius_GPU == "30.0"
    writers.append_log(rows, f"{tmp_path}/log", policy="strict_per_record")
    assert len(list((tmp_path / "log").glob("part-*"))) == 4
    with pytest.raises(ValueError):
        writers.append_log(rows, f"{tmp_path}/log", policy="other")


def test_probes():
    assert batching.probe_candidates() == (64, 128, 256, 512, 1024, 2048, 4096) and batching.probe_candidates(most=300, ladder="short") == (64, 128, 256)
    assert batching.probe_candidates((8, 4, -1, 8), 6) == (4,) and batching.probe_candidates(banded=True)[-1] == 16384
    with pytest.raises(ValueError):
        batching.probe_candidates(most=0)
    assert batching.largest_safe((1, 2, 4, 8, 16), lambda n: n <= 4, 10)[0] == 4
    assert batching.largest_safe((1, 2), lambda n: False, 10)[0] is None and batching.largest_safe((4,), lambda n: True, 3) == (None, [])


def test_keys_of_earlier_batches(spark):
    at = lambda s: f"2024-01-01 00:{s:02d}:00"
    rows = [(1, "k", at(1)), (2, "k", at(2)), (3, None, at(2)), (4, None, at(2)), (5, "old", at(3)), (6, "gone", at(3))]
    req = spark.createDataFrame(rows, "job_id long, idem_key string, created string").select("job_id", F.lit("tool").alias("task"), F.lit("{}").alias("payload"), "idem_key", F.col("created").cast("timestamp").alias("created"))
    known = spark.createDataFrame([("old", 90, at(9)), ("gone", 91, at(2))], "idem_key string, job_id long, until string").withColumn("until", F.col("until").cast("timestamp"))
    made = jobs.created(req, known)
    assert {r.job_id: r.existing for r in made["answers"].collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 90, 6: 6}
    assert sorted(r.job_id for r in made["jobs"].collect()) == sorted(r.job_id for r in made["events"].collect()) == [1, 3, 4, 6]
    assert {r.idem_key: r.job_id for r in made["keys"].collect()} == {"k": 1, "gone": 6}


def test_sources(spark, tmp_path):
    u = readers.uniform(spark, 50, 4).collect()
    assert [r.id for r in sorted(u)] == list(range(1, 51)) and all(0 <= x < 1 for r in u for x in r.vector) and u == readers.uniform(spark, 50, 4).collect()
    (tmp_path / "s.bin").write_bytes(writers.sentence_embedding_bytes([1, 2, 1 << 79], np.zeros((3, 8))))
    assert readers.sentence_embedding_count(spark, f"{tmp_path}/s.bin", 8).first().records == 3
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / n).write_bytes(b"\0" * 8)
    with pytest.raises(ValueError, match="single"):
        readers.parallel_files(spark, f"{tmp_path}/two", f"{tmp_path}/two", f"{tmp_path}/two", 2)
    (tmp_path / "big.bin").write_bytes(writers.binary_feed_bytes([1 << 63], np.zeros((1, 2))))
    with pytest.raises(Exception, match="2\\*\\*63"):
        readers.binary_feed(spark, f"{tmp_path}/big.bin", 2).collect()


def test_monitor_time_and_escapes(spark):
    rows = spark.createDataFrame([("01-31-2024 23:59:58 RAM 1/2MB",), ("RAM 1/2MB",)], "line string")
    assert [str(r.t) for r in rows.select(T.monitor_time("line").alias("t")).collect()] == ["2024-01-31 23:59:58", "None"]
    texts = spark.createDataFrame([('a"b\\c\n\té',), ("",)], "t string")
    assert texts.select("t", T.json_unescape(T.json_escape("t")).alias("b")).where("t <> b").count() == 0
