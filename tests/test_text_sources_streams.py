import json
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.functions import text as T
from vexil.operators import batching, reports, store
from vexil.sources import readers, writers
from vexil.streaming import jobs


def test_sentences_join_at_abbreviations(spark):
    row = spark.createDataFrame([("Dr. Smith met Mr. Jones. They left at 5 p.m. today! \"Really?\" Yes",)], "t string")
    assert row.select(T.sentences("t")).first()[0] == ["Dr. Smith met Mr. Jones.", "They left at 5 p.m. today!", '"Really?"', "Yes"]


def test_paragraphs(spark):
    row = spark.createDataFrame([("a\r\n  b  \r\r\n\nc",), ("",), (None,)], "t string")
    assert [r[0] for r in row.select(T.paragraphs("t")).collect()] == [["a", "b", "c"], [], None]


def test_packed_ids(spark):
    rows = spark.createDataFrame([(65535, 65535, (1 << 18) - 1, (1 << 14) - 1, 65535), (1, 2, 3, 4, 5), (65536, 0, 0, 0, 0)], "para_line long, char_len long, doc_para_num long, shard_num long, shard_doc_num long")
    packed = rows.select("*", T.pack_id().alias("p"))
    got = packed.collect()
    assert got[0].p == Decimal((1 << 80) - 1) and got[1].p == Decimal(5 << 64 | 4 << 50 | 3 << 32 | 2 << 16 | 1) and got[2].p is None
    back = packed.where("p IS NOT NULL").select(*T.unpack_id(F.col("p"))).collect()
    assert [tuple(r) for r in back] == [tuple(r[:5]) for r in got[:2]]
    with pytest.raises(ValueError):
        T.check_edges((4, 4))


def test_batches_keep_the_budget(spark):
    lens = [5, 9, 2, 30, 30, 1, 1, 1, 1, 100]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(lens)], "doc long, i int, char_len int")
    got = [(r.i, r.batch) for r in batching.greedy_batches(rows, "doc", ["i"], 4, 60).orderBy("i").collect()]
    assert [b for _, b in got] == [0, 0, 0, 1, 1, 2, 2, 2, 2, 3]
    sizes = batching.batch_sizes(batching.dynamic_batches(rows, "doc", ["i"], 4, 60), "doc").collect()
    assert all(r.n == 1 or r.n * r.longest <= 60 for r in sizes) and sum(r.n for r in sizes) == 10


def test_natural_breaks_are_the_best(spark):
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(20):
        v = np.sort(rng.integers(0, 60, 12)).astype(float)
        sse = lambda cuts: sum(((p - p.mean()) ** 2).sum() for p in np.split(v, cuts))
        best = min(sse(c) for c in itertools.combinations(range(1, 12), 2))
        breaks = batching.natural_breaks(v, 3)
        if len(set(v)) > 6:
            assert abs((1 - batching.variance_fit(v, breaks)) * ((v - v.mean()) ** 2).sum() - best) < 1e-6
    assert batching.automatic_edges(np.array([1.0] * 5)) == [] and batching.automatic_edges(np.array([1.0] * 50 + [100.0] * 50)) == [100]


def test_log_replay_and_checkpoint(spark, tmp_path):
    log = spark.createDataFrame([(1, "insert", 7, [1.0], "a"), (2, "update_meta", 7, None, "b"), (3, "delete", 8, None, None), (4, "insert", 9, [2.0], "c"), (5, "delete", 9, None, None), (6, "update_meta", 9, None, "x")], "lsn long, op string, id long, vector array<float>, metadata string")
    state = {r.id: (r.metadata, r.deleted) for r in store.replay(log).collect()}
    assert state == {7: ("b", False), 8: (None, True), 9: (None, True)} or state[9][1]
    lsn = store.checkpoint(log.where("lsn <= 4"), f"{tmp_path}/snap")
    assert lsn == 4 and {r.id for r in store.live(store.replay(log, writers.published(spark, f"{tmp_path}/snap", "snapshot").drop("checkpoint_lsn"), lsn)).collect()} == {7}
    with pytest.raises(ValueError):
        store.append_inserts(log, spark.createDataFrame([(1, 7, [0.0], "")], "pos long, id long, vector array<float>, metadata string"), "strict")
    assert store.append_inserts(log, spark.createDataFrame([(1, 77, [0.0], "")], "pos long, id long, vector array<float>, metadata string")).agg(F.max("lsn")).first()[0] == 7


def test_readers(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"embedding_id": 1, "vector": [1, 2]}\n\n{"embedding_id": 2, "vector": [3, 4]}\n')
    assert [tuple(r) for r in readers.jsonl_vectors(spark, f"{tmp_path}/v.jsonl", 2).orderBy("id").collect()] == [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    with pytest.raises(Exception, match="bad vector"):
        readers.jsonl_vectors(spark, f"{tmp_path}/v.jsonl", 3).collect()
    (tmp_path / "c.jsonl").write_text('{"embedding_id": 1, "vec_csv": "1, 2", "meta_json": "{}"}\n{"embedding_id": 2, "vec_csv": "1,,2"}\n')
    assert [tuple(r) for r in readers.jsonl_csv_vectors(spark, f"{tmp_path}/c.jsonl").collect()] == [(1, [1.0, 2.0], "{}")]
    feed = writers.binary_feed_bytes([3, 4], [[1, 2], [5, 6]])
    (tmp_path / "feed.bin").write_bytes(feed)
    assert [tuple(r) for r in readers.binary_feed(spark, f"{tmp_path}/feed.bin", 2).collect()] == [(3, [1.0, 2.0]), (4, [5.0, 6.0])]
    for i, bad in enumerate((feed[:10], b"XXXX" + feed[4:], feed + b"0", feed[:-1], feed[:4] + struct.pack("<H", 2) + feed[6:])):
        (tmp_path / f"bad{i}.bin").write_bytes(bad)
        with pytest.raises(Exception):
            readers.binary_feed(spark, f"{tmp_path}/bad{i}.bin", 2).collect()
    (tmp_path / "s.bin").write_bytes(writers.sentence_embedding_bytes([(1 << 80) - 1, 5], [[0.5, 1.0], [2.0, 3.0]]))
    assert [(r.record, int(r.packed), r.vector) for r in readers.sentence_embeddings(spark, f"{tmp_path}/s.bin", 2).collect()] == [(0, (1 << 80) - 1, [0.5, 1.0]), (1, 5, [2.0, 3.0])]
    (tmp_path / "i.u64").write_bytes(np.array([9, 8], "<u8").tobytes())
    (tmp_path / "v.f32").write_bytes(np.array([[1, 2], [3, 4]], "<f4").tobytes())
    (tmp_path / "m.txt").write_text("a\nb\n")
    assert {tuple(map(str, r)) for r in readers.parallel_files(spark, f"{tmp_path}/i.u64", f"{tmp_path}/v.f32", f"{tmp_path}/m.txt", 2).collect()} == {("9", "[1.0, 2.0]", "a"), ("8", "[3.0, 4.0]", "b")}


def test_text_files(spark, tmp_path):
    for name, data in {"b.TXT": b"two", "a.md": b"one", ".hidden.txt": b"x", "empty.txt": b"", "c.bin": b"x", "bad.txt": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(data)
    got = [(r.path.rsplit("/", 1)[1], r.text) for r in readers.read_text(readers.discover_text(spark, str(tmp_path))).collect()]
    assert sorted(got) == [("a.md", "one"), ("b.TXT", "two"), ("bad.txt", None)]


def test_baseline(spark, tmp_path):
    assert readers.baseline(spark, f"{tmp_path}/none")[1] == "no_previous_run_baseline"
    (tmp_path / "b.json").write_text('{"stage_id": "a", "elapsed_ms": 1.5}\nnonsense\n{"stage_id": "b", "elapsed_ms": -1}\n')
    rows, reason = readers.baseline(spark, f"{tmp_path}/b.json")
    assert reason is None and [tuple(r) for r in rows.collect()] == [("a", 1.5)]
    (tmp_path / "c.json").write_text("nonsense\n")
    assert readers.baseline(spark, f"{tmp_path}/c.json")[1] == "baseline_parse_failed"


def test_artifacts_and_precisions(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i / 3, -i / 7]) for i in range(50)], "id long, vector array<float>")
    a = writers.write_artifact(rows, str(tmp_path), "vectors").first()
    assert a.rows == 50 and a.digest == writers.digest(rows.repartition(7)).first().digest
    assert writers.published(spark, str(tmp_path), "vectors").count() == 50
    assert json.loads(writers.manifest(spark.createDataFrame([a])).first()[0])["artifacts"][0]["name"] == "vectors"
    p = writers.precisions(rows).select("vector", writers.from_half_bits("half").alias("h")).collect()
    assert all(abs(x - y) <= 0.01 for r in p for x, y in zip(r.vector, r.h))


def test_synthetic_vectors(spark):
    rows = readers.synthetic(spark, 200, 8, clusters=4, outliers=0.1)
    again = readers.synthetic(spark, 200, 8, clusters=4, outliers=0.1).repartition(5)
    assert rows.exceptAll(again).count() == 0 and rows.count() == 200 and 0 < rows.where("cluster = -1").count() < 60


def test_monitor_lines(spark):
    line = "RAM 1000/2000MB SWAP 1/2MB CPU [10%@729,off,30%@729] EMC_FREQ 5% GR3D_FREQ 45%@[1300,1300] CPU@40.5C VDD_IN 3000mW/2900mW"
    r = reports.monitor_values(spark.createDataFrame([(line,), ("",)], "line string")).collect()
    assert (r[0].ram_used_mb, r[0].gpu_percent, r[0].cpu_percent, r[0].celsius, r[0].power_mw) == (1000.0, 45.0, [10.0, None, 30.0], {"CPU": 40.5}, 3000.0) and r[1].ram_used_mb is None


COMMANDS = [(1, 1, "create"), (1, 2, "run"), (1, 3, "cancel"), (1, 4, "done"), (2, 5, "run"), (2, 6, "create"), (2, 7, "create"), (2, 8, "done"), (2, 9, "cancel")]


def test_job_state_machine_as_stream_and_as_table(spark, tmp_path):
    rows = spark.createDataFrame(COMMANDS, "job_id long, seq long, command string").withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    for i, part in enumerate(("seq <= 4", "seq > 4")):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.job_states(jobs.event_stream(spark, f"{tmp_path}/in", rows.schema, 1))
    q = stream.writeStream.format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.job_id, r.seq, r.before, r.status, r.applied) for r in spark.table("states").collect()}
    want = {(r.job_id, r.seq, r.before, r.status, r.applied) for r in jobs.replay_states(rows).collect()}
    assert got == want and (1, 4, "canceled", "canceled", False) in got and (2, 5, "none", "none", False) in got


def test_upserts_survive_a_repeated_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, seq long, v string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = jobs.upsert_batches(jobs.event_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", ["id"], "seq", f"{tmp_path}/c{_}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {tuple(r) for r in writers.published(spark, f"{tmp_path}/out", "table").collect()} == {(1, 2, "b"), (2, 1, "c")}


def test_new_jobs_by_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "job_id long, idem_key string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = jobs.new_jobs(jobs.event_stream(spark, f"{tmp_path}/in", rows.schema)).writeStream.format("memory").queryName("created").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.job_id for r in spark.table("created").collect()) == [1, 3, 4]


def test_failed_jobs_become_dead_letters(spark):
    rows = spark.createDataFrame([(1, 1, "tool", "{}"), (2, 2, " ", "{}")], "msg_id long, job_id long, task string, payload string")
    failed = jobs.with_failures(rows, jobs.echo(rows)).withColumns({"ts": F.lit(0), "error": F.lit("no task"), "traceback": F.lit("")})
    letter = reports.dead_letters(failed, "q", "g", "w").collect()
    assert [r.src_msg_id for r in letter] == [2] and json.loads(letter[0].raw)["job_id"] == 2
