import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.helpers import odd_rows, prose, table
from vexil.llm import bpe, pivot_search as ps
from vexil.llm.common import read_table


def brute(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = [len(v) for _, v in good]
    dim = max(set(dims), key=lambda d: (dims.count(d), -d))
    good = [(i, v) for i, v in good if len(v) == dim]
    return {(n, i): [round(float(d), 6) for d in sorted(np.sqrt(((v - w) ** 2).sum()) for m, (_, w) in enumerate(good) if m != n)[:k]] for n, (i, v) in enumerate(good)}


@pytest.mark.parametrize("block", [16, 4096])
def test_neighbours_match_brute_force(spark, block):
    rng = np.random.default_rng(block)
    v = np.concatenate([rng.normal(size=(150, 6)), rng.normal(size=(60, 6)) * 0.05 + 3, np.zeros((15, 6))])
    rows = [(int(i), [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = {}
    for r in ps.nearest_neighbours(df, 7, block=block).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.distance, r.neighbour_id)
    for (_, i), want in brute(rows, 7).items():
        assert [got[i][r + 1][0] for r in range(7)] == want
        pairs = [got[i][r + 1] for r in range(7)]
        assert pairs == sorted(pairs) and i not in {n for _, n in pairs}


@pytest.mark.parametrize("shift", [0.0, 1e7, 1e8])
def test_stated_queries_match_brute_force_far_from_the_origin(spark, shift):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=(300, 5)), rng.normal(size=(200, 5)) * 0.05 + 3, np.tile(rng.normal(size=5), (40, 1))]) + shift
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    # small blocks, and queries that come in many chunks
    for r in ps.nearest_neighbours(df, 6, asked=F.col("vec_id") % 3 == 0, block=32, query_bytes=4000).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    assert set(got) == set(range(0, len(v), 3))
    for i, found in got.items():
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        order = sorted((x, j) for j, x in enumerate(d) if j != i)[:6]
        assert sorted(found) == [(n + 1, j, round(float(x), 6)) for n, (x, j) in enumerate(order)]


def test_a_group_of_equal_vectors_larger_than_a_block(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(1000, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = ps.nearest_neighbours(df, 3, asked=F.col("vec_id").isin(0, 250, 1000), block=20).collect()
    assert sorted((r.vec_id, r.rank, r.neighbour_id, r.distance) for r in got if r.vec_id < 1000) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0), (250, 1, 0, 0.0), (250, 2, 1, 0.0), (250, 3, 2, 0.0)]
    assert sorted(r.neighbour_id for r in got if r.vec_id == 1000) == [0, 1, 2]
    assert ps.nearest_neighbours(df, 3, asked=F.col("vec_id") < 0).count() == 0


def test_unusable_vectors_are_left_out(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (None, [0.0, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.neighbour_id, r.rank, r.distance) for r in ps.nearest_neighbours(df, 5).collect())
    assert got == [(1, 2, 1, 1.0), (1, 2, 2, 1.0), (2, 1, 2, 1.0), (2, 1, 2, 1.0), (2, 2, 1, 0.0), (2, 2, 1, 0.0)]
    assert ps.nearest_neighbours(df.limit(0)).count() == 0 and ps.nearest_neighbours(df.limit(1)).count() == 0 and ps.nearest_neighbours(df, 0).count() == 0


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_ranks()


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("brute", pat_str=pattern, mergeable_ranks=bpe.read_ranks(), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_is_encoded_as_merging_does(automaton, reference_encoding, text):
    ids = automaton.encode(text)
    assert ids.tolist() == reference_encoding.encode_ordinary(text) and automaton.decode(ids) == text


def test_corpus_is_encoded_as_merging_does(spark, sf_dir, reference_encoding):
    docs = read_table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in bpe.encode(docs.select("doc_id", "text")).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id].token_ids == reference_encoding.encode_ordinary(r.text) and got[r.doc_id].round_trip


def test_small_merge_lists():
    # any list of merges over two letters, against merging step by step
    rng = np.random.default_rng(0)
    for _ in range(150):
        tokens, merges = [b"a", b"b"], []
        while len(merges) < 8:
            u, v = rng.integers(0, len(tokens), 2)
            if len(tokens[u] + tokens[v]) < 9 and tokens[u] + tokens[v] not in tokens:
                merges.append((int(u), int(v), len(tokens)))
                tokens.append(tokens[u] + tokens[v])
        a = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges)
        for _ in range(40):
            parts = [int(x) for x in rng.integers(0, 2, rng.integers(1, 16))]
            word = b"".join(tokens[p] for p in parts)
            for u, v, uv in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i : i + 2] = [uv]
                    i += 1
            assert a.encode_word(word) == parts, (tokens, merges, word)


def test_tokens_of_odd_rows(spark):
    docs = table(spark, odd_rows(), clash=True)
    got = bpe.encode(docs)
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and all((r.token_ids is None) == (r.n_chars is None) and r.round_trip is not False for r in rows)
    assert {r["__key"] for r in rows} == {"a"} and sum(r.n_tokens == 0 for r in rows) == 1
    back = bpe.decode(got.drop("n_chars")).select("text").collect()
    assert sorted((r.text for r in back), key=str) == sorted((r[1] for r in odd_rows()), key=str)
    assert bpe.encode(table(spark, [])).count() == 0


def test_long_words_take_time_in_proportion(automaton):
    import time

    took = []
    for n in (100_000, 400_000):
        text = "ab" * n
        began = time.perf_counter()
        ids = automaton.encode(text)
        took.append(time.perf_counter() - began)
        assert automaton.decode(ids) == text
    assert took[1] < 12 * took[0] + 0.5


def test_forgotten_transitions_and_words_come_again(reference_encoding, monkeypatch):
    monkeypatch.setattr(bpe.Automaton, "MOST_TRANSITIONS", 50)
    monkeypatch.setattr(bpe.Automaton, "MOST_WORDS", 20)
    a, text = bpe.compile_ranks(), prose(400, 3)
    assert a.encode(text).tolist() == a.encode(text).tolist() == reference_encoding.encode_ordinary(text)
