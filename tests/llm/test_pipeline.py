"""Each stage of the pipeline against a brute-force version of it, over what the stage before kept."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.helpers import labels, odd_rows, prose, table
from llm.test_dedup import first_lines, jaccard, words
from vexil.llm import bpe, mixing, quality_classifier as qc
from vexil.llm.common import materialise, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage was given, and what it gave."""
    out, docs = [], read_table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "stage")
        out.append((name, before, docs))
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_are_in_order(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_quality_stage_rejects_by_score(spark, sf_dir, stages):
    _, docs, kept = stages[0]
    scale, weights, bias = qc.fit(docs, read_table(spark, sf_dir, "labels"))
    want = []
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        f = qc.indicators(data, np.array([0, len(data)]))[0]
        score = weights[f].astype(float).sum() / max(float((scale[f].astype(float) ** 2).sum()), 1e-12) ** 0.5 + bias if len(f) else -1
        assert abs(score) > 1e-6
        if score >= 0:
            want.append((r.doc_id, r.text))
    assert pairs(kept) == sorted(want)


def test_line_stage_keeps_first_places(stages):
    _, docs, kept = stages[1]
    assert pairs(kept) == sorted(first_lines(pairs(docs)))
    assert kept.where("n_chars <> length(text)").count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    _, docs, kept = stages[2]
    texts, left = dict(pairs(docs)), dict(pairs(kept))
    assert len(left) == kept.count() and left.items() <= texts.items()
    shingles = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, t in texts.items() if (w := words(t))}
    holders = {}
    for i, s in shingles.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter(p for own in holders.values() if len(own) > 1 for p in itertools.combinations(sorted(own), 2))
    alike = {p: n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n) for p, n in shared.items()}
    sure = [p for p, s in alike.items() if s >= 0.6]
    assert not [p for p in sure if p[0] in left and p[1] in left]
    gone = texts.keys() - left.keys()
    assert all(any(i in p and s > 0.3 for p, s in alike.items()) for i in gone)


def test_mixing_stage_meets_its_targets(spark, sf_dir, stages):
    _, docs, drawn = stages[3]
    marks = read_table(spark, sf_dir, "labels")
    table = mixing.mixing_rates(docs, marks, corpus_pipeline.TARGETS).toPandas()
    p, n, r = table[mixing.POSTERIORS].to_numpy(), table["n_tokens"].to_numpy(float), table["rate"].to_numpy()
    target = np.array([corpus_pipeline.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs((n * r) @ p / n.sum() - target).max() < 1.5e-3 and (r > 1).any()
    got = Counter(x.doc_id for x in drawn.collect())
    assert got == Counter({i: c for i, c in zip(table["doc_id"], table["copies"]) if c})
    clean = [x.doc_id for x in marks.where("quality = 1 AND toxic = 0").select("doc_id").collect()]
    had = [i for i in clean if i in set(table["doc_id"])]
    assert np.mean([i in got for i in had]) > 0.95
    assert set(pairs(drawn)) <= set(pairs(docs))


def test_token_stage_encodes_as_merging_does(stages):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    brute = tiktoken.Encoding("brute", pat_str=pattern, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    _, docs, tokens = stages[4]
    assert tokens.where("NOT round_trip").count() == 0
    got = sorted((r.doc_id, tuple(r.token_ids)) for r in tokens.collect())
    assert got == sorted((r.doc_id, tuple(brute.encode_ordinary(r.text))) for r in docs.collect())


@pytest.mark.filterwarnings("ignore:targets can't be met")
def test_pipeline_of_odd_rows(spark, tmp_path):
    marks = [(i, 1, 0) for i in range(0, 40)] + [(i, 0, 0) for i in range(100, 120)] + [(i, 1, 1) for i in range(200, 230)]
    rows = [(i, prose(20, i), "en", "web") for i in range(40)] + [(i, " ".join(w + "%%%" for w in prose(20, i).split()), "en", "web") for i in range(100, 120)] + [(i, prose(20, i) + " trash vermin scum", "en", "web") for i in range(200, 230)]
    table(spark, rows + odd_rows(), clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, marks).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "__key", "n_tokens", "round_trip").collect()
    ids = {r.doc_id for r in got}
    assert {r["__key"] for r in got} == {"a"} and all(r.round_trip and r.n_tokens > 0 for r in got)
    assert not ids & {2, 3, 4} and not ids & set(range(100, 120)) and len(ids & set(range(40))) > 36
    table(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
