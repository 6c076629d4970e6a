import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import labels, odd_rows, prose, table
from vexil.llm import mixing, quality_classifier as qc
from vexil.llm.common import read_table


@pytest.fixture(scope="module")
def corpus(spark):
    good = [(i, prose(40, i)) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "$$$" if i % 2 else w.upper() for w in prose(40, i).split())) for i in range(60)]
    toxic = [(2000 + i, prose(30, 900 + i) + " trash trash scum vermin " + prose(5, i)) for i in range(80)]
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(i, 1, 1) for i, _ in toxic]
    return table(spark, good + bad + toxic), labels(spark, marks)


def test_indicators_are_the_distinct_words_and_pairs():
    texts = ["a b a b", "", "b, a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    _, at = qc.indicators(data, offsets)
    assert np.diff(at).tolist() == [4, 0, 5]  # a b ab ba; b , a "b," ",a"


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 8, replace=False)).astype(np.uint32) for _ in range(60)]
    y = np.array([1 if r[0] < 4 else 0 for r in rows])
    scale = qc.log_count_ratios(rows, y, 6)
    w, b = qc.dual_coordinate_descent(rows, y, scale, epochs=3000)

    def loss(w, b):
        cost = {1: 0.5 / np.mean(y == 1), 0: 0.5 / np.mean(y == 0)}
        margin = [(1 if t else -1) * (w[r] @ (scale[r] / np.sqrt((scale[r] ** 2).sum())) + b) for r, t in zip(rows, y)]
        return (w @ w + b * b) / 2 + sum(cost[t] * max(0, 1 - m) for t, m in zip(y, margin))

    base = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(size=64) * 1e-2, b + rng.normal() * 1e-2) >= base - 1e-3


def test_held_out_accuracy(spark, sf_dir):
    docs, marks = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").dropDuplicates(["doc_id"])
    half = F.pmod(F.hash("doc_id"), F.lit(2))
    scored = qc.classify(docs, marks.where(half == 0), keep_all=True).join(marks.where(half == 1), "doc_id")
    hit, good, kept = scored.agg(F.avg(((F.col("quality_score") >= 0).cast("int") == F.col("quality")).cast("double")), F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & (F.col("quality_score") >= 0))).first()
    assert hit > 0.93 and kept / good > 0.98


def test_scores_match_their_definition(spark, corpus):
    docs, marks = corpus
    scale, weights, bias = qc.fit(docs, marks)
    for r in qc.classify(docs, marks, keep_all=True).collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        features = sorted(set(qc.indicators(data, np.array([0, len(data)]))[0].tolist()))
        length = sum(float(scale[f]) ** 2 for f in features) ** 0.5
        assert abs(r.quality_score - (sum(float(weights[f]) for f in features) / max(length, 1e-6) + bias)) < 1e-5
    alone = qc.classify(docs.where("doc_id = 7"), marks, keep_all=True)  # another fit, but batch neighbours bear on nothing
    assert alone.count() == 1


def test_bounds_hold_for_repeated_ids_and_bytes(spark, corpus):
    docs, marks = corpus
    hot = docs.where("doc_id < 3").crossJoin(spark.range(200).select(F.col("id").alias("n"))).withColumn("text", F.concat("text", F.lit(" v"), "n")).select(docs.columns)
    rows, (y,) = qc.labelled_features(docs.unionByName(hot), marks, ["quality"], 50)
    assert len(rows) == len(y) == 50
    rows, _ = qc.labelled_features(docs, marks, ["quality"], 50, max_bytes=2000)
    assert 0 < len(rows) < 50 and sum(r.nbytes for r in rows) <= 2000


def test_odd_rows_are_scored_and_clashing_columns_pass(spark, corpus):
    docs = table(spark, odd_rows(), clash=True)
    all_rows = qc.classify(docs, corpus[1].unionByName(labels(spark, [(None, 1, 0), (3, None, 0), (0, 0, None)])), keep_all=True)
    assert all_rows.count() == docs.count() and all_rows.columns == [*[c for c in docs.columns if c != "quality_score"], "quality_score"]
    assert all_rows.where("text IS NULL OR trim(text) = ''").where("quality_score IS NOT NULL").count() == 0
    assert qc.classify(docs, labels(spark, [])).where("text IS NULL").count() == 0
    same = [r.quality_score for r in all_rows.where("doc_id = 1").where("n_chars > 400").collect()]
    assert len(same) == 2 and same[0] == same[1]
    assert qc.classify(table(spark, []), labels(spark, [])).count() == 0


def test_rates_meet_the_targets_and_match_a_direct_solution(spark, corpus):
    docs, marks = corpus
    targets = {"clean": 0.5, "low": 0.25, "toxic": 0.25}
    rows = mixing.mixing_rates(docs, marks, targets).toPandas()
    p, n, r = rows[mixing.POSTERIORS].to_numpy(), rows["n_tokens"].to_numpy(float), rows["rate"].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (r >= 0).all()
    share = (n * r) @ p / n.sum()
    assert np.abs(share - np.array([0.5, 0.25, 0.25])).max() < 0.02
    # brute force: projected gradient on the documents themselves, rates stored, many more steps
    t, x, y = np.array([0.5, 0.25, 0.25]), np.ones(len(n)), np.ones(len(n))
    weigh = 1 / np.maximum(n @ p / n.sum(), mixing.LEAST_SHARE)
    length = weigh.max() + 1e-3
    for i in range(4000):
        e = weigh * ((n * y) @ p / n.sum() - t)
        new = np.maximum(y - (p @ e + 1e-3 * (y - 1)) / length, 0)
        y = new + i / (i + 3) * (new - x)
        x = new
    assert np.abs((n * x) @ p / n.sum() - share).max() < 0.01


def test_targets_out_of_reach_are_reported(spark, corpus):
    docs, marks = corpus
    with pytest.warns(UserWarning, match="can't be met"):
        rows = mixing.mixing_rates(docs, marks, {"clean": 0.01, "low": 0.01, "toxic": 0.98}, max_rate=1.5).toPandas()
    assert rows["rate"].between(0, 1.5).all()
    twice = docs.where("doc_id < 40").unionByName(docs)
    r = mixing.mixing_rates(twice, marks, {"clean": 0.6, "low": 0.2, "toxic": 0.2}).toPandas().groupby("doc_id")
    assert (r["rate"].nunique() == 1).all() and (r["copies"].nunique() == 1).all()


@pytest.mark.filterwarnings("ignore:targets can't be met")
def test_mixing_of_odd_rows(spark, corpus):
    docs = table(spark, odd_rows(), clash=True)
    rows = mixing.mixing_rates(docs, corpus[1])
    assert rows.count() == docs.count() and rows.where("rate IS NULL OR rate < 0 OR copies < 0").count() == 0
    assert rows.where("n_tokens = 0").count() >= 4
    drawn = mixing.sample(docs, corpus[1], spend="clean", max_rate=1.0)
    assert drawn.columns == docs.columns and drawn.count() <= docs.count()
    assert drawn.select("`__key`", "copies", "token_ids").distinct().collect() == [("a", 7, "x")]
    assert mixing.mixing_rates(table(spark, []), labels(spark, [])).count() == 0
    assert mixing.sample(table(spark, []), labels(spark, [])).count() == 0
    one = mixing.mixing_rates(table(spark, [(1, "a b"), (2, None)]), labels(spark, [(1, 1, 0)]))
    assert {r.doc_id: r.n_tokens for r in one.collect()} == {1: 2, 2: 0}
