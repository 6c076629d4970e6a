import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import odd_rows, prose, table
from vexil.llm import line_dedup, minhash_dedup as mh, substring_dedup as sd
from vexil.llm.components import connected_components


def first_lines(rows):
    """Brute force: rows of (doc_id, text) with distinct ids."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is None or not text.strip(" \n"):
            out.append((i, text))
            continue
        lines, real = [], False
        for line in text.split("\n"):
            blank = not line.strip(" ")
            if blank or line not in seen:
                lines.append(line)
                real |= not blank
                seen.add(line)
        if real:
            out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_lines_stay_at_their_first_place(spark, batches):
    r = random.Random(batches)
    pool = [prose(4, i) for i in range(60)] + ["", " ", "  ", "\t", "x\r"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for i in range(120)] + [(500, None), (501, ""), (502, "\n\n")]
    got = line_dedup.deduplicate(table(spark, rows), batches).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(first_lines(rows), key=str)


def test_later_batches_meet_the_runs_of_earlier_ones(spark, tmp_path):
    r = random.Random(8)
    pool = [prose(4, i) for i in range(80)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(5))) for i in range(100)]
    want, got = sorted(first_lines(rows)), []
    for b in range(5):
        runs = line_dedup.LineRuns.open(spark, f"{tmp_path}/runs", 2)  # each batch as a job of its own
        got += map(tuple, line_dedup.add_batch(table(spark, rows[20 * b : 20 * b + 20]), runs).select("doc_id", "text").collect())
        runs.close()
    assert sorted(got) == want
    assert [len(x) for x in line_dedup.LineRuns.open(spark, f"{tmp_path}/runs").levels] == [1, 1]
    (tmp_path / "runs" / "manifest-999999999999").write_text('{"version": 9')  # a manifest that was not finished
    runs = line_dedup.LineRuns.open(spark, f"{tmp_path}/runs")
    assert len(runs.all()) == 2 and line_dedup.add_batch(table(spark, rows), runs).count() == 0


def test_ids_of_other_types_and_runs_in_order(spark):
    docs = table(spark, [(i, f"line {i % 7}\nline {i}") for i in range(40)])
    by_text = line_dedup.deduplicate(docs.withColumn("doc_id", F.format_string("d%03d", "doc_id")), 4).select("doc_id", "text").collect()
    by_number = line_dedup.deduplicate(docs, 4).select("doc_id", "text").collect()
    assert sorted((int(r.doc_id[1:]), r.text) for r in by_text) == sorted(map(tuple, by_number))
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_line_dedup_of_odd_rows(spark):
    docs = table(spark, odd_rows(), clash=True)
    got = line_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    texts = [r.text for r in rows if r.doc_id == 1 and r.n_chars > 400]
    assert len(texts) == 2 and texts[0] == texts[1] == prose(60, 1)  # repeated rows come out alike
    assert [r.text for r in rows if r.doc_id == 9] == ["two\n"]
    assert sum(r.text is None for r in rows) == 2 and {r["__key"] for r in rows} == {"a"} and {r["__keep"] for r in rows} == {"b"}
    assert line_dedup.deduplicate(table(spark, [])).count() == 0


def brute_intervals(rows, m):
    docs = [(i, re.findall(r"[^ \t\n\r\x0b\f]+", t or "")) for i, t in rows]
    count = {}
    for _, w in docs:
        for s in range(len(w) - m + 1):
            count[tuple(w[s : s + m])] = count.get(tuple(w[s : s + m]), 0) + 1
    out = []
    for i, w in docs:
        covered = sorted(s for s in range(len(w) - m + 1) if count[tuple(w[s : s + m])] > 1)
        for s in covered:
            if out and out[-1][0] == i and s <= out[-1][2]:
                out[-1][2] = s + m
            else:
                out.append([i, s, s + m])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("hot", [4000, 2])
def test_passages_match_brute_force(spark, hot):
    r = random.Random(5)
    shared = [prose(30, 1000 + i).split() for i in range(5)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(1, 5)):
            s = r.choice(shared)
            a = r.randrange(0, 12)
            w += [*s[a : a + r.randrange(3, 30)], *prose(r.randrange(0, 15), 10_000 + i).split()]
        rows.append((i, " ".join(w)))
    rows += [(100, "a " * 40), (101, "a b " * 30)]
    got = sd.repeated_passages(table(spark, rows), 12, shard_blocks=7, hot=hot).collect()
    assert sorted(map(tuple, got)) == brute_intervals(rows, 12)


def test_long_documents_are_gone_through_in_parts(spark, monkeypatch):
    rows = [(i, " ".join([prose(40, i), prose(15, 77), prose(200, 50 + i), prose(13, 78)])) for i in range(6)]
    monkeypatch.setattr(sd, "PLACES", 64)
    assert sorted(map(tuple, sd.repeated_passages(table(spark, rows), 12).collect())) == brute_intervals(rows, 12)


def test_a_passage_beyond_16_million_words_has_the_anchors_of_one_before():
    n = (1 << 24) + 400_000
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, n).astype(np.uint64)
    passage = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    places = (100, 1_000_000, n - 1000)
    for p in places:
        h[p : p + 400] = passage
    _, start, windows, anchor, content = sd.blocks(h, np.array([0, n]))
    inside = []
    for p in places:
        own = np.flatnonzero((start >= p) & (start + windows + sd.MIN_WORDS - 1 <= p + 400))
        inside.append(sorted(zip((start[own] - p).tolist(), anchor[own].tolist(), content[own].tolist())))
    assert len(inside[0]) > 5 and inside[0][1:-1] == inside[1][1:-1] == inside[2][1:-1]


def test_backward_search_counts(spark):
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 4, 30).astype(np.uint64) for _ in range(12)]
    text = [b.tolist() for b in blocks]
    who, a, b = sd.repeated_intervals(blocks, np.arange(12), 5)
    found = {(int(i), s) for i, x, y in zip(who, a, b) for s in range(x, y - 4)}
    count = {}
    for w in text:
        for s in range(len(w) - 4):
            count[tuple(w[s : s + 5])] = count.get(tuple(w[s : s + 5]), 0) + 1
    assert found == {(i, s) for i, w in enumerate(text) for s in range(len(w) - 4) if count[tuple(w[s : s + 5])] > 1}


def test_passages_of_odd_rows(spark):
    docs = table(spark, odd_rows(), clash=True)
    got = sorted(map(tuple, sd.repeated_passages(docs).collect()))
    assert got == [(1, 0, 60)]  # a repeated row is repeated throughout and reported once
    assert sd.repeated_passages(table(spark, [])).count() == 0
    assert sd.repeated_passages(table(spark, [(1, None), (2, "")])).count() == 0


def words(text):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+", text.lower())


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(1)
    rows = [(i, prose(r.randrange(30, 90), i)) for i in range(80)]
    for i in range(60):
        w = rows[i][1].split()
        for _ in range(i % 5 * len(w) // 60):
            w[r.randrange(len(w))] = "changed" + str(r.randrange(1000))
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, prose(50, 5).upper()) for i in range(30)]
    gone = {x.doc_id: x.keeper_id for x in mh.near_duplicates(table(spark, rows)).collect()}
    text = dict(rows)
    sure = {(a, b) for a, b in itertools.combinations(text, 2) if jaccard(text[a], text[b]) >= 0.55}
    assert sum(b in gone for _, b in sure) >= 0.97 * len(sure)
    assert all(jaccard(text[a], text[b]) > 0.3 for a, b in gone.items())
    assert not any(a in gone for a in range(60) if not any(a == y for _, y in sure))


def test_large_buckets_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mh, "CHUNK", 3)
    base = prose(80, 1).split()
    rows = [(i, " ".join([*base[:i], "new" + str(i), *base[i + 1 :]])) for i in range(40)]
    assert mh.deduplicate(table(spark, rows)).count() == 1


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 1 << 32, (2000, mh.HASHES), dtype=np.uint32)
    other = np.where(rng.random(m.shape) < 0.6, m, rng.integers(0, 1 << 32, m.shape, dtype=np.uint32))
    assert abs(mh.estimate(mh.pack(m), mh.pack(other)).mean() - 0.6) < 0.01


def test_near_dedup_of_odd_rows(spark):
    docs = table(spark, odd_rows(), clash=True)
    left = mh.deduplicate(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(r.n_chars or 0 for r in rows if r.doc_id == 1) == sorted({len(prose(60, 1)), len(prose(30, 2))})
    assert sum(r.text is None for r in rows) == 2 and {r["__key"] for r in rows} == {"a"} and {r["__n"] for r in rows} == {"c"}
    assert mh.deduplicate(table(spark, [])).count() == 0 and mh.near_duplicates(table(spark, [])).count() == 0


def test_rows_without_words_all_stay(spark):
    rows = [(1, ""), (1, ""), (2, None), (2, None), (None, ""), (None, ""), (3, "...")]
    assert mh.near_duplicates(table(spark, rows)).count() == 0 and mh.deduplicate(table(spark, rows)).count() == 7
    twice = rows + [(4, prose(20, 1))] * 3 + [(None, prose(20, 1)), (None, prose(20, 9)), (None, prose(20, 9))]
    left = mh.deduplicate(table(spark, twice)).collect()
    assert len(left) == 9 and sorted((r.doc_id is None, r.text) for r in left if r.text and r.text not in ("", "...")) == sorted([(True, prose(20, 1)), (True, prose(20, 9))])


def test_capitals_with_accents_are_folded(spark):
    text = " ".join(w + "é" for w in prose(40, 2).split())
    assert mh.deduplicate(table(spark, [(1, text), (2, text.upper())])).count() == 1


def test_components_are_never_returned_unfinished(spark):
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), most_rounds=1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (102, 102), (None, 5), (200, 201), (200, 202), (200, 203)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200, 203: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
