"""Quality classifier: Naive Bayes support vectors.

Tokens (runs of word characters, runs of other signs) and pairs of neighbouring tokens are hashed into 2**bits
indicators. Each indicator is scaled by the log ratio of its smoothed counts in good and bad documents, rows are
scaled to length 1, and a linear hinge-loss model is fitted by dual coordinate descent.

The fit sees at most max_labelled labelled documents, those with the smallest hashes of doc_id, and of these as many as
have max_bytes of indicators at most. A doc_id counts as one document however many rows repeat it, so both bounds hold
for rows too: the labels are broadcast, and no more than that reaches the driver. Every document is scored, over its whole text,
where it is read.

Defined results: a null text counts as empty; a text without a token has no score and is rejected; a long text is scored
whole. Label rows with a null are left out; of several labels for one doc_id the lowest counts, of several texts the one
whose packed indicators are least. Repeated documents each get their own, equal result; a score that equals the threshold
is kept. An empty table gives an empty one. Without labels of both classes nothing can be learnt: every document with a token scores 0 and is kept. Other
columns pass through, but an input column named like the score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.llm.common import CLASS, SMALL_BATCHES, U64, documents_of, drop_table, mix, settings, stored, string_buffers, sub_batches, token_hashes

BITS = 18
MAX_LABELLED, MAX_BYTES = 8000, 64 << 20
SCORE = "quality_score"


def indicators(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each document, one document after another, and the n + 1 offsets."""
    h, at = token_hashes(data, offsets, CLASS)
    doc = documents_of(at)
    pairs = mix(h[:-1] * U64(3) + h[1:])[doc[:-1] == doc[1:]]
    shift = U64(64 - bits)
    key = np.concatenate([(doc.astype(U64) << U64(bits)) | (h >> shift), (doc[:-1][doc[:-1] == doc[1:]].astype(U64) << U64(bits)) | (pairs >> shift)])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    starts = np.searchsorted(key, np.arange(len(offsets), dtype=U64) << U64(bits))
    return (key & U64((1 << bits) - 1)).astype(np.uint32), starts


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each range of values, whatever lies beside it; 0 for an empty range. The ranges lie one after another and cover all values."""
    out, has = np.zeros(len(starts) - 1), np.flatnonzero(starts[1:] > starts[:-1])
    if len(has):
        out[has] = np.add.reduceat(values.astype(np.float64), starts[has])
    return out


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0) -> np.ndarray:
    """log of the share of an indicator among good documents over that among bad ones; 0 where it never occurs."""
    size = 1 << bits
    counts = [np.bincount(np.concatenate([np.zeros(0, np.uint32), *[r for r, y in zip(rows, labels) if y == side]]), minlength=size)[:size].astype(float) for side in (1, 0)]
    good, bad = (c + alpha for c in counts)
    ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    ratio[(counts[0] + counts[1]) == 0] = 0
    return ratio


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Minimises |w|^2 / 2 + sum of C_i max(0, 1 - y_i (w x_i + b)) over its dual, one multiplier at a time.

    C_i is c times the inverse share of the row's class, so that a rare class weighs as much as a common one.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(y > 0, 0.5 / max(np.mean(y > 0), 1e-9), 0.5 / max(np.mean(y < 0), 1e-9)) * c
    x = [scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-12) for r in rows]
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ x[i] + b) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # a row and the bias have length 1 each
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, b


def labelled_rows(docs: DataFrame, labels: DataFrame, columns: list[str], max_labelled: int) -> DataFrame:
    """Texts of at most max_labelled labelled documents, joined to a broadcast of that bounded size."""
    known = labels.select("doc_id", *columns).dropna().groupBy("doc_id").agg(*[F.min(c).alias(f"__{c}") for c in columns])
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("doc_id", "text", *[F.col(f"__{c}").cast("int").alias(f"__{c}") for c in columns])


def feature_rows(joined: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """doc_id, the label columns and the packed indicators of each row."""

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            packed = []
            for a, b in sub_batches(offsets):
                found, starts = indicators(data, offsets[a : b + 1], bits)
                packed += [found[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in columns], pa.array(packed, pa.binary())], ["doc_id", *columns, "features"])

    return joined.mapInArrow(run, T.StructType([joined.schema["doc_id"], *[joined.schema[c] for c in columns], T.StructField("features", T.BinaryType())]))


def labelled_features(docs: DataFrame, labels: DataFrame, columns: list[str], max_labelled: int, bits: int = BITS, max_bytes: int = MAX_BYTES) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The indicators of at most max_labelled labelled documents with max_bytes altogether, one row for each doc_id in order of its hash, and their label columns."""
    names = [f"__{c}" for c in columns]
    rows = feature_rows(labelled_rows(docs, labels, columns, max_labelled), names, bits)
    spark, order = docs.sparkSession, [F.xxhash64("doc_id"), F.col("doc_id")]
    with settings(spark, SMALL_BATCHES):
        each, path = stored(rows.groupBy("doc_id", *names).agg(F.min("features").alias("features")), "labelled")
    sizes = each.select(*order, F.length("features").alias("n")).orderBy(*order).toArrow().column("n").to_numpy()  # max_labelled numbers
    take = int(np.searchsorted(np.cumsum(sizes), max_bytes, "right"))
    table = each.orderBy(*order).limit(take).toArrow()
    drop_table(spark, path)
    return [np.frombuffer(x.as_py(), np.uint32) for x in table.column("features")], [table.column(c).to_numpy().astype(int) for c in names]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, bits: int = BITS, c: float = 1.0) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Scales, weights (by scaled indicator) and bias; None where labels of both classes are lacking."""
    rows, (y,) = labelled_features(docs, labels, ["quality"], max_labelled, bits)
    use = [i for i, r in enumerate(rows) if len(r)]
    rows, y = [rows[i] for i in use], y[use] if len(use) else y[:0]
    if len(set(y.tolist())) < 2:
        return None
    scale = log_count_ratios(rows, y, bits)
    w, b = dual_coordinate_descent(rows, y, scale, c)
    return scale.astype(np.float32), (w * scale).astype(np.float32), float(b)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.0, max_labelled: int = MAX_LABELLED, bits: int = BITS, keep_all: bool = False) -> DataFrame:
    """The documents whose score is threshold at least, with all their columns and the score; with keep_all, every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled, bits))
    kept = [f for f in docs.schema.fields if f.name != SCORE]

    def run(batches):
        m = model.value
        if m is not None:
            squares = m[0] ** 2
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for a, b in sub_batches(offsets):
                found, starts = indicators(data, offsets[a : b + 1], bits)
                if m is None:
                    own = np.zeros(b - a)
                else:
                    own = sums(m[1][found], starts) / np.sqrt(np.maximum(sums(squares[found], starts), 1e-12)) + m[2]
                scores, part = np.where(np.diff(starts) > 0, own, np.nan), batch.slice(a, b - a)
                out = pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(scores, pa.float64(), from_pandas=True)], [*[f.name for f in kept], SCORE])
                yield out if keep_all else out.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(SCORE, T.DoubleType())]))
