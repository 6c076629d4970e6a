"""Mixing sources to target weights with soft membership.

Domains come from the labels table: "toxic" (toxic 1), else "low" (quality 0), else "clean". One scaled-indicator hinge
model for each domain against the rest is fitted on half of a bounded number of labelled rows, and a softmax over their
margins on the other half, so that the posteriors are calibrated on rows the models haven't seen.

A document d of n_d words gets a rate r_d, the number of times it is drawn. Rates minimise
|S (A r - t)|^2 / 2 + ridge / 2 * sum of n_d / N (r_d - 1)^2 over 0 <= r_d <= max_rate (no bound without one), where (A r)_k
= sum of n_d / N p_dk r_d is the expected share of domain k, t its target, and S weighs a domain by the inverse root of
the share it has (LEAST_SHARE at least), so that a rare domain counts as much as a common one and few steps are needed. The method is
projected gradient, accelerated by momentum that starts again where it leads astray. Each step needs one distributed aggregate of as many numbers as there are domains. No
rates are stored between steps: a document's rate follows from its posteriors and the short list of past residuals, which
is replayed where the document is. Steps end when all targets are met, or when a step moves rates no more: then the
least squares are reached and the targets can't be met with these documents, which is said in a warning that names the
residuals. Without either after most_steps it raises, so unfinished rates are never used.

Defined results: a null text counts as empty, has no words and so no bearing on the totals; its rate follows from the
posteriors that no evidence gives. Label rows with nulls are left out, of several for one doc_id the lowest count. If
fewer than two domains are labelled, the posteriors are 1 for the one labelled (or the first) and all rates are alike.
Without words in the whole table all rates are 1. Repeated rows get equal rates and, as the hash that decides on the
fraction of a rate is one of doc_id and text, equal copies. Long texts are scored whole. An empty table gives an empty
one. Other columns pass through; input columns named like the outputs are replaced.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.llm.common import SMALL_BATCHES, SPACED, drop_table, materialise, set_aside, settings, stored, string_buffers, sub_batches, text_key, token_hashes
from vexil.llm.quality_classifier import BITS, MAX_LABELLED, dual_coordinate_descent, indicators, labelled_features, log_count_ratios, sums

LEAST_SHARE = 0.1
DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.9, "low": 0.04, "toxic": 0.06}


class DomainModel:
    """Margins of each domain's model, and the softmax over them."""

    def __init__(self, models: list, calibration: np.ndarray):
        self.models, self.calibration = models, calibration

    def posteriors(self, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = len(starts) - 1
        if not self.models:
            return np.tile(self.calibration, (n, 1))
        margins = [np.where(np.diff(starts) > 0, sums(w[found], starts) / np.sqrt(np.maximum(sums(squares[found], starts), 1e-12)), 0) + b for w, squares, b in self.models]
        return softmax(np.column_stack([*margins, np.ones(n)]) @ self.calibration)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a softmax regression of y on x, a column of ones included."""
    x = np.column_stack([x, np.ones(len(x))])
    target = np.eye(x.shape[1] - 1)[y]
    w = np.zeros((x.shape[1], x.shape[1] - 1))
    rate = 1.0 / (np.linalg.norm(x, 2) ** 2 / len(x) + ridge)
    ahead = w
    for i in range(steps):
        new = ahead - rate * (x.T @ (softmax(x @ ahead) - target) / len(x) + ridge * ahead)
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w


def fit_domains(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DomainModel:
    """From max_labelled labelled rows at most, those with the smallest hashes of doc_id."""
    rows, (quality, toxic) = labelled_features(docs, labels, ["quality", "toxic"], max_labelled)
    y = np.where(toxic == 1, 2, np.where(quality == 0, 1, 0)) if len(rows) else np.zeros(0, int)
    fit, held = np.arange(len(rows)) % 2 == 0, np.arange(len(rows)) % 2 == 1
    if len(set(y[fit].tolist())) < 2 or not held.any():
        return DomainModel([], np.eye(len(DOMAINS))[int(y[0]) if len(y) else 0])
    models = []
    own = [r for r, f in zip(rows, fit) if f]
    for k in range(len(DOMAINS)):
        side = (y[fit] == k).astype(int)
        scale = log_count_ratios(own, side)
        w, b = dual_coordinate_descent(own, side, scale) if 0 < side.sum() < len(side) else (np.zeros(1 << BITS), -1.0)
        models.append(((w * scale).astype(np.float32), (scale**2).astype(np.float32), float(b)))
    rest = [r for r, h in zip(rows, held) if h]
    found, starts = np.concatenate(rest), np.concatenate([[0], np.cumsum([len(r) for r in rest])])
    raw = DomainModel(models, np.vstack([np.eye(len(DOMAINS)), np.zeros(len(DOMAINS))]))
    margins = [np.where(np.diff(starts) > 0, sums(w[found], starts) / np.sqrt(np.maximum(sums(s[found], starts), 1e-12)), 0) + b for w, s, b in raw.models]
    return DomainModel(models, calibrate(np.column_stack(margins), y[held]))


POSTERIORS = [f"p_{d}" for d in DOMAINS]


def with_posteriors(docs: DataFrame, model, text: bool = True) -> DataFrame:
    """docs with n_tokens (words between white space) and the posteriors; without text if so asked."""
    new = [T.StructField("n_tokens", T.LongType()), *[T.StructField(p, T.DoubleType()) for p in POSTERIORS]]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new} and (text or f.name != "text")]
    names = [f.name for f in [*kept, *new]]

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            n, p = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(DOMAINS)))
            for a, b in sub_batches(offsets):
                n[a:b] = np.diff(token_hashes(data, offsets[a : b + 1], SPACED)[1])
                p[a:b] = model.value.posteriors(*indicators(data, offsets[a : b + 1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(n), *map(pa.array, np.ascontiguousarray(p.T))], names)

    return docs.mapInArrow(run, T.StructType([*kept, *new]))


class Rates:
    """The projected-gradient steps so far; of a document they need its posteriors only. length is the Lipschitz constant of the gradient."""

    def __init__(self, max_rate: float | None, ridge: float, length: float = 1.0):
        self.most, self.ridge, self.length = np.inf if max_rate is None else max_rate, ridge, length
        self.residuals: list[tuple[np.ndarray, bool]] = []  # each with whether it was taken at the rates themselves, without their momentum
        self.share = self.target = np.zeros(len(DOMAINS))

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rates, the point ahead of them at which the next residual may be taken, how far the last step moved, and, where positive, how much its momentum led astray."""
        r = y = np.full(len(p), min(1.0, self.most))
        moved, astray, age = np.ones(len(p)), np.zeros(len(p)), 0
        for e, restart in self.residuals:
            if restart:
                y, age = r, 0
            new = np.clip(y - (p @ e + self.ridge * (y - 1)) / self.length, 0, self.most)
            moved, astray = np.abs(new - y), (y - new) * (new - r)
            y = new + age / (age + 3) * (new - r)
            r, age = new, age + 1
        return r, y, moved, astray

    def missed(self) -> dict[str, float]:
        """Share less target of each domain."""
        return dict(zip(DOMAINS, (self.share - self.target).tolist()))

    def draw(self, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and the copies that u decides on."""
        r = np.round(self.replay(p)[0], 6)
        return r, np.floor(r).astype(np.int64) + (u < r - np.floor(r))


def solve(table: DataFrame, targets: dict[str, float], spend: str | None = None, max_rate: float | None = None, ridge: float = 1e-3, tolerance: float = 1e-3, most_steps: int = 400) -> Rates:
    """Rates for table(n_tokens, p_...). Targets are shares of as many words as there are or, where spend names a domain, of as many as use up that domain's at rate 1; each is met within tolerance of all words."""
    weights, d = np.array([targets[d] for d in DOMAINS], dtype=float), len(DOMAINS)
    weights /= weights.sum()
    products = [(i, j) for i in range(d) for j in range(i, d)]
    n = F.col("n_tokens")
    total, *by = table.agg(F.sum(n), *[F.sum(F.col(p) * n) for p in POSTERIORS], *[F.sum(F.col(POSTERIORS[i]) * F.col(POSTERIORS[j]) * n) for i, j in products]).first()
    if not total:
        return Rates(max_rate, ridge)
    have, gram = np.array(by[:d]) / total, np.zeros((d, d))
    for (i, j), x in zip(products, by[d:]):
        gram[i, j] = gram[j, i] = x / total
    weigh = 1 / np.maximum(have, LEAST_SHARE)  # the square of S
    rates = Rates(max_rate, ridge, float(np.linalg.eigvalsh(np.sqrt(np.outer(weigh, weigh)) * gram).max()) + ridge)
    rates.target = weights * (have[DOMAINS.index(spend)] / weights[DOMAINS.index(spend)] if spend else 1.0)

    def totals(batches, rates=rates):
        out = np.zeros(2 * d + 2)
        for batch in batches:
            p = np.column_stack([batch.column(c).to_numpy() for c in POSTERIORS])
            r, y, moved, astray = rates.replay(p)
            n = batch.column("n_tokens").to_numpy()
            out += np.concatenate([(n * r) @ p, (n * y) @ p, [n @ moved, n @ astray]])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names)

    names = [f"t{i}" for i in range(2 * d + 2)]
    for _ in range(most_steps):
        found = np.array(table.mapInArrow(totals, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first()) / total
        rates.share = found[:d]
        if (np.abs(rates.share - rates.target) <= tolerance).all():
            return rates
        if found[-2] < 1e-5:
            warnings.warn(f"targets can't be met with these documents; shares less targets: {rates.missed()}", stacklevel=2)
            return rates
        restart = bool(found[-1] > 0)
        rates.residuals.append((weigh * ((found[:d] if restart else found[d : 2 * d]) - rates.target), restart))
    raise RuntimeError(f"no end after {most_steps} steps; shares less targets: {rates.missed()}")


def chance(key: Column, seed: int = 11) -> Column:
    """A number in [0, 1) that a row always gets again."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), key), F.lit(1 << 52)).cast("double") / float(1 << 52)


def with_rates(rows: DataFrame, rates: Rates, seed: int = 11) -> DataFrame:
    """rows with rate, rounded to 6 digits, and copies: its whole part, and one more with the probability of the rest, decided by a hash of document and text key."""
    new = [T.StructField("rate", T.DoubleType()), T.StructField("copies", T.LongType())]
    kept = [f for f in rows.schema.fields if f.name not in ("rate", "copies", "__u")]
    names = [f.name for f in [*kept, *new]]

    def run(batches):
        for batch in batches:
            p = np.column_stack([batch.column(c).to_numpy() for c in POSTERIORS])
            r, copies = rates.draw(p, batch.column("__u").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(r), pa.array(copies)], names)

    return rows.withColumn("__u", chance(F.col("__key"), seed)).select(*[f.name for f in kept], "__u").mapInArrow(run, T.StructType([*kept, *new])).drop("__key")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, spend: str | None = None, max_rate: float | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs without text, with n_tokens, posteriors, rate and copies."""
    docs, back = set_aside(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit_domains(docs, labels, max_labelled))
    with settings(docs.sparkSession, SMALL_BATCHES):
        table = materialise(with_posteriors(docs.withColumn("__key", text_key()), model, text=False), "posteriors")
    return back(with_rates(table, solve(table, targets, spend, max_rate)))


def sample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, spend: str | None = None, max_rate: float | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs, each row as often as its copies say. Posteriors are made twice, so that texts need neither be written nor shuffled."""
    columns = docs.columns
    docs, back = set_aside(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit_domains(docs, labels, max_labelled))
    with settings(docs.sparkSession, SMALL_BATCHES):
        table, path = stored(with_posteriors(docs.select("text"), model, text=False), "posteriors")
    rates = solve(table, targets, spend, max_rate)
    drop_table(docs.sparkSession, path)
    names = docs.columns

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for a, b in sub_batches(offsets):
                p, part = model.value.posteriors(*indicators(data, offsets[a : b + 1])), batch.slice(a, b - a)
                copies = rates.draw(p, part.column("__u").to_numpy())[1]
                yield part.select(names).take(pa.array(np.repeat(np.arange(b - a), copies)))

    return back(docs.withColumn("__u", chance(text_key())).mapInArrow(run, docs.schema)).select(columns)
