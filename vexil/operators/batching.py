"""Batches of sentences under a budget of characters, and length bands by natural breaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BATCH, MAX_CLASSES, GVF, SAMPLE = 64, 6, 0.85, 2000


def _numbered(rows: DataFrame, group: str, order: list[str], step: str, start: str) -> DataFrame:
    order = list(dict.fromkeys(order))
    rest = [] if "char_len" in order else ["char_len"]
    lists = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("__s"))
    states = F.expr(f"aggregate(__s, struct({start} AS st, cast(array() as array<int>) AS ids), (acc, x) -> {step})").getField("ids")
    return lists.select(group, F.explode(F.arrays_zip("__s", states.alias("ids"))).alias("__z")).select(group, *[F.col(f"__z.__s.{c}").alias(c) for c in [*order, *rest]], F.col("__z.ids").alias("batch"))


def greedy_batches(rows: DataFrame, group: str, order: list[str], size: int = BATCH, budget: int | None = None) -> DataFrame:
    """(group, order columns, char_len, batch): rows in order; a batch ends at size rows, or before a row with which longest * rows would pass the budget. Batches count from 0 in each group.

    A fold within each group, which is one document's sentences, so it fits a row.
    """
    if size < 1 or budget is not None and budget < 1:
        raise ValueError("size and budget must be 1 at least")
    full = f"acc.st.n = {size}"
    over = f" OR (acc.st.n > 0 AND cast(greatest(acc.st.longest, x.char_len) AS bigint) * (acc.st.n + 1) > {budget})" if budget is not None else ""
    fresh = f"({full}{over})"
    step = f"""struct(struct(if({fresh}, acc.st.b + 1, acc.st.b) AS b, if({fresh}, 1, acc.st.n + 1) AS n, if({fresh}, x.char_len, greatest(acc.st.longest, x.char_len)) AS longest) AS st,
        concat(acc.ids, array(if({fresh}, acc.st.b + 1, acc.st.b))) AS ids)"""
    return _numbered(rows.withColumn("char_len", F.col("char_len").cast("int")), group, order, step, "struct(0 AS b, 0 AS n, 0 AS longest)")


def dynamic_batches(rows: DataFrame, group: str, order: list[str], ceiling: int = BATCH, budget: int = 8192) -> DataFrame:
    """The same for rows by rising char_len: each batch is as long as char_len * rows fits the budget, one row at least. With rising lengths that is the greedy rule."""
    return greedy_batches(rows, group, ["char_len", *[c for c in order if c != "char_len"]], ceiling, budget)


SHORT_LADDER = tuple(64 << i for i in range(5))
FULL_LADDER = tuple(64 << i for i in range(9))


def probe_candidates(given: tuple[int, ...] | None = None, most: int | None = None, banded: bool = False, ladder: str = "full") -> tuple[int, ...]:
    """The batch sizes to try, rising: those given that are positive, or a ladder of powers up to most (without it 4096, or 16384 for banded lengths)."""
    if most is not None and most < 1:
        raise ValueError("most must be 1 at least")
    if given is not None:
        return tuple(c for c in sorted({c for c in given if c > 0}) if most is None or c <= most)
    if ladder not in ("full", "short"):
        raise ValueError(f"no such ladder: {ladder}")
    top = most if most is not None else 16384 if banded else 4096
    return tuple(c for c in (FULL_LADDER if ladder == "full" else SHORT_LADDER) if c <= top)


def largest_safe(candidates: tuple[int, ...], works, available: int) -> tuple[int | None, list[int]]:
    """The largest candidate up to available for which works(candidate) holds, by bisection, and those tried; None if none does."""
    fit, tried, best = [c for c in candidates if c <= available], [], None
    low, high = 0, len(fit) - 1
    while low <= high:
        mid = (low + high) // 2
        tried.append(fit[mid])
        if works(fit[mid]):
            best, low = fit[mid], mid + 1
        else:
            high = mid - 1
    return best, tried


def largest_safe_of(attempts: DataFrame, group: str) -> DataFrame:
    """(group, batch): the largest size of attempts(group, batch, ok) below the first that failed; null if the smallest did."""
    failed = attempts.groupBy(group).agg(F.min(F.when(~F.col("ok"), F.col("batch"))).alias("__f"))
    return attempts.join(failed, group).groupBy(group).agg(F.max(F.when(F.col("ok") & (F.col("__f").isNull() | (F.col("batch") < F.col("__f"))), F.col("batch"))).alias("batch"))


def batch_sizes(batched: DataFrame, group: str) -> DataFrame:
    return batched.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("n"), F.max("char_len").alias("longest"))


def natural_breaks(values: np.ndarray, k: int) -> list[float]:
    """The first values of the classes 2 .. k that minimise the sum of squares within classes of sorted values. Each class boundary is found by a whole row of the dynamic programme at a time."""
    n = len(values)
    if k < 2 or n < k:
        return []
    s, q = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])
    ends = np.arange(1, n + 1)
    cost = q[1:] - s[1:] ** 2 / ends
    cuts = []
    for _ in range(k - 1):
        new, cut = np.full(n, np.inf), np.zeros(n, int)
        for i in range(1, n):
            first = np.arange(1, i + 1)
            within = q[i + 1] - q[first] - (s[i + 1] - s[first]) ** 2 / (i + 1 - first)
            both = within + cost[first - 1]
            j = i - int(both[::-1].argmin())  # the last of equals
            new[i], cut[i] = both[j - 1], j
        cost = new
        cuts.append(cut)
    out, end = [], n - 1
    for cut in cuts[::-1]:
        start = int(cut[end])
        out.append(float(values[start]))
        end = start - 1
        if end < 0:
            break
    return out[::-1]


def variance_fit(values: np.ndarray, breaks: list[float]) -> float:
    """1 less the share of squares within classes; 1 for equal values."""
    total = ((values - values.mean()) ** 2).sum() if len(values) else 0
    if not total:
        return 1.0
    at = np.concatenate([[0], np.searchsorted(values, np.array(breaks)), [len(values)]])
    return 1.0 - sum(((p - p.mean()) ** 2).sum() for a, b in zip(at, at[1:]) if len(p := values[a:b])) / total


def automatic_edges(values: np.ndarray, most: int = MAX_CLASSES, fit: float = GVF) -> list[int]:
    """Breaks of the fewest classes (2 to most) that fit well enough, from a sample of SAMPLE evenly spaced values and judged on all; none for equal values."""
    if len(values) < 2 or values[0] == values[-1]:
        return []
    sample = values if len(values) <= SAMPLE else values[np.linspace(0, len(values) - 1, SAMPLE).astype(int)]
    breaks: list[float] = []
    for k in range(2, min(most, len(sample)) + 1):
        breaks = natural_breaks(sample, k) or breaks
        if variance_fit(values, breaks) >= fit:
            break
    return sorted({int(b) for b in breaks if b > 0})


def bands(rows: DataFrame, group: str) -> DataFrame:
    """(group, edges, fit) of the natural breaks of each group's char_len. Lengths are first counted, so a group comes as its few distinct lengths."""
    counts = rows.groupBy(group, "char_len").agg(F.count(F.lit(1)).alias("n"))
    kind = rows.schema[group].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("char_len")
        values = np.repeat(part["char_len"].to_numpy(float), part["n"].to_numpy())
        edges = automatic_edges(values)
        return pd.DataFrame({group: [part[group].iloc[0]], "edges": [edges], "fit": [variance_fit(values, edges)]})

    return counts.groupBy(group).applyInPandas(run, f"{group} {kind}, edges array<int>, fit double")


def fit_of_bands(rows: DataFrame, group: str, band: str) -> DataFrame:
    """(group, fit) of bands given: 1 less the squares within bands over all squares."""
    per = rows.groupBy(group, band).agg(F.count("char_len").alias("n"), F.sum("char_len").cast("double").alias("s"), F.sum(F.col("char_len").cast("double") ** 2).alias("q"))
    found = per.groupBy(group).agg((F.sum("q") - F.sum(F.col("s") ** 2 / F.col("n"))).alias("within"), (F.sum("q") - F.sum("s") ** 2 / F.sum("n")).alias("total"))
    return found.select(group, F.when(F.col("total") <= 0, 1.0).otherwise(1 - F.col("within") / F.col("total")).alias("fit"))


def sampled_positions(rows: DataFrame, group: str, order: list[str], m: int) -> DataFrame:
    """The rows at places floor(c n / m), c < m, of each group in order; all if there are no more than m."""
    w = Window.partitionBy(group).orderBy(*order)
    placed = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    # pos is floor(c n / m) for some c exactly if c = ceil(pos m / n) gives it
    c = F.ceil(F.col("pos") * m / F.col("n"))
    return placed.where((F.col("n") <= m) | ((c < m) & (F.floor(c * F.col("n") / m) == F.col("pos"))))
