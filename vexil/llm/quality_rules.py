"""Quality rules with adaptive thresholds.

For each text some rates are counted, by one pass over the bytes of whole Arrow batches. Per language and source, a KLL
sketch of each rate is built (partial sketches are made where rows are read and merged after the shuffle, so a hot source
is no burden), and fences are set from its quartiles, in place of fixed cutoffs: REACH times their distance above the
upper and the like below the lower one. Documents are then joined with the fences of their group and stay if every rate
is within.

Sketches hold up to K values exactly; beyond, the rank error is about 1.3 % at K = 200 and falls with K. The fences are
written to the shared folder once, so a task that is run again sees the same ones.

A rate of few signs or lines says little, so every document is granted ALLOWED of what a rate counts, whatever its length:
a telephone number, a title of one short line. Floors are the least spread to reckon with; they are far below the
quartiles' distance where a rate varies at all. Where most texts of a group have none of what is counted (repeated lines),
quartiles are equal and the allowance alone decides.

Defined results: a null text counts as empty; a text without a word is rejected; long texts are counted whole. Null
languages and sources make groups of their own. Repeated rows each count and each get the same decision; ties have none
but equal decisions. Where a group is too small to have spread, the floors keep its fences apart. An empty table gives an
empty one. Other columns pass through; input columns named like the rates are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.llm.common import SMALL_BATCHES, materialise, set_aside, settings, string_buffers, sub_batches, token_hashes

K, REACH = 400, 8.0
GROUP = ["lang", "source"]
#: Rate: (the least spread to reckon with, what is granted to each document, of solid signs or lines, whether it has a lower fence, whether it has an upper fence).
RULES = {
    "word_length": (0.05, 0.0, "n_words", True, True),
    "mark_rate": (0.001, 6.0, "n_solid", False, True),
    "capital_rate": (0.001, 8.0, "n_solid", False, True),
    "digit_rate": (0.001, 30.0, "n_solid", False, True),
    "short_line_rate": (0.02, 1.0, "n_lines", False, True),
    "repeat_line_rate": (0.02, 1.0, "n_lines", False, True),
}
COUNTS = ("n_words", "n_solid", "n_lines")
SHORT_LINE = 20
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Classes of bytes: 0 white space, 1 later bytes of a sign, 2 marks, 3 capitals, 4 digits, 5 other signs.
KIND = np.full(256, 5, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[128:192] = 1
KIND[[ord(c) for c in MARKS]] = 2
KIND[65:91] = 3
KIND[48:58] = 4
#: Every byte but LF belongs to a line.
LINES = np.ones(256, dtype=np.uint8)
LINES[10] = 0


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each range."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the rates are made of, for each document."""
    lo = int(offsets[0])
    text, at = data[lo : int(offsets[-1])], offsets - lo
    kind = KIND[text]
    first = kind > 0  # of a word: no space, behind a space or at the start of a text
    first[1:] &= kind[:-1] == 0
    starts = at[:-1][at[1:] > at[:-1]]
    first[starts] = kind[starts] > 0
    out = {"n_words": _sums(first, at), "n_solid": _sums(kind > 1, at), "marks": _sums(kind == 2, at), "capitals": _sums(kind == 3, at), "digits": _sums(kind == 4, at)}
    h, per = token_hashes(data, offsets, LINES)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(per))
    out["n_lines"] = np.diff(per)
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["repeats"] = np.bincount(doc[order][1:][same], minlength=len(at) - 1)
    ends = np.zeros(len(text) + 1, dtype=bool)
    ends[at] = True
    ends[:-1] |= text == 10
    ends = np.flatnonzero(ends)
    starts = np.concatenate([[0], ends[:-1] + (text[ends[:-1]] == 10 if len(text) else 0)]) if len(ends) else ends
    signs = np.concatenate([[0], np.cumsum(kind != 1, dtype=np.int64)])
    long = signs[ends] - signs[np.minimum(starts, ends)]
    short = (ends > starts) & (long < SHORT_LINE)
    owner = np.searchsorted(at, starts, "right") - 1
    out["short"] = np.bincount(owner[short], minlength=len(at) - 1)[: len(at) - 1]
    return out


def rates_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and rates of each document; not a number where it has no word."""
    c = counts(data, offsets)
    has = c["n_words"] > 0
    share = lambda n, of: np.where(has, n / np.where(has, of, 1), np.nan)
    return {
        "n_words": c["n_words"],
        "n_solid": c["n_solid"],
        "n_lines": c["n_lines"],
        "word_length": share(c["n_solid"], c["n_words"]),
        "mark_rate": share(c["marks"], c["n_solid"]),
        "capital_rate": share(c["capitals"], c["n_solid"]),
        "digit_rate": share(c["digits"], c["n_solid"]),
        "short_line_rate": share(np.maximum(c["short"] - 1, 0), c["n_lines"]),
        "repeat_line_rate": share(c["repeats"], c["n_lines"]),
    }


def measured(docs: DataFrame, text: bool = True) -> DataFrame:
    """docs with the counts and rates, null where a text has no word; without text if so asked."""
    new = [*[T.StructField(n, T.LongType()) for n in COUNTS], *[T.StructField(r, T.DoubleType()) for r in RULES]]
    kept = [f for f in docs.schema.fields if f.name not in (*COUNTS, *RULES) and (text or f.name != "text")]
    names = [f.name for f in [*kept, *new]]

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for a, b in sub_batches(offsets):
                found = rates_of(data, offsets[a : b + 1])
                has = found["n_words"] > 0
                columns = [pa.array(found[f.name], mask=~has) for f in new]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *columns], names)

    return docs.mapInArrow(run, T.StructType([*kept, *new]))


def sketches(rows: DataFrame, k: int = K) -> DataFrame:
    """A sketch of each rate for each language and source. Sketches of other days or shards can be merged with these by kll_merge_agg_double."""
    return rows.groupBy(*GROUP).agg(*[F.kll_sketch_agg_double(F.col(r), F.lit(k)).alias(r) for r in RULES])


def fences(sketched: DataFrame, reach: float = REACH) -> DataFrame:
    """lang, source and <rate>_low, <rate>_high, before the allowance."""
    out = []
    for r, (floor, _, _, low, high) in RULES.items():
        n = F.kll_sketch_get_n_double(r)
        q1, q3 = (F.when(n > 0, F.kll_sketch_get_quantile_double(r, F.lit(q))) for q in (0.25, 0.75))
        spread = reach * F.greatest(q3 - q1, F.lit(floor))
        out += [(q1 - spread if low else F.lit(float("-inf"))).alias(f"{r}_low"), (q3 + spread if high else F.lit(float("inf"))).alias(f"{r}_high")]
    return sketched.select(*GROUP, *out)


def _within(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The joined filter: rows of rates that lie within the fences of their group."""
    columns = rows.columns
    rows, back = set_aside(rows)
    limits = materialise(limits, "fences")
    limits = limits.select(*[F.col(c).alias(f"__{c}") for c in limits.columns])
    same = rows["lang"].eqNullSafe(limits["__lang"]) & rows["source"].eqNullSafe(limits["__source"])
    within = F.col("n_words") > 0
    for r, (_, allowed, of, _, _) in RULES.items():
        grant = F.lit(allowed) / F.col(of)
        within &= F.col(r).between(F.col(f"__{r}_low") - grant, F.col(f"__{r}_high") + grant)
    return back(rows.join(limits, same).where(within).select(rows.columns)).select(columns)


def kept_rates(docs: DataFrame, k: int = K, reach: float = REACH) -> DataFrame:
    """The documents within all fences of their group, with their counts and rates and without their text: each text is read once, its rates are written."""
    with settings(docs.sparkSession, SMALL_BATCHES):
        rows = materialise(measured(docs, text=False), "rates")
    return _within(rows, fences(sketches(rows, k), reach))


def apply_rules(docs: DataFrame, k: int = K, reach: float = REACH) -> DataFrame:
    """The same with all columns of docs: texts are read twice, so that they need not be written."""
    rows = measured(docs)
    return _within(rows, fences(sketches(rows, k), reach))


def _sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    kind = lambda s: f"(length(text) - length(translate(text, '{quoted(s)}', '')))"
    fence, within = [], []
    for r, (floor, allowed, of, low, high) in RULES.items():
        q1, q3 = (f"quantile_disc({r}, {q}) FILTER (WHERE {r} IS NOT NULL)" for q in (0.25, 0.75))
        spread = f"{REACH} * greatest({q3} - {q1}, {floor})"
        if low:
            fence.append(f"{q1} - {spread} AS {r}_low")
            within.append(f"{r} >= {r}_low - {allowed}::DOUBLE / {of}")
        if high:
            fence.append(f"{q3} + {spread} AS {r}_high")
            within.append(f"{r} <= {r}_high + {allowed}::DOUBLE / {of}")
    return f"""
WITH parts AS (
  SELECT doc_id, lang, source, text, len(list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')) AS n,
    length(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', '', 'g')) AS solid, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents
), rows AS (
  SELECT doc_id, lang, source, n::BIGINT AS n_words, solid::BIGINT AS n_solid, len(lines)::BIGINT AS n_lines, solid::DOUBLE / n AS word_length,
    {kind(MARKS)}::DOUBLE / solid AS mark_rate, {kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}::DOUBLE / solid AS capital_rate, {kind("0123456789")}::DOUBLE / solid AS digit_rate,
    greatest(len(list_filter(lines, lambda x: length(x) < {SHORT_LINE})) - 1, 0)::DOUBLE / len(lines) AS short_line_rate,
    (len(lines) - len(list_distinct(lines)))::DOUBLE / len(lines) AS repeat_line_rate FROM parts WHERE n > 0
), fences AS (SELECT lang, source, {", ".join(fence)} FROM rows GROUP BY lang, source)
SELECT r.doc_id, r.lang, r.source, {", ".join([*COUNTS, *RULES])} FROM rows r
JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
WHERE {" AND ".join(within)}
"""


SQL = _sql()
