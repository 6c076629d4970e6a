"""Substring dedup: compressed FM-indexes per shard, matching statistics by backward search over wavelet trees.

A window of MIN_WORDS words is repeated if it occurs at two places of the corpus or more; reported are the longest
intervals of words that repeated windows cover.

Routing. Every window has an anchor: the k-gram of GRAM words with the least hash, the leftmost of equals, so equal
windows have equal anchors wherever they lie. Neighbouring windows of one anchor form a block. An anchor that occurs
once can't belong to a repeated window; blocks of equal content are repeated without further search, and are indexed
once. What is left, blocks that share an anchor but differ, goes to the shard of its anchor. There the distinct blocks
are sorted by suffix and kept as a Burrows-Wheeler transform in a wavelet matrix of packed bits; every block that occurs
once is streamed against it from right to left. A backward search that fails at word p for the end e rules out all
windows around [p, e), so the next one starts at min(e - 1, p + MIN_WORDS): the intervals found are the longest ones
whose matching statistic, own place aside, is MIN_WORDS or more. Shards grow in number with the data. An anchor with
more than HOT different blocks (a short passage that a great many documents share) would not fit one shard: its windows
are counted by 128-bit hash instead, which is exact too.

Words are what ASCII white space separates, compared by 64-bit hash. Defined results: a null text counts as empty;
texts below MIN_WORDS words have no window. Rows equal in doc_id and text are two places (so a repeated row is repeated
throughout) but are reported once. Repeats within one document count. Null doc_ids are reported as null. Texts of any
length are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.llm.common import SMALL_BATCHES, U64, documents_of, drop_table, materialise, mix, powers, settings, stored, string_buffers, sub_batches, text_key, token_hashes

MIN_WORDS, GRAM = 50, 8
SHARD_BLOCKS, HOT = 4000, 4000
#: Places of grams that are compared at once; longer documents are gone through in overlapping parts.
PLACE_BITS = 22
PLACES = 1 << PLACE_BITS


class RankBits:
    """A packed bit vector with the ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))


class FMIndex:
    """Over blocks of symbols 1 .. sigma - 1; 0 stands between blocks and is never searched for."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, sigma: int):
        """symbols: all blocks, each with one 0 behind it, at ends."""
        n = len(symbols)
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # each end differs, so no comparison runs over it
        step = 1
        _, rank = np.unique(rank, return_inverse=True)
        while True:
            second = np.zeros(n, dtype=np.int64)
            second[:-step] = rank[step:] + 1 if step < n else 0
            key = rank.astype(np.int64) * (n + 1) + second
            order = np.argsort(key, kind="stable")
            k = key[order]
            new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 or step >= n:
                break
        bwt = symbols[order - 1]
        self.n, self.levels, self.zeros = n, [], []
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])[:-1]
        self.depth = max(1, int(sigma - 1).bit_length())
        x = bwt
        for level in range(self.depth - 1, -1, -1):
            bit = (x >> level) & 1
            self.levels.append(RankBits(bit.astype(np.uint8)))
            self.zeros.append(int((bit == 0).sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        all_symbols = np.arange(sigma)
        self.base = self._descend(all_symbols, np.zeros(sigma, dtype=np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where((c >> (self.depth - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes after putting c before the pattern of each interval [lo, hi)."""
        both = self._descend(np.concatenate([c, c]), np.concatenate([lo, hi])) - np.tile(self.base[c], 2) + np.tile(self.first[c], 2)
        return both[: len(c)], both[len(c) :]


def repeated_intervals(contents: list[np.ndarray], stream: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block i of stream the longest intervals [a, b) of min_words or more that occur twice among contents: (i, a, b)."""
    lengths = np.array([len(c) for c in contents])
    words, ids = np.unique(np.concatenate(contents), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    symbols = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    symbols[np.arange(len(ids)) + np.repeat(np.arange(len(contents)), lengths)] = ids + 1
    index = FMIndex(symbols, starts + lengths, len(words) + 1)
    who = stream.copy()
    e = lengths[who]
    pos, lo, hi = e - 1, np.zeros(len(who), np.int64), np.full(len(who), index.n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        lo, hi = index.extend(symbols[starts[who] + pos], lo, hi)
        ok = hi - lo >= 2
        pos = pos - ok
        stop = ~ok | (pos < 0)
        if stop.any():
            a = pos[stop] + 1
            long = e[stop] - a >= min_words
            if long.any():
                found.append((who[stop][long], a[long], e[stop][long]))
            new = np.minimum(e[stop] - 1, pos[stop] + min_words)
            new[pos[stop] < 0] = 0
            e[stop], pos[stop], lo[stop], hi[stop] = new, new - 1, 0, index.n
            going = e >= min_words
            if not going.all():
                who, e, pos, lo, hi = who[going], e[going], pos[going], lo[going], hi[going]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each width neighbours in g (all but the low PLACE_BITS bits are compared), the leftmost of equals. g has PLACES at most."""
    place = U64(PLACES - 1)
    least = (g & ~place) | np.arange(len(g), dtype=U64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    return (least & place).astype(np.int64)


def blocks(h: np.ndarray, at: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor, content) of the blocks of documents that lie one after another, as words h with offsets at."""
    n, grams = len(h), min_words - gram + 1
    empty = np.zeros(0, np.int64)
    if n < min_words:
        return empty, empty, empty, empty.view(U64), empty.view(U64)
    doc = documents_of(at)
    g = np.zeros(n - gram + 1, dtype=U64)
    for i in range(gram):
        g = g * U64(0x9E3779B97F4A7C15) + h[i : n - gram + 1 + i]
    g = mix(g)
    anchor = np.concatenate([s + leftmost_least(g[s : s + PLACES], grams) for s in range(0, n - min_words + 1, PLACES - grams + 1)])  # of each window
    real = doc[: len(anchor)] == doc[min_words - 1 :]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~real[:-1]
    starts = np.flatnonzero(new & real)
    if not len(starts):
        return empty, empty, empty, empty.view(U64), empty.view(U64)
    breaks = np.append(np.flatnonzero(new | ~real), len(anchor))
    ends = breaks[np.searchsorted(breaks, starts, "right")]
    windows = ends - starts
    total = np.concatenate([np.zeros(1, U64), np.cumsum(h * powers(n), dtype=U64)])
    content = mix((total[ends + min_words - 1] - total[starts]) * powers(n, True)[starts]) + windows.astype(U64)
    return doc[starts], starts - at[doc[starts]], windows, g[anchor[starts]], content


PLACE = ["doc_id", "key"]


def block_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(anchor, content, doc_id, key, start, windows) of all blocks."""
    source = docs.select("doc_id", text_key().alias("key"), "text")
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType()), source.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType())])

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            batch = batch.select(PLACE)
            for a, b in sub_batches(offsets):
                doc, start, windows, anchor, content = blocks(*token_hashes(data, offsets[a : b + 1]), min_words)
                part = batch.slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), part.column("doc_id"), part.column("key"), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def with_words(docs: DataFrame, wanted: DataFrame, columns: list[str], min_words: int) -> DataFrame:
    """wanted(doc_id, key, start, windows, ...) with the word hashes of each block, packed; of a document's repeated rows one is read."""
    asked = wanted.groupBy(*PLACE).agg(F.collect_list(F.struct("start", "windows", *columns)).alias("asked")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "asked")
    texts = docs.select("doc_id", text_key().alias("key"), "text")
    joined = texts.join(asked, texts["doc_id"].eqNullSafe(asked["__id"]) & (texts["key"] == asked["__key"])).select("text", "asked")

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            lists = batch.column("asked")
            for a, b in sub_batches(offsets):
                h, at = token_hashes(data, offsets[a : b + 1])
                own = lists.slice(a, b - a)
                rows, counts = own.flatten(), np.diff(own.offsets.to_numpy())
                start = np.repeat(at[:-1], counts) + rows.field("start").to_numpy()
                end = start + rows.field("windows").to_numpy() + min_words - 1
                yield pa.RecordBatch.from_arrays([*[rows.field(c) for c in columns], pa.array([h[s:e].tobytes() for s, e in zip(start, end)], pa.binary())], [*columns, "words"])

    fields = [wanted.schema[c] for c in columns]
    return joined.mapInArrow(run, T.StructType([*fields, T.StructField("words", T.BinaryType())]))


def search_shards(contents: DataFrame, shards: int, min_words: int) -> DataFrame:
    """(anchor, content, a, b): repeated intervals, in words, of the blocks that occur once."""

    def run(table: pa.Table) -> pa.Table:
        anchor, content, once = (table.column(c).to_numpy() for c in ("anchor", "content", "once"))
        words = [np.frombuffer(w, U64) for w in table.column("words").to_pylist()]
        i, a, b = repeated_intervals(words, np.flatnonzero(once), min_words)
        return pa.table({"anchor": anchor[i], "content": content[i], "a": a.astype(np.int32), "b": b.astype(np.int32)})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    return contents.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "anchor long, content long, a int, b int")


def count_windows(contents: DataFrame, min_words: int) -> DataFrame:
    """The same for hot anchors: each window by its hash."""

    def run(batches):
        for batch in batches:
            anchor, content = (batch.column(c).to_numpy() for c in ("anchor", "content"))
            for first in range(0, batch.num_rows, 1000):
                part = [np.frombuffer(w, U64) for w in batch.column("words").slice(first, 1000).to_pylist()]
                h, counts = np.concatenate(part), np.array([len(w) - min_words + 1 for w in part])
                starts = np.concatenate([[0], np.cumsum(counts + min_words - 1)])[:-1]
                k = np.repeat(np.arange(len(part)), counts)
                a = np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts)
                at, hashes = starts[k] + a, []
                for x in (h, mix(h + U64(1))):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(x * powers(len(x)), dtype=U64)])
                    hashes.append(mix((total[at + min_words] - total[at]) * powers(len(x), True)[at]).view(np.int64))
                k += first
                yield pa.RecordBatch.from_arrays([pa.array(anchor[k]), pa.array(content[k]), pa.array(a.astype(np.int32)), *map(pa.array, hashes)], ["anchor", "content", "a", "one", "two"])

    windows = contents.mapInArrow(run, "anchor long, content long, a int, one long, two long")
    counted = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(counted, ["one", "two"]).select("anchor", "content", "a", (F.col("a") + F.lit(min_words)).alias("b"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, shard_blocks: int = SHARD_BLOCKS, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word) of the passages of min_words words or more that occur at two places or more; start_word from 0, end_word beyond the last."""
    spark = docs.sparkSession
    with settings(spark, SMALL_BATCHES):
        every, path = stored(block_table(docs, min_words), "blocks")
    by_content = every.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"))
    by_anchor = by_content.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("total")).where("total > 1").select("anchor", "contents")
    shared = materialise(every.join(by_content.join(by_anchor, "anchor"), ["anchor", "content"]), "shared")
    drop_table(spark, path)

    differ = shared.where("contents > 1")
    once = differ.where("n = 1").select(*PLACE, "start", "windows", "anchor", "content", "contents", F.lit(True).alias("once"))
    more = differ.where("n > 1").groupBy("anchor", "content").agg(F.min(F.struct(*PLACE, "start", "windows")).alias("p"), F.first("contents").alias("contents")).select("p.*", "anchor", "content", "contents", F.lit(False).alias("once"))
    wanted = once.unionByName(more)
    with settings(spark, SMALL_BATCHES):
        contents = materialise(with_words(docs, wanted, ["anchor", "content", "contents", "once"], min_words), "contents")
    shards = max(1, -(-contents.where(F.col("contents") <= hot).count() // shard_blocks))
    partial = search_shards(contents.where(F.col("contents") <= hot), shards, min_words)
    partial = partial.unionByName(count_windows(contents.where(F.col("contents") > hot), min_words))

    whole = shared.where("n > 1").select(*PLACE, F.col("start").alias("a"), (F.col("start") + F.col("windows") + F.lit(min_words - 1)).alias("b"))
    cut = shared.where("n = 1 and contents > 1").join(partial, ["anchor", "content"]).select(*PLACE, (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    lists = whole.unionByName(cut).groupBy(*PLACE).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return merged(lists)


def merged(lists: DataFrame) -> DataFrame:
    """doc_id and each longest interval that the lists a and b of a document cover; intervals that touch are one."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c) for c in "ab")
            row = np.repeat(np.arange(batch.num_rows), np.diff(a.offsets.to_numpy()))
            a, b = (x.flatten().to_numpy().astype(np.int64) for x in (a, b))
            order = np.lexsort((a, row))
            row, a, b = row[order], a[order], b[order]
            far = 1 << 32  # keeps documents apart in the running maximum
            reach = np.maximum.accumulate(b + row * far)
            new = np.concatenate([[True], (a + row * far)[1:] > reach[:-1]]) if len(a) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            end = reach[np.append(first[1:], len(a)) - 1] - row[first] * far if len(a) else a
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[first])), pa.array(a[first]), pa.array(end)], ["doc_id", "start_word", "end_word"])

    return lists.select("doc_id", "a", "b").mapInArrow(run, T.StructType([lists.schema["doc_id"], T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())]))


SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {MIN_WORDS - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM words)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM repeated
), numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS passage FROM marked
)
SELECT doc_id, min(i) - 1 AS start_word, max(i) + {MIN_WORDS - 1} AS end_word FROM numbered GROUP BY doc_id, passage
"""
