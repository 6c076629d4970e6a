"""What the operators share: the shared folder, materialised tables, sizes, and tokenising whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.storage import drop_table, materialise, settings, shared_dir, stored  # noqa: F401, for the operators

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: Inverse of BASE modulo 2**64.
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
#: Text bytes that are handled at once; a longer document is handled alone.
SUB_BATCH_BYTES = 1 << 19
#: For actions that the operators run themselves: Arrow batches of ten thousand texts on either side of the pipe cost executors hundreds of MB.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is not changed."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i, or its inverse, for i < n."""
    key = "inverse" if inverse else "power"
    if key not in _powers or len(_powers[key]) < n:
        x = np.full(max(n, SUB_BATCH_BYTES), BASE_INV if inverse else BASE, dtype=U64)
        x[0] = 1
        _powers[key] = np.multiply.accumulate(x)
    return _powers[key][:n]


#: Classes of bytes: 0 white space, 1 letters, digits and all bytes beyond ASCII, 2 anything else.
CLASS = np.full(256, 2, dtype=np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 95]] = 1
#: The same with 2 as 1: words are what white space separates.
SPACED = np.minimum(CLASS, 1)
#: The same with 2 as 0: only letters, digits and what lies beyond ASCII make words.
WORDS = np.where(CLASS == 2, 0, CLASS).astype(np.uint8)
#: ASCII capitals as small letters.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def sub_batches(offsets: np.ndarray, limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes of text each, at least one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def token_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACED, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens (longest runs of one class of bytes, class 0 left out) of documents that lie one after another; with fold, ASCII capitals count as small.

    Returns the hashes and, for each document, the range of its own: n + 1 offsets.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi - lo <= 2 * SUB_BATCH_BYTES:
        return _hashes(data[lo:hi], offsets - lo, classes, fold)
    # a long text piece by piece, each ending where its class of bytes changes: a token's hash depends on its bytes only
    hashes, counts = [np.zeros(0, U64)], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = 0
        while a < b:
            end = min(b, a + SUB_BATCH_BYTES)
            while end < b:
                kinds = classes[data[end - 1 : min(b, end + SUB_BATCH_BYTES)]]
                change = np.flatnonzero(kinds[1:] != kinds[:-1])
                if len(change):
                    end += int(change[0])
                    break
                end = min(b, end + SUB_BATCH_BYTES)
            hashes.append(_hashes(data[a:end], np.array([0, end - a]), classes, fold)[0])
            n += len(hashes[-1])
            a = end
        counts.append(n)
    return np.concatenate(hashes), np.cumsum(counts)


def _hashes(text: np.ndarray, at: np.ndarray, classes: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    if not len(text):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    kind = classes[text]
    change = np.empty(len(text) + 1, dtype=bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[at] = True
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    total = np.zeros(len(text) + 1, dtype=U64)
    if fold:
        text = SMALL[text]
    np.cumsum((text.astype(U64) + U64(1)) * powers(len(text)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(len(text), True)[starts])
    return hashes, np.searchsorted(starts, at)


def documents_of(offsets: np.ndarray) -> np.ndarray:
    """The index of the document of each token."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def set_aside(docs: DataFrame, own: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns that clash with own, or start with two underscores, in one struct; and what takes them out of it again."""
    odd = [c for c in docs.columns if c.startswith("__") or c.lower() in own]
    if not odd:
        return docs, lambda df: df
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in odd]
    return docs.select(*rest, F.struct(*[F.col(f"`{c}`") for c in odd]).alias("__aside")), lambda df: df.select(*[F.col(f"`{c}`") for c in df.columns if c != "__aside"], "__aside.*")


def text_key() -> F.Column:
    """With doc_id it tells rows apart: rows equal in both are the same document."""
    return F.xxhash64(F.col("text"))
