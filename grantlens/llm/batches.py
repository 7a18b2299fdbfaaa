"""Arrow batches cut by bytes, and word hashing over whole columns with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Text bytes worked on at a time in a Python worker. Bounds the numpy scratch arrays.
SLICE_BYTES = 2_000_000

# Arrow batches are sent by rows; a slice of a batch is what bounds memory.
Slices = Callable[[pa.RecordBatch], pa.RecordBatch]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``SLICE_BYTES`` of ``column``; one long row stays whole."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    offsets = _offsets(sizes)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def _offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of a large_binary array without nulls, n + 1 of them."""
    whole = np.frombuffer(array.buffers()[1], dtype=np.int64)
    return whole[array.offset : array.offset + len(array) + 1]


def map_slices(df: DataFrame, function: Slices, schema: str | StructType, column: str = "text") -> DataFrame:
    """``mapInArrow`` with batches cut by bytes. ``function`` gets and returns one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield function(part)

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators read, whatever else the table carries; no text is empty text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def one_text_per_id(rows: DataFrame, *others: str) -> DataFrame:
    """One row per doc_id: of several texts the one with the lowest MD5. ``others`` are equal within an id."""
    least = F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("md5"), "text")).alias("least")
    return rows.groupBy("doc_id", *others).agg(least).select("doc_id", "least.text", *others)


# --- words -----------------------------------------------------------------------

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 3  # 3 mod 8: its powers differ in low bits
_INVERSE = pow(_BASE, -1, 2**64)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, name: str, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n, kept per worker up to a few slices' length."""
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(n, 2 * SLICE_BYTES)
        table = np.empty(size, dtype=np.uint64)
        table[0] = 1
        table[1:] = np.uint64(base)
        np.multiply.accumulate(table, out=table)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and the row boundaries (n + 1) in them.

    Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased first.
    """
    array = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = _offsets(array)
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if len(data) == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    word = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)  # a row begins here
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    begin = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power_table(_BASE, "up", len(data))[: len(data)], out=total[1:])
    hashes = (total[end] - total[begin]) * _power_table(_INVERSE, "down", len(data))[begin]
    hashes = mix(hashes + (end - begin).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return hashes, np.searchsorted(begin, offsets)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles, and the row boundaries.

    A text with fewer words has its whole sequence as the one shingle; without words, none.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    n_rows = len(counts)
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    row = np.repeat(np.arange(n_rows), per_row)
    if len(row) == 0:
        return np.empty(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + bounds[:-1][row]
    size = np.minimum(counts[row], width)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    value = size.astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47)
    for k in range(width):
        inside = np.where(k < size, padded[at + k], np.uint64(0))
        value = mix(value * np.uint64(0x100000001B3) + inside)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(n_rows + 1))
