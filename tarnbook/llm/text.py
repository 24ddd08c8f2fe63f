"""Bytes, words and hashes of whole Arrow batches of texts, as numpy arrays.

The helpers run inside Spark tasks.  A batch is walked in chunks of about a megabyte (never splitting a text), so
that memory depends on the chunk and the longest text, not on the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Large arrays are mapped, and given back to the system when they are freed: a worker that Spark uses again for other
# tasks should not go on holding the most it ever needed.  (Parameter -3 is the size from which memory is mapped.)
if hasattr(_libc := ctypes.CDLL(None), "mallopt"):
    _libc.mallopt(-3, 1 << 20)

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000
U64 = np.uint64

#: The separators are the space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


@functools.lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03) + U64(seed))


class _Powers:
    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse modulo 2^64."""
    if len(_Powers.up) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            setattr(_Powers, name, np.multiply.accumulate(a))
    return _Powers.up, _Powers.down


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of 64-bit values; :func:`range_hashes` reads the hash of any range from them."""
    up, _ = powers(len(values))
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` values, by its start."""
    n = len(sums) - width
    _, down = powers(len(sums))
    return mix((sums[width:] - sums[:n]) * down[:n])


class Chunk:
    """Some whole texts: their bytes, and where each begins; ``rows`` is their range in the batch."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, rows: tuple[int, int]):
        self.data, self.bounds, self.rows = data, bounds, rows

    def lower(self) -> Chunk:
        return Chunk(LOWER[self.data], self.bounds, self.rows)

    @functools.cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of words before each text (and in all)."""
        inside = ~IS_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.bounds] = True
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        starts, ends, _ = self.words
        sums = prefix_hashes(_byte_values(seed)[self.data])
        return range_hashes(sums, starts, ends)

    def byte_values(self, seed: int = 0) -> np.ndarray:
        return _byte_values(seed)[self.data]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in chunks of about ``most`` bytes, one text at least."""
    data, bounds = texts_of(column)
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, n)
        yield Chunk(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], (at, to))
        at = to


def kept_text(data: bytes, keep: np.ndarray) -> bytes:
    """The bytes where ``keep`` is true."""
    return np.frombuffer(data, dtype=np.uint8)[keep].tobytes()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
