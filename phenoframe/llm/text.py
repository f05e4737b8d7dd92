"""Arrow text columns as flat byte arrays, and vectorised words over them."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20  # text worked on at once; a longer document is a slice of its own
BATCH_ROWS = 1000  # texts sent to Python at once
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_text(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` for rows with whole texts.

    Texts are large rows, so the session's batches are cut to ``BATCH_ROWS`` rows if they are
    larger. Workers outlive their tasks; at a task's end, free memory goes back to the system.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
            library.malloc_trim(0)

    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(task, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row starts; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    starts = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    starts = starts.astype(np.int64)
    if data is None or starts[-1] == starts[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]
    return flat, starts - starts[0]


def slices(starts: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is alone in its range."""
    low, rows = 0, len(starts) - 1
    while low < rows:
        high = int(np.searchsorted(starts, starts[low] + limit, side="right")) - 1
        high = min(rows, max(high, low + 1))
        yield low, high
        low = high


def lookup(members: bytes) -> np.ndarray:
    """A table of 256 flags for a set of bytes."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
BYTE_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
POWERS_BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20  # bytes hashed at once


def word_spans(flat: np.ndarray, starts: np.ndarray, inside: np.ndarray):
    """Begin and end of every maximal run of ``inside`` bytes that stays in its row.

    Returns (begins, ends, rows' first word): words of row i are ``first[i]:first[i + 1]``.
    """
    size = len(flat)
    if not size:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(starts), np.int64)
    mask = inside[flat]
    edge = np.zeros(size + 1, bool)
    edge[starts] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:size]
    finish = mask.copy()
    finish[:-1] &= ~mask[1:] | edge[1:size]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return begins, ends, np.searchsorted(begins, starts)


def word_hashes(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, computed a piece of the text at a time."""
    out = np.empty(len(begins), np.uint64)
    low = 0
    while low < len(begins):
        high = max(low + 1, int(np.searchsorted(ends, begins[low] + PIECE, side="right")))
        first, last = int(begins[low]), int(ends[high - 1])
        longest = int((ends[low:high] - begins[low:high]).max())
        powers = np.cumprod(np.full(longest, POWERS_BASE, np.uint64))
        at = begins[low:high] - first
        width = ends[low:high] - begins[low:high]
        where = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        values = BYTE_CODES[flat[first:last][np.repeat(at, width) + where]]
        values *= powers[where]
        out[low:high] = np.add.reduceat(values, np.cumsum(width) - width)
        low = high
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated integer ranges ``low:low + size``."""
    total = int(sizes.sum())
    shift = np.repeat(lows - (np.cumsum(sizes) - sizes), sizes)
    return np.arange(total) + shift
