"""Texts of Arrow batches as flat numpy arrays, cut into slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 250_000  # working arrays hold this much text, or one longer text

_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _series(base: int, length: int) -> np.ndarray:
    out = np.full(length, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < length:
        size = max(length, SLICE_BYTES + 1024)
        _powers, _inverses = _series(_BASE, size), _series(_INVERSE, size)
    return _powers[:length], _inverses[:length]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans have equal hashes."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins and ends; null: empty."""
    return bytes_of(pc.fill_null(column.cast(pa.large_string()), ""))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of large strings or binaries without nulls, and where each row's begin and end."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def hand_back() -> None:
    """Give freed memory back to the system: the process lives on, idle or for tasks that need other memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # numpy's memory; only some C libraries keep and trim it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most `limit` bytes of text, one row at least."""
    batch = None
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        begin = 0
        while begin < len(ends):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    del batch
    hand_back()


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each position of the flat array belongs to."""
    return np.searchsorted(offsets, starts, side="right") - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its length says, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - begins, lengths)


_WORD_BREAK = np.zeros(256, bool)
_WORD_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of bytes other than the six ASCII blanks."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    blank = np.empty(len(data) + 1, bool)
    np.take(_WORD_BREAK, data, out=blank[:-1])
    blank[-1] = True
    begins = ~blank[:-1]
    begins[1:] &= blank[:-2]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]  # words never cross into the next text
    begins[firsts] = ~blank[firsts]
    ends = ~blank[:-1]
    ends[:-1] &= blank[1:-1]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = ~blank[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, rows_of(starts, offsets)
