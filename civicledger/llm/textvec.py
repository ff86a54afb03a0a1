"""Whole texts as numpy byte arrays: what the vectorised operators share inside a task."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return bytes_[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = 1 << 20
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows with about ``limit`` bytes of text, so that memory does not
    depend on the batch size. A longer text is a slice of its own, never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = raw_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first]:at[last]], at[first:last + 1] - at[first]
            first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * U(BASE))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; sizes are rounded up so that few are ever built."""
    size = 1 << max(20, (n - 1).bit_length())
    return (_powers(base, size) if size <= 1 << 22 else _powers.__wrapped__(base, size))[:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: differences of one prefix sum, moved to a common exponent."""
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, max(len(data), 1))[:len(data)], dtype=U, out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(data) + 1)[starts]
    return mixed(h ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of every run, one run after the other."""
    total = int(counts.sum())
    small = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31) else np.int64
    before = np.cumsum(counts) - counts
    out = np.repeat((starts - before).astype(small), counts)
    out += np.arange(total, dtype=small)
    return out


IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of non-blank bytes; no run crosses a row."""
    solid = ~IS_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] |= solid[inner]
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = solid
    stops[1:-1] &= ~solid[1:]
    stops[inner] |= solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(at, starts, "right") - 1
