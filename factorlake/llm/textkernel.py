"""Vectorised text kernels shared by the Arrow operators.

A block of documents is a pair ``(data, offsets)``: all UTF-8 bytes one after the other and, for each document, where
its bytes begin (one more entry for the end). Everything here works on whole blocks with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that the kernels take at a time. A longer single document makes a block of its own.
BLOCK_BYTES = 1 << 19

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: ASCII white space, and all of ASCII but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:0x80] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    PUNCTUATION[_c] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Each byte stands for a 64-bit number, so that short words don't meet.
SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse below n, at least."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 4096)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, to use with span_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), equal for equal contents wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) for runs of rows of at most ``limit`` bytes, or of one row."""
    data, offsets = column_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + (limit or BLOCK_BYTES), "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes that aren't separators) and the row of each."""
    solid = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (first | ~before))
    after = np.zeros_like(solid)
    after[:-1] = solid[1:] & ~first[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() and the 64-bit hash of each, with A-Z as a-z."""
    starts, ends, row = words(data, offsets, separators)
    return starts, ends, row, span_hash(prefix_hash(SPREAD[LOWER[data]]), starts, ends)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive entries; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = mix(out + h[i : i + n]) * np.uint64(_BASE)
    return mix(out)


def to_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
