"""Vectorised word, line and n-gram kernels over Arrow string columns.

Texts are handled as one byte buffer with document offsets. Hashes are polynomial over bytes, taken as
differences of one prefix sum, so their cost does not depend on how many words a buffer holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the byte polynomial; its inverse modulo 2^64 exists because it is odd.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that a kernel takes at a time; a longer document is taken alone.
CHUNK_BYTES = 1 << 20
#: The same for kernels that hold many numbers a byte.
PIECE_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = PIECE_BYTES + 1 if n <= PIECE_BYTES + 1 else max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            row = np.full(size, base, U64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of the buffer at a time, of at most `limit` bytes or a single row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each row's positions are set."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Spans:
    """Maximal runs of non-separator bytes within rows: starts, ends and the first span of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        inside = ~separator[data]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        finishes[edges - 1] = inside[edges - 1]
        self.inside = inside
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.rows = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_ids(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Sorting beats the library's hashing of wide numbers by far."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, at the first one's place; rows' borders are the caller's."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += words[j : j + n] * U64(pow(BASE, 2 * j + 1, 1 << 64))
    return mix(out)


def within_row(rows: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n window places hold k words of one row; rows: first word of each row, and the end."""
    place = np.arange(n)
    row_end = np.repeat(rows[1:], np.diff(rows))[:n]
    return place + k <= row_end


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it stands more than once, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later
