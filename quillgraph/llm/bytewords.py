"""Words of many texts at once: whole Arrow string batches are hashed in NumPy without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 1 << 19  # bytes of text handled at once; a longer text is handled alone
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U = np.uint64

_table = np.arange(256, dtype=np.uint8)
LOWER = np.where((_table >= 65) & (_table <= 90), _table + 32, _table).astype(np.uint8)
#: Bytes of words: ASCII letters and digits and all bytes of other characters.
WORD = ((_table >= 48) & (_table <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_table >= 128)
#: Bytes that are not white space.
SOLID = ~np.isin(_table, [32, 9, 10, 11, 12, 13])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, _STEP)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.r_[_U(1), np.full(m - 1, b)], dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, from one prefix sum."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += _U(1)
    terms *= power[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def spans(flags: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags, also cut at these places."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    first = flags.copy()
    first[1:] &= ~flags[:-1] | edge[1:n]
    last = flags.copy()
    last[:-1] &= ~flags[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of bounded size; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _STEP, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of these texts, and at which word each text begins (with a last entry for the end)."""
    start, end = spans(kind[data], offsets[offsets < len(data)])
    return start, end, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words within each text (of all its words where it has fewer), and where each text's begin."""
    counts = np.diff(begins)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    power, inverse = _power(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    start = np.repeat(begins[:-1] - at[:-1], made) + np.arange(at[-1])
    end = start + np.repeat(np.minimum(counts, size), made)
    return mix((sums[end] - sums[start]) * inverse[start] + _U(1)), at
