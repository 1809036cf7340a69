"""Vectorised work on the UTF-8 bytes of many texts at once.

Arrow hands a column of texts over as one buffer of bytes and the offsets of the rows. The functions here
find words and hash words and byte runs on that buffer, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one step works on; a single longer text is a step of its own.
STEP_BYTES = 1 << 18

#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of the rule ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes of the rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def _powers(base: int):
    known = np.ones(1, dtype=np.uint64)

    def upto(n: int) -> np.ndarray:
        nonlocal known
        if len(known) < n:
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            known = np.cumprod(step, dtype=np.uint64)
        return known[:n]

    return upto


_power, _inverse_power = _powers(_BASE), _powers(_INVERSE)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the offsets of the rows in them; null counts as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = pc.fill_null(column.cast(pa.large_string()), "") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES):
    """Per step of about ``limit`` bytes: the rows as a record batch, their bytes and offsets."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(column))
        low, rows = 0, len(offsets) - 1
        while low < rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of every row (one more entry than rows)."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word_bytes[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`range_hashes` gets the hash of any range of bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _power(len(data)), dtype=np.uint64, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of bytes[start:end], the same wherever the bytes stand."""
    inverse = _inverse_power(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive 64-bit values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total = total * _U(_BASE) + values[i : i + n]
    return mix(total + _U(k))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    reach, least = 1, values
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return least[:n] if reach == width else np.minimum(least[:n], least[width - reach : width - reach + n])


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, a space after each: the bytes, and start and end of each word in them."""
    lengths = ends - starts
    new_starts = np.cumsum(lengths + 1) - lengths - 1
    total = int((lengths + 1).sum())
    out = data[np.minimum(np.arange(total) + np.repeat(starts - new_starts, lengths + 1), max(len(data) - 1, 0))] if total else data[:0]
    new_ends = new_starts + lengths
    out[new_ends] = 0x20
    return out, new_starts, new_ends
