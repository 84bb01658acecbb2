"""Vectorised word hashing over the bytes of an Arrow string column.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. A word's hash is a polynomial in a
random odd base over 64 bits, mixed; it depends on the bytes alone, so it is the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_VALUE = mix(LOWER.astype(np.uint64) + np.uint64(0x1234567))
_VALUE[WHITE] = 0
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK, 1 << (n - 1).bit_length() if n else 1)
    if size not in _POWERS:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the len + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: White space and ASCII characters that are neither letters nor digits.
STOPS = WHITE.copy()
STOPS[[b for b in range(128) if not chr(b).isalnum()]] = True


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and for each row its first word's number (rows + 1 values).

    offsets are those of the rows within data; a row longer than a block is hashed block by block.
    between: which bytes part words.
    """
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    data, offsets = data[base : base + n], offsets - base
    white = between[data]
    first = ~white
    first[1:] &= white[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] |= ~white[begin]
    starts = np.flatnonzero(first)
    last = ~white
    last[:-1] &= white[1:]
    last[begin[1:] - 1] |= ~white[begin[1:] - 1]
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        at = starts[k]
        m = max(k + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        up, down = _powers(int(ends[m - 1] - at))
        part = data[at : ends[m - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=sums[1:])
        hashes[k:m] = (sums[ends[k:m] - at] - sums[starts[k:m] - at]) * down[starts[k:m] - at]
        k = m
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles of one word sequence; the whole sequence as one if it is shorter; none if empty."""
    m = len(hashes)
    if not m:
        return np.zeros(0, np.uint64)
    take = min(n, m)
    h = np.full(m - take + 1, take * 0x2545F4914F6CDD1D % (1 << 64), np.uint64)
    for j in range(take):
        h += hashes[j : m - take + 1 + j] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ** 3 | 1) % (1 << 64))
    return mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles."""
    for i, j in slices(offsets):
        _, _, hashes, rows = words(data, offsets[i : j + 1])
        every = shingles(hashes, n) if len(hashes) >= n else hashes  # those that begin in one row and end in another are passed over
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            s = np.sort(every[a : b - n + 1]) if b - a >= n else shingles(hashes[a:b], n)
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s if new.all() else s[new]
