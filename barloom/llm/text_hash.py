"""Vectorised word and shingle hashing over Arrow string columns.

Words are found and hashed with numpy on the column's UTF-8 bytes, a slice of a few MB at a time,
so no Python object is made for a word and memory stays bounded whatever the batch holds.
All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_pows: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pows or len(_pows[0]) <= n:
        size = max(SLICE_BYTES + 1, n + 1)
        _pows[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, p, np.uint64))]) for p in (_P, _INV)]
    return _pows[0], _pows[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows that hold about `limit` bytes;
    a longer text stands alone. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a longest run of bytes other than space, tab to carriage return."""
    inside = ~SPACE[data] if inside is None else inside
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs, A-Z counted as a-z: a polynomial read off prefix sums, then mixed."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _TURN[15])


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in ascending order, one row after another, and offsets.
    A row with fewer words than width has its whole sequence as one shingle; one without words none."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(words)
    full = np.flatnonzero(rows[: n - width + 1] == rows[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    value = np.zeros(len(full), np.uint64)
    for k in range(width):
        value += words[full + k] * _TURN[k]
    short = np.flatnonzero((counts > 0) & (counts < width))
    few = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = counts[short] > k
        few[has] += words[first[short[has]] + k] * _TURN[k]
    few += counts[short].astype(np.uint64) * _TURN[14]
    value, few = mix(value), mix(few)
    size = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(off[-1], np.uint64)
    long_rows = counts >= width
    place = np.repeat(off[:-1][long_rows], size[long_rows]) + (np.arange(len(full)) - np.repeat(np.cumsum(size[long_rows]) - size[long_rows], size[long_rows]))
    out[place] = value
    out[off[short]] = few
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[off[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[off]


def shingle_sets(column: pa.Array, width: int = 5, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes, offsets) for slices of a text column."""
    for i, j, data, offsets in byte_slices(column, limit):
        starts, ends, rows = word_spans(data, offsets)
        yield i, j, *shingles(span_hashes(data, starts, ends), rows, j - i, width)
