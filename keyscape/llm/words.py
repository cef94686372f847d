"""Vectorised words and hashes over Arrow string columns.

All functions run inside tasks on one Arrow batch. They walk the flat UTF-8
buffer in pieces of a few MB, so memory does not depend on how long one text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 1 << 20
_M64 = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, _M64, 256, dtype=np.uint64, endpoint=True)
_BASE = int(_rng.integers(1, _M64, dtype=np.uint64)) | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, size)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _is_space(data: np.ndarray, i: int, j: int) -> np.ndarray:
    return SPACE[data[i:j]]


def pieces(
    data: np.ndarray,
    off: np.ndarray,
    may_cut: Callable[[np.ndarray, int, int], np.ndarray] = _is_space,
    step: int = STEP,
) -> Iterator[tuple[int, int]]:
    """Consecutive byte ranges, cut at a row's start or where ``may_cut`` holds."""
    start, total = 0, len(data)
    while start < total:
        end = start + step
        if end >= total:
            yield start, total
            return
        row = int(off[np.searchsorted(off, end)])
        at = end
        while at < row:
            found = np.flatnonzero(may_cut(data, at, min(at + 65536, row)))
            if len(found):
                row = at + int(found[0])
                break
            at += 65536
        yield start, row
        start = row


def word_spans(
    data: np.ndarray, off: np.ndarray, s: int, e: int
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, from ``s``, of the words of ``data[s:e]``."""
    inside = ~SPACE[data[s:e]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = np.unique(off[np.searchsorted(off, s, "right") : np.searchsorted(off, e)]) - s
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(
    piece: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER
) -> np.ndarray:
    """64-bit hash of every span of ``piece``, after the byte mapping ``fold``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(piece) + 1)
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_TABLE[fold[piece]] * up[: len(piece)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(column: pa.Array, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, and the row offsets into them."""
    data, off = flat(column)
    hashes, starts = [], []
    for s, e in pieces(data, off):
        st, en = word_spans(data, off, s, e)
        hashes.append(hash_spans(data[s:e], st, en, fold))
        starts.append(st + s)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


_ROUNDS = [np.uint64(int(x) | 1) for x in _rng.integers(1, _M64, 16, dtype=np.uint64)]


def shingle_sets(
    column: pa.Array, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, concatenated, and row offsets.

    A row of fewer words than ``size``, but not none, has its whole word sequence
    as the only shingle.
    """
    words, off = word_hashes(column)
    n = len(words)
    sums = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        sums += words[k : k + len(sums)] * _ROUNDS[k]
    sums = mix(sums)
    sets = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(sums[a : b - size + 1]))
        elif b > a:
            h = (words[a:b] * np.array(_ROUNDS[: b - a])).sum(dtype=np.uint64, keepdims=True)
            sets.append(mix(h + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    counts = np.array([len(x) for x in sets], np.int64)
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return joined, np.concatenate(([0], np.cumsum(counts)))


def row_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most ``limit`` bytes of text, or of one longer row."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        upto = limit + (int(ends[start - 1]) if start else 0)
        end = max(start + 1, int(np.searchsorted(ends, upto, "right")))
        yield start, end
        start = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
