"""Vectorised word and window hashing over Arrow string columns (numpy, no per-row Python).

All hashes are 64-bit. A word's hash is a polynomial over random byte values, a
window's one over its words' hashes; both end in a full-avalanche mix.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_SECOND_BASE = 0xD1B54A32D192ED03
_BLOCK = 1 << 16

#: Word alphabets, as the bytes that do NOT belong to words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, in place."""
    t = x >> U(33)
    x ^= t
    x *= U(0xFF51AFD7ED558CCD)
    np.right_shift(x, U(33), out=t)
    x ^= t
    x *= U(0xC4CEB9FE1A85EC53)
    np.right_shift(x, U(33), out=t)
    x ^= t
    return x


@lru_cache(maxsize=None)
def _low_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    def up(b: int) -> np.ndarray:
        p = np.full(_BLOCK, b, dtype=U)
        p[0] = 1
        return np.cumprod(p, dtype=U)

    return up(base), up(pow(base, -1, 1 << 64))


def _scale(v: np.ndarray, base: int) -> None:
    """v[i] *= base**i, in place, by blocks so that no table grows with the text."""
    low, _ = _low_powers(base)
    step, high = pow(base, _BLOCK, 1 << 64), 1
    for at in range(0, len(v), _BLOCK):
        part = v[at : at + _BLOCK]
        part *= low[: len(part)]
        if at:
            part *= U(high)
        high = high * step & _MASK


def _unscale(v: np.ndarray, at: np.ndarray, base: int) -> None:
    """v[i] *= base**-at[i], in place; at ascends."""
    _, low = _low_powers(base)
    v *= low[at & (_BLOCK - 1)]
    if len(at) and at[-1] >= _BLOCK:
        inv = pow(pow(base, _BLOCK, 1 << 64), -1, 1 << 64)
        n = int(at[-1] >> 16) + 1
        high = np.full(n, inv, dtype=U)
        high[0] = 1
        v *= np.cumprod(high, dtype=U)[at >> 16]


@lru_cache(maxsize=None)
def _alphabet(breaks: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    is_word = np.ones(256, dtype=bool)
    if lower:
        fold = np.arange(256)
        fold[0x41:0x5B] += 0x20
    else:
        fold = np.arange(256)
    is_word[list(breaks)] = False
    is_word = is_word[fold]
    values = mix(np.arange(1, 257, dtype=U) * U(_BYTE_BASE))[fold]
    values[~is_word] = 0
    return is_word, values


class Words:
    """Words of some documents: starts/ends are byte positions, first[d]..first[d+1] are document d's words."""

    __slots__ = ("data", "starts", "ends", "first", "offsets", "hash")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: bytes, lower: bool):
        is_word, values = _alphabet(breaks, lower)
        w = is_word[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[0], edge[-1] = True, True
        edge[1:-1] = False
        edge[offsets] = True
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = w[:-1]
        before &= ~edge[:-1]
        self.starts = np.flatnonzero(w & ~before)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            after[-1] = False
            after[:-1] = w[1:]
        after &= ~edge[1:]
        self.ends = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.data, self.offsets = data, offsets
        if len(self.starts):
            v = values[data]
            _scale(v, _BYTE_BASE)
            h = np.add.reduceat(v, self.starts)
            _unscale(h, self.starts, _BYTE_BASE)
            self.hash = mix(h)
        else:
            self.hash = np.empty(0, dtype=U)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(word positions, hashes) of all windows of k words that lie in one document; second: by another hash."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
        good = np.ones(n - k + 1, dtype=bool)
        for back in range(1, k):  # a window may not pass a document's first word
            at = self.first[1:-1] - back
            good[at[(at >= 0) & (at < len(good))]] = False
        last = self.first[-1]
        good[max(0, last - k + 1) :] = False
        at = np.flatnonzero(good)
        if k <= 8 and not second:
            h = np.zeros(n - k + 1, dtype=U)
            for j in range(k):
                h *= U(_WORD_BASE)
                h += self.hash[j : n - k + 1 + j]
            h = h[at]
        else:
            base = _SECOND_BASE if second else _WORD_BASE
            v = mix(self.hash ^ U(base)) if second else self.hash.copy()
            _scale(v, base)
            total = np.empty(n + 1, dtype=U)
            total[0] = 0
            np.cumsum(v, out=total[1:])
            h = total[at + k] - total[at]
            _unscale(h, at, base)
        return at, mix(h)

    def whole(self, docs: np.ndarray) -> np.ndarray:
        """Hashes of the whole word sequences of the given documents, which have words."""
        v = self.hash.copy()
        _scale(v, _WORD_BASE)
        total = np.empty(len(v) + 1, dtype=U)
        total[0] = 0
        np.cumsum(v, out=total[1:])
        a, b = self.first[docs], self.first[docs + 1]
        h = total[b] - total[a]
        _unscale(h, a, _WORD_BASE)
        return mix(h ^ mix((b - a).astype(U)))


def views(column: pa.Array) -> list[np.ndarray]:
    """The values of a binary column without nulls, as bytes arrays that share its memory."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def trim() -> None:
    """Give memory that a task no longer needs back to the machine; workers are used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A batch function that trims its worker's memory when it ends."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return held


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """(from, to) document ranges of about `most` bytes, a longer document alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def words_of(column: pa.Array, breaks: bytes, lower: bool, most: int = 1 << 20):
    """Yield (from, to, Words) over document ranges of a column."""
    data, offsets = strings(column)
    for a, b in slices(offsets, most):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], breaks, lower)
