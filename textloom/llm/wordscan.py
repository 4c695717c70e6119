"""Vectorised word finding and hashing over Arrow string columns.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, so the bounds
can be found on UTF-8 bytes. All hashes are 64 bits and depend on content only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def _return_memory() -> None:
    """Arrays of over 1 MB go back to the system when freed, so that idle workers stay small."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD of glibc
    except (OSError, AttributeError):
        pass  # another C library: its own rules hold


_return_memory()
U = np.uint64
_MASK = (1 << 64) - 1
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash values as numbers strictly between 0 and 1."""
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


@lru_cache(8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, U(b), dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(base, size)
    return up[:n], down[:n]


@dataclass
class Words:
    """Words of a run of documents: bytes from start to end, and the document's place."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each document's words; one more than documents

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between places."""
    n = len(data)
    if not len(start):
        return np.zeros(0, U)
    up, down = powers(_BASE | 1, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(_STEP))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and bounds of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = arr.buffers()
    bounds = np.frombuffer(at, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def scan(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    word = np.zeros(n + 2, bool)
    np.logical_not(IS_SPACE[data], out=word[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, start, end, doc, first)


def runs(bounds: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of documents with about so many bytes; a longer document is a run of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def grams(word_hash: np.ndarray, words: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of n words in one document.

    With short, a document of fewer words (one at least) gives its whole sequence.
    """
    count = len(word_hash)
    if not count:
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = powers(_STEP | 1, count + 1)
    total = np.zeros(count + 1, U)
    np.cumsum(word_hash * up[:count], out=total[1:])
    at = np.zeros(0, np.int64)
    if count >= n:
        at = np.flatnonzero(words.doc[: count - n + 1] == words.doc[n - 1 :])
    size = np.full(len(at), n)
    if short:
        few = np.flatnonzero((words.counts > 0) & (words.counts < n))
        at = np.concatenate([at, words.first[few]])
        size = np.concatenate([size, words.counts[few]])
        order = np.argsort(at, kind="stable")
        at, size = at[order], size[order]
    return mix((total[at + size] - total[at]) * down[at] + size.astype(U)), at
