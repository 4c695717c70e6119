"""Sorted 64-bit hashes and small numbers as compact bytes, for what is dealt between tasks."""

from __future__ import annotations

import numpy as np
import zstandard

from .wordscan import U


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte, so that equal high bytes lie together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _whole(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def pack(sorted_hashes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Hashes in ascending order as differences, and further columns of unsigned numbers or doubles beside them (doubles come back as their bits)."""
    n = len(sorted_hashes)
    parts = [_planes(np.diff(sorted_hashes, prepend=U(0)).astype(U))]
    kinds = [8]
    for c in columns:
        if c.dtype == np.float64:
            c = np.ascontiguousarray(c).view(U)
            kind = U
        else:
            kind = np.min_scalar_type(int(c.max())) if n else np.uint8
        parts.append(_planes(c.astype(kind)))
        kinds.append(np.dtype(kind).itemsize)
    head = np.array([n, len(parts), *[y for p, k in zip(parts, kinds, strict=True) for y in (len(p), k)]], "<u4")
    return head.tobytes() + b"".join(parts)


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    n, k = np.frombuffer(data, "<u4", 2)
    sizes = np.frombuffer(data, "<u4", 2 * int(k), 8).reshape(-1, 2).tolist()
    at = 8 + 8 * int(k)
    out = []
    for size, width in sizes:
        out.append(_whole(data[at : at + size], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width], int(n)))
        at += size
    out[0] = np.cumsum(out[0], dtype=U)
    return tuple(out)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Of n buckets, one that does not fall as the hash grows; n is below 2^31."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)
