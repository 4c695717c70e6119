"""Codes of position lists: differences, and bytes with seven bits each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType


def delta_encoded(values: Column) -> Column:
    """The first value, then each less the one before. values: a column of a table; another expression would be found anew for each value."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(values, F.greatest(i, F.lit(1)))))


@F.arrow_udf(ArrayType(IntegerType()))
def delta_decoded(deltas: pa.Array) -> pa.Array:
    """Running sums of each list, over all lists of a batch at once."""
    flat, at = _flat(deltas)
    total = np.concatenate([[0], np.cumsum(flat)])
    return _lists(total[1:] - np.repeat(total[at[:-1]], np.diff(at)), at, deltas, pa.int32())


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and the bounds of each list; a null list is empty."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), at


def _lists(flat: np.ndarray, at: np.ndarray, like: pa.Array, kind: pa.DataType) -> pa.Array:
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, kind), mask=mask)


def varint_size(value: Column) -> Column:
    """Bytes of a number's code."""
    out = F.lit(9)
    for k in range(8, 0, -1):
        out = F.when(value < F.lit(1 << (7 * k)), k).otherwise(out)
    return out


def encode_varint(n: int) -> bytes:
    if n < 0:
        raise ValueError("negative numbers have no code")
    out = bytearray()
    while True:
        low, n = n & 127, n >> 7
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number that starts at a place, and the place behind it."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise EOFError("the code ends within a number")
        if shift > 63:
            raise ValueError("the number is too long")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def encode_block(values: list[int]) -> bytes:
    """The count, then the values."""
    return encode_varint(len(values)) + b"".join(map(encode_varint, values))


def decode_block(data: bytes, at: int = 0) -> tuple[list[int], int]:
    n, at = decode_varint(data, at)
    out = []
    for _ in range(n):
        v, at = decode_varint(data, at)
        out.append(v)
    return out, at


#: Fixed value: the first bytes of a file of named blocks.
MAGIC = b"VBP\x01"


def encode_named_blocks(blocks: dict[str, list[int]]) -> bytes:
    out = [MAGIC, encode_varint(len(blocks))]
    for name, values in blocks.items():
        raw = name.encode()
        out += [encode_varint(len(raw)), raw, encode_block(values)]
    return b"".join(out)


def decode_named_blocks(data: bytes) -> dict[str, list[int]]:
    if data[:4] != MAGIC:
        raise ValueError("not a file of named blocks")
    n, at = decode_varint(data, 4)
    out = {}
    for _ in range(n):
        size, at = decode_varint(data, at)
        if at + size > len(data):
            raise EOFError("the file ends within a name")
        name, at = data[at : at + size].decode(), at + size
        out[name], at = decode_block(data, at)
    return out


@F.arrow_udf(BinaryType())
def block_encoded(values: pa.Array) -> pa.Array:
    """encode_block of each list, over all lists of a batch at once."""
    flat, at = _flat(values)
    if len(flat) and flat.min() < 0:
        raise ValueError("negative numbers have no code")
    numbers = np.insert(flat, at[:-1], np.diff(at))  # each list's count stands before it
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        size += numbers >> (7 * k) > 0
    stop = np.cumsum(size)
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    for k in range(9):
        own = np.flatnonzero(size > k)
        if not len(own):
            break
        out[(stop - size)[own] + k] = (numbers[own] >> (7 * k) & 127) | np.where(size[own] > k + 1, 128, 0)
    ends = np.concatenate([[0], stop])[at + np.arange(len(at))].astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])
    return pc.if_else(values.is_valid(), found, pa.scalar(None, pa.binary()))


@F.arrow_udf(ArrayType(LongType()))
def block_decoded(data: pa.Array) -> pa.Array:
    """decode_block of each code, over all codes of a batch at once."""
    plain = pc.fill_null(data.cast(pa.large_binary()), b"\0")
    _, ends, raw = plain.buffers()
    ends = np.frombuffer(ends, np.int64, len(plain) + 1, plain.offset * 8)
    code = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    last = np.flatnonzero(code < 128)
    if len(code) and (not len(last) or last[-1] != len(code) - 1):
        raise EOFError("the code ends within a number")
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    if len(last) and (last - first).max() > 8:
        raise ValueError("the number is too long")
    shift = 7 * (np.arange(len(code)) - np.repeat(first, last - first + 1))
    numbers = np.add.reduceat((code & 127).astype(np.int64) << shift, first) if len(first) else np.zeros(0, np.int64)
    head = np.searchsorted(first, ends[:-1] - ends[0])  # each code's count
    at = np.concatenate([[0], np.cumsum(numbers[head])])
    if not np.array_equal(np.diff(np.append(head, len(numbers))) - 1, np.diff(at)):
        raise EOFError("a code has other than its count of numbers")
    return _lists(np.delete(numbers, head), at, data, pa.int64())
