"""Packing of documents into training sequences along a Hilbert curve.

Each word of a document adds a vector of signs that its hash gives; the sum over the
word count, a random projection of the hashed document vector to DIMENSIONS numbers, is
squashed to a grid cell, whose Hilbert index is the document's key. Documents are
range-sorted by (key, doc_id), in ranges of about as many ids each, and laid end to end; the stream of each range is
cut into sequences of SEQUENCE ids. The rest of a range is cut into powers of two, so no
sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .subwords import byte_level
from .token_files import squeeze, unsqueeze
from .wordscan import U, buffers, mix, runs, scan

SEQUENCE, END_ID, DIMENSIONS, BITS, SCALE = 2048, 1, 3, 12, 8


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of grid cells (rows of coordinates below 2^bits), by undoing Gray code and rotations from the top bit down."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def cells(arr: pa.Array, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Grid cells of whole texts; the middle of the grid for texts without words."""
    data, bounds = buffers(arr)
    out = np.zeros((len(bounds) - 1, dimensions))
    for i, j in runs(bounds):
        w = scan(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower=True)
        h = mix(w.hashes())
        for d in range(dimensions):
            sign = (h >> U(d) & U(1)).astype(np.float64) * 2 - 1
            out[i:j, d] = np.bincount(w.doc, weights=sign, minlength=j - i) / np.maximum(w.counts, 1)
    return np.minimum((1 / (1 + np.exp(-out * SCALE)) * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def keyed(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, Hilbert key, number of ids, and squeezed ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = byte_level(path, True)
        for b in batches:
            key = hilbert_key(cells(b["text"]))
            for i, ids, at in made.batches(b["text"]):
                out = [squeeze(np.append(ids[x:y], np.uint32(end_id))) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, len(out)), pa.array(key[i : i + len(out)]), pa.array(np.diff(at).astype(np.int64) + 1), pa.array(out, pa.binary())], ["doc_id", "key", "weight", "ids"])

    return tables.texts(docs).mapInArrow(run, "doc_id long, key long, weight long, ids binary")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []  # doc_id, start, ids, doc_tokens
        held = 0

        def cut(most: int) -> list[tuple]:
            """The next sequence: rows of so many ids from the front of the pieces."""
            nonlocal number, held
            rows, offset = [], 0
            while offset < most:
                doc, start, ids, total = pieces[0]
                n = min(len(ids), most - offset)
                rows.append((doc, start, n, zlib.crc32(ids[:n].tobytes()), total, number, offset))
                offset += n
                if n < len(ids):
                    pieces[0] = (doc, start + n, ids[n:], total)
                else:
                    pieces.pop(0)
            number += 1
            held -= most
            return rows

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [x.split()[0] for x in PIECE.split(", ")])

        for b in batches:
            rows: list[tuple] = []
            for doc, data in zip(b["doc_id"].to_pylist(), b["ids"], strict=True):
                ids = unsqueeze(data.as_py()).astype("<u4")
                pieces.append((doc, 0, ids, len(ids)))
                held += len(ids)
                while held >= size:
                    rows += cut(size)
            if rows:
                yield batch(rows)
        rows = []
        while held:
            rows += cut(1 << (held.bit_length() - 1))
        if rows:
            yield batch(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, task_bytes: int = tables.TASK_BYTES) -> DataFrame:
    """A row for each piece of a document in a sequence.

    A null text is empty: such a document is its end id alone. Rows that repeat are packed
    each; ties in the key go by doc_id (null first), then by ids. An empty table gives no rows; columns other
    than doc_id and text are ignored. sequence_id: the range's number times 2^40, and a count.
    """
    parts = tables.tasks_for(tables.text_bytes(tables.texts(docs)), task_bytes)
    kept = tables.keep(keyed(docs, tokenizer))
    dealt = tables.by_range(kept.withColumn("tie", F.coalesce("doc_id", F.lit(tables.LOW))), parts, "ids")
    return dealt.select("doc_id", "ids").mapInArrow(_pack(size), PIECE)


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(tables.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
