"""Token ids in files of a byte-aligned code with separate control bytes.

Ids become ranks by falling corpus frequency, so most fit one byte. Four ranks share a
control byte (two bits each: bytes less one); their low bytes follow in a separate
stream, in little-endian order. Files hold blocks of whole documents, as rows of
Parquet, so that any store Spark reaches can hold them: part and block number, ids
before the block in its part, document ids, lengths, control bytes and data bytes.
The decoder looks the four lengths of each control byte up in a table and gathers the
bytes with numpy. The id of each rank stands beside the blocks with the format's version,
so a folder can be read without anything from the session that wrote it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import shared

from . import tables
from .subwords import byte_level

#: Ids of a block, reached or passed with a whole document; the vocabulary is below 2^16 + 2^16.
BLOCK_IDS, END_ID = 1 << 16, 2
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    return (raw[at] | raw[at + 1] << np.uint32(8) | raw[at + 2] << np.uint32(16) | raw[at + 3] << np.uint32(24)) & _MASK[size]


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(ids: np.ndarray) -> bytes:
    wide = len(ids) and ids.max() > 0xFFFF
    return _zstd()[0].compress(ids.astype("<u4" if wide else "<u2").tobytes()) + (b"4" if wide else b"2")


def unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(data[:-1]), "<u4" if data[-1:] == b"4" else "<u2").astype(np.uint32)


def tokenised(docs: DataFrame, path: str, spaced: bool, end_id: int) -> DataFrame:
    """doc_id, n, ids (squeezed, the end id last) and tie (a hash of them) of each document; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = byte_level(path, spaced)
        for b in batches:
            for i, ids, at in made.batches(b["text"]):
                out = [np.append(ids[x:y], np.uint32(end_id)) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, len(out)), pa.array([len(x) for x in out], pa.int64()), pa.array(list(map(squeeze, out)), pa.binary())], ["doc_id", "n", "ids"])

    return tables.texts(docs).mapInArrow(run, "doc_id long, n long, ids binary").withColumn("tie", F.xxhash64("ids"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def add() -> None:
        nonlocal total, size
        c = np.bincount(np.concatenate(held))
        if len(c) > len(total):
            c, total = total, c
        total[: len(c)] += c
        held.clear()
        size = 0

    for b in batches:
        for x in b["ids"]:
            held.append(unsqueeze(x.as_py()))
            size += len(held[-1])
            if size > BLOCK_IDS:
                add()
    if held:
        add()
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])


VERSION, _RANKS = 1, "version int, ids binary"
_ROW = "part int, block int, first long, n long, doc_ids binary, sizes binary, control binary, data binary"


def _blocks(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = first = block = 0

        def out() -> pa.RecordBatch:
            values = rank[np.concatenate([x for _, x in held])]
            control, data = encode(values)
            known = np.array([x is not None for x, _ in held], "<i8")
            ids = np.array([x or 0 for x, _ in held], "<i8")
            row = [part, block, first, len(values), np.stack([known, ids]).tobytes(), np.array([len(x) for _, x in held], "<u4").tobytes(), control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _ROW.split(", ")])

        for b in batches:
            for doc, data in zip(b["doc_id"].to_pylist(), b["ids"], strict=True):
                held.append((doc, unsqueeze(data.as_py())))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield out()
                    first, block, size, held = first + size, block + 1, 0, []
        if held:
            yield out()

    return run


def write_ids(tokens: DataFrame, path: str, parts: int) -> None:
    """Blocks and ranks at path: rows (doc_id, n, ids, tie) in ascending doc_id order over the parts (null first; ties by a hash of their ids, then by ids)."""
    spark = tokens.sparkSession
    counted = tokens.select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    ordered = np.array([i for _, i in sorted((-r["n"], r["id"]) for r in counted)], np.uint32)
    rank = np.zeros(int(ordered.max()) + 1 if len(ordered) else 1, np.uint32)
    rank[ordered] = np.arange(len(ordered), dtype=np.uint32)
    keyed = tokens.select("doc_id", "ids", F.coalesce("doc_id", F.lit(tables.LOW)).alias("key"), "tie", F.col("n").alias("weight"))
    tables.by_range(keyed, parts, "ids").select("doc_id", "ids").mapInArrow(_blocks(rank), _ROW).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(VERSION, bytearray(ordered.astype("<u4").tobytes()))], _RANKS).coalesce(1).write.parquet(f"{path}/ranks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, decoded from the files."""
    version, raw = spark.read.schema(_RANKS).parquet(f"{path}/ranks").first()
    if version != VERSION:
        raise ValueError(f"token files of version {version}")
    ordered = np.frombuffer(bytes(raw), "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = ordered[decode(r["control"], r["data"], r["n"])].astype("<u4")
                size = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                known, doc = np.frombuffer(r["doc_ids"], "<i8").reshape(2, -1)
                stop = np.cumsum(size)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((stop - size).tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=known == 0), pa.array([r["part"]] * len(size), pa.int32()), pa.array(r["first"] + stop - size), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "part", "own", "n_tokens", "ids_crc32"])

    files = spark.read.schema(_ROW).parquet(f"{path}/blocks")
    sums = files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each part
    before, total = [], 0
    for r in sums:
        before.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(before or [(0, 0)], "part int, before long")
    found = files.mapInArrow(run, "doc_id long, part int, own long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, task_bytes: int = tables.TASK_BYTES) -> DataFrame:
    """Encodes, writes and reads back: a row for each row of docs.

    A null or empty text is its end id alone. Rows with a null doc_id stand first; rows that
    repeat, or share a doc_id, are written each. A text of any length is one row, in one
    block. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    parts = tables.tasks_for(tables.text_bytes(tables.texts(docs)), task_bytes)
    tokens = tables.keep(tokenised(docs, tokenizer, False, END_ID))
    path = shared.fresh(spark, "tokens")
    write_ids(tokens, path, parts)
    return read_ids(spark, path)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(tables.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
