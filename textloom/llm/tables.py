"""Shared steps of the operators: reading inputs, sizing, dealing out by a number, keeping a table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from textloom.sources import shared

#: Bytes of text that one task is meant to hold.
TASK_BYTES = 8 << 20
#: Bytes of text from which tasks grow with the root of the input.
GROWS_FROM = 4 << 30
#: Rows sampled for each range; the driver holds them as three numbers each.
PER_RANGE = 32
#: Stands before all numbers, for nulls.
LOW = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns cannot clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def apart(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one named rest, so that no name can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("#")).alias("rest"))


def together(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns that `apart` put away, in their order, and more that were made since."""
    return rows.select([F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in columns] + list(more))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def grown(size: int) -> float:
    """By how much tasks grow for a large input, so that the pieces between all tasks grow no faster than the input."""
    return max(1.0, math.sqrt(size / GROWS_FROM))


def tasks_for(size: int, each: int = TASK_BYTES, least: int = 1) -> int:
    return max(least, math.ceil(size / (each * grown(size))))


def deal(df: DataFrame, n: int, column: str) -> DataFrame:
    """Rows go to the partition that the column numbers, below n."""
    return df.repartitionById(n, F.col(column))


@dataclass(frozen=True)
class Ranges:
    """Cuts of two numbers, in ascending order; each is a row of the input, and the first of its range."""

    key: np.ndarray
    tie: np.ndarray

    def __len__(self) -> int:
        return len(self.key) + 1

    def of(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        return np.searchsorted(_ordered(self.key, self.tie), _ordered(key, tie), "right")


def _ordered(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Pairs of numbers as bytes that sort alike."""
    both = np.stack([key, tie], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.astype(">u8").view("S16").ravel()


def ranges(rows: DataFrame, parts: int) -> Ranges:
    """Ranges of about even weight over rows (key, tie, weight), all long, from a sample by weight: PER_RANGE rows for each range."""
    total = rows.agg(F.sum("weight")).first()[0] or 0
    if parts < 2 or not total:
        return Ranges(np.zeros(0, np.int64), np.zeros(0, np.int64))
    each = total / (PER_RANGE * parts)
    chance = F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 30)) / (1 << 30)
    found = rows.where(chance < F.col("weight") / each).select("key", "tie", "weight").toArrow()
    key, tie, weight = (found[c].to_numpy() for c in ("key", "tie", "weight"))
    order = np.lexsort((tie, key))
    key, tie, passed = key[order], tie[order], np.cumsum(np.maximum(weight[order], each))
    at = np.searchsorted(passed, np.arange(1, parts) / parts * passed[-1]) if len(passed) else np.zeros(0, np.int64)
    key, tie = key[at], tie[at]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])
    return Ranges(key[new], tie[new])


def by_range(rows: DataFrame, parts: int, *more: str) -> DataFrame:
    """Rows with columns key, tie and weight dealt out by ranges of (key, tie) of about even weight, and sorted by both, and more, in each."""
    cuts = ranges(rows.select("key", "tie", "weight"), parts)

    @F.arrow_udf(IntegerType())
    def of(key: pa.Array, tie: pa.Array) -> pa.Array:  # the other columns stay in the JVM
        return pa.array(cuts.of(key.to_numpy(), tie.to_numpy()), pa.int32())

    return deal(rows.withColumn("range", of("key", "tie")), len(cuts), "range").drop("range").sortWithinPartitions("key", "tie", *more)


def keep(df: DataFrame) -> DataFrame:
    """A written copy in the shared folder of spark.checkpoint.dir; cuts the lineage, survives lost executors, goes when the session does."""
    return shared.kept(df)


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def with_columns(schema: StructType, made: list[tuple[str, str]]) -> StructType:
    """The schema with (name, type) columns behind it; the given one stays as it is."""
    out = StructType(list(schema.fields))
    for name, kind in made:
        out = out.add(name, kind)
    return out
