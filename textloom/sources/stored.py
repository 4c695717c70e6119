"""Indexes written once in a session and then queried where they lie."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.index import Index
from textloom.sources import shared, storage

_written: dict[tuple, str] = {}


def once(spark: SparkSession, key: tuple, write: Callable[[str], None], *inputs: str) -> str:
    """Where something made of the tables at inputs is; written at the first call, and again if a table's files have changed."""
    found = (spark.sparkContext.applicationId, *key, *[shared.listing(spark, p) for p in inputs])
    if found not in _written:
        path = shared.fresh(spark, "stored")
        write(path)
        _written[found] = path
    return _written[found]


def index(spark: SparkSession, name: str, build: Callable[[], Index], *inputs: str) -> Index:
    """The index that build gives, from its written tables: scans by term reach few of their row groups."""
    return storage.load(spark, once(spark, ("index", name), lambda path: storage.save(build(), path), *inputs))


def rows(spark: SparkSession, name: str, build: Callable[[], DataFrame], *inputs: str) -> DataFrame:
    return spark.read.parquet(once(spark, ("rows", name), lambda path: build().write.parquet(path), *inputs))
