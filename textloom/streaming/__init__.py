"""Streams of new documents into stored postings (an extension: batches build whole indexes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import Index, averages, build_index, index_meta
from textloom.sources.shared import listing
from textloom.sources.storage import StorageError

#: Docs come last, so a batch that has them is whole.
TABLES = ("postings", "docs")


def append_postings(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends postings and documents of each micro-batch of rows (doc_id, url, title, text); runs until the input is used up."""

    def each(batch: DataFrame, number: int) -> None:
        index = build_index(batch)
        for name in TABLES:
            # a batch that is run again writes over its own folder
            getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str) -> Index:
    """The index of all whole batches at a path, to query or to save; a doc_id must stand in one batch only.

    Counts and facts are found from the postings, as a batch can't know those of the others.
    """
    batches = [name for name, _, _ in listing(spark, f"{path}/docs") if listing(spark, f"{name}/_SUCCESS")]
    if not batches:
        raise StorageError(f"no batches at {path}")
    docs = spark.read.parquet(*batches)
    postings = spark.read.parquet(*[f"{path}/postings/{b.rsplit('/', 1)[1]}" for b in batches])
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return Index(docs, postings, terms, index_meta(docs, terms), averages(docs))
