"""Dense vectors of documents, made by an encoder that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import dot, l2_normalised
from textloom.operators.index import Index, reconstruct_tokens
from textloom.sources.storage import StorageError

#: list of texts -> rows of numbers; or an object whose `encode` does that.
Encoder = Callable[[list[str]], Any] | Any


def unit_rows(encoder: Encoder, texts: list[str]) -> np.ndarray:
    """Vectors of length one; zero vectors stay."""
    raw = encoder.encode(texts) if hasattr(encoder, "encode") else encoder(texts)
    rows = np.asarray(raw, dtype=np.float32)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def encoded(texts: DataFrame, encoder: Encoder, column: str = "text") -> DataFrame:
    """The rows with `embedding array<float>` in place of the text; Arrow batches bound what an encoder gets at once. Null texts are empty."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            own = batch.fillna("").tolist()
            yield pd.Series(list(unit_rows(encoder, own)) if own else [], dtype=object)

    return texts.withColumn("embedding", vectors(F.col(column))).drop(column)


def from_index(index: Index, encoder: Encoder) -> DataFrame:
    """(doc_id, embedding) of every document: its title, then its tokens as the index holds them."""
    body = reconstruct_tokens(index.postings).select("doc_id", F.array_join("tokens", " ").alias("body"))
    texts = index.docs.select("doc_id", "title").join(body, "doc_id", "left")
    return encoded(texts.select("doc_id", F.trim(F.concat_ws(" ", "title", "body")).alias("text")), encoder)


def save(vectors: DataFrame, path: str, model: str) -> None:
    """Parquet vectors; the model's name comes last."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(model,)], "model string").write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The vectors and the model's name."""
    try:
        return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/model").first()["model"]
    except Exception as e:
        raise StorageError(f"no vectors at {path}") from e


def rank(index: Index, vectors: DataFrame, query: str, encoder: Encoder, top_k: int | None = None) -> DataFrame:
    """Rows (doc_id, url, title, score, matched_terms) by cosine, ties by url; none for a blank query.

    Vectors without a document are left out; scores, not vectors, take part in the join.
    """
    asked = unit_rows(encoder, [query])[0] if query.strip() else []
    own = F.array(*[F.lit(float(x)) for x in asked]).cast("array<double>")
    scores = vectors.select("doc_id", F.round(dot(l2_normalised(F.col("embedding")), own), 6).alias("score"))
    rows = (scores if query.strip() else scores.limit(0)).join(index.docs.select("doc_id", "url", "title"), "doc_id")
    out = rows.select("doc_id", "url", "title", "score", F.array().cast("array<string>").alias("matched_terms")).orderBy(F.desc("score"), "url")
    return out if top_k is None else out.limit(top_k)
