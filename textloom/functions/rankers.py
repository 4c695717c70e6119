"""Scores of a term in a document, as Column expressions.

A ranker is called with the columns of a `Stats` and gives a contribution; terms not
found, or corpora without documents, give zero.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Stats:
    tf: Column
    df: Column
    docs: Column
    length: Column
    mean: Column
    title_tf: Column | None = None
    body_tf: Column | None = None
    title_length: Column | None = None
    body_length: Column | None = None
    title_mean: Column | None = None
    body_mean: Column | None = None


Ranker = Callable[[Stats], Column]


def _guarded(s: Stats, value: Column) -> Column:
    return F.when((F.coalesce(s.tf, F.lit(0)) <= 0) | (F.coalesce(s.df, F.lit(0)) <= 0) | (s.docs <= 0), F.lit(0.0)).otherwise(value)


def frequency(s: Stats) -> Column:
    return F.when(F.coalesce(s.tf, F.lit(0)) <= 0, F.lit(0.0)).otherwise(s.tf.cast("double"))


def tfidf(s: Stats) -> Column:
    return _guarded(s, (1 + F.log10(s.tf.cast("double"))) * F.log10(1 + s.docs / s.df))


def rarity(s: Stats) -> Column:
    return F.log10(1 + (s.docs - s.df + 0.5) / (s.df + 0.5))


def bm25(k1: float = 1.5, b: float = 0.75) -> Ranker:
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative, and b lies between 0 and 1")

    def score(s: Stats) -> Column:
        norm = 1 - b + b * s.length / F.greatest(s.mean, F.lit(1.0))
        return _guarded(s, rarity(s) * s.tf * (k1 + 1) / (s.tf + k1 * norm))

    return score


def bm25f(title_weight: float = 5.0, body_weight: float = 1.0, title_b: float = 0.0, body_b: float = 0.75, k1: float = 1.5) -> Ranker:
    """By fields; without fields, BM25 with body_b."""

    def score(s: Stats) -> Column:
        if s.title_tf is None:
            return bm25(k1, body_b)(s)

        def field(tf: Column, length: Column, mean: Column, b: float) -> Column:
            return tf / F.greatest(1 - b + b * length / F.greatest(mean, F.lit(1.0)), F.lit(1e-9))

        w = title_weight * field(s.title_tf, s.title_length, s.title_mean, title_b) + body_weight * field(s.body_tf, s.body_length, s.body_mean, body_b)
        fields = F.when(w > 0, rarity(s) * w * (k1 + 1) / (w + k1)).otherwise(0.0)
        # documents of older indexes have no fields
        return _guarded(s, F.when(s.title_length.isNull(), bm25(k1, body_b)(s)).otherwise(fields))

    return score


RANKERS: dict[str, Ranker] = {"frequency": frequency, "tfidf": tfidf, "bm25": bm25(), "bm25f": bm25f()}
