"""Spelling suggestions and completions from the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import deletions
from textloom.operators.boolean import words


def suggest(terms: DataFrame, word: str, *, max_distance: int = 2, max_suggestions: int = 5) -> DataFrame:
    """(term, distance) near a word's first token, nearest first, ties by term; none for a known word or no word.

    One scan of the vocabulary; lengths are compared before letters.
    """
    own = words(word)[:1]
    if not own or max_distance < 0:
        return terms.select("term", F.lit(0).alias("distance")).limit(0)
    near = terms.where(F.abs(F.length("term") - len(own[0])) <= max_distance).withColumn("distance", F.levenshtein(F.col("term"), F.lit(own[0]), max_distance))
    near = near.where("distance >= 0")
    known = near.agg(F.coalesce(F.min("distance"), F.lit(1)).alias("least"))  # a known word is at distance 0
    return near.crossJoin(F.broadcast(known)).where("least > 0").select("term", "distance").orderBy("distance", "term").limit(max_suggestions)


def build_symspell(terms: DataFrame, max_distance: int = 2) -> DataFrame:
    """The deletion dictionary: (deletion, term)."""
    if max_distance < 0:
        raise ValueError("the distance must not be negative")
    return terms.select("term", F.explode(deletions(F.col("term"), max_distance)).alias("deletion")).select("deletion", "term")


def symspell_lookup(dictionary: DataFrame, wanted: DataFrame, max_distance: int, built: int) -> DataFrame:
    """(word, term, distance) for all words of a column `word`: an equal deletion, then a check of the distance.

    The words asked for are what is broadcast, never the dictionary, which is many times the vocabulary; terms whose length
    is further from all of them than the distance have no deletions made.
    """
    if max_distance < 0 or max_distance > built:
        raise ValueError("the distance must lie between 0 and the one the dictionary was built with")
    asked = wanted.select("word", F.explode(deletions(F.col("word"), max_distance)).alias("deletion"))
    span = wanted.agg(F.coalesce(F.min(F.length("word")), F.lit(0)).alias("least"), F.coalesce(F.max(F.length("word")), F.lit(0)).alias("most")).first()
    own = dictionary.where(F.length("term").between(span["least"] - max_distance, span["most"] + max_distance))
    pairs = own.join(F.broadcast(asked), "deletion").select("word", "term").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "term", max_distance)).where("distance >= 0")


def autocomplete(terms: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """(term, cf) that begin with the prefix's first token, by falling frequency, ties by term; the prefix reaches the scan of a stored vocabulary."""
    own = words(prefix)[:1]
    if not own or k <= 0:
        return terms.select("term", "cf").limit(0)
    return terms.where(F.col("term").startswith(own[0])).select("term", "cf").orderBy(F.desc("cf"), "term").limit(k)
