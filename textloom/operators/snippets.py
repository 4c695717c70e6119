"""The densest stretch of a document for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import highlighted


def best_start(tokens: Column, wanted: list[str], window: int) -> Column:
    """Start of the first window with the most hits.

    That window is the first, or ends at a hit; so each hit is compared with the at most window hits
    that stand next before it, in time linear in the document.
    """
    hit = F.array(*[F.lit(t) for t in wanted]) if wanted else F.array().cast("array<string>")
    found = F.filter(F.transform(tokens, lambda t, i: F.when(F.array_contains(hit, t), i)), lambda i: i.isNotNull())

    def best(places: Column) -> Column:
        def ending(p: Column, j: Column) -> Column:
            start = p - window + 1
            before = F.slice(places, F.greatest(F.lit(1), j - window + 2), F.least(j + 1, F.lit(window)))
            return F.struct((-F.size(F.filter(before, lambda x: x >= start))).alias("n"), F.greatest(start, F.lit(0)).alias("s"))

        first = F.struct((-F.size(F.filter(F.slice(places, 1, window), lambda x: x < window))).alias("n"), F.lit(0).alias("s"))
        return F.array_min(F.concat(F.array(first), F.transform(places, ending)))["s"]

    return F.transform(F.array(found), best)[0]  # as a lambda's variable, so that it is found once


def snippets(docs: DataFrame, wanted: list[str], window: int = 20) -> DataFrame:
    """(doc_id, start, snippet) of rows (doc_id, tokens): hits marked, dots where text is left out."""
    if window <= 0:
        return docs.select("doc_id", F.lit(0).alias("start"), F.lit("").alias("snippet"))
    n = F.size("tokens")
    start = F.when(n <= window, F.lit(0)).otherwise(best_start(F.col("tokens"), wanted, window))
    rows = docs.withColumn("start", start)
    text = highlighted(F.slice("tokens", F.col("start") + 1, F.lit(window)), wanted)
    return rows.select("doc_id", "start", F.concat(F.when(F.col("start") > 0, "... ").otherwise(""), text, F.when(F.col("start") + window < n, " ...").otherwise("")).alias("snippet"))
