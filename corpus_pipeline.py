"""Corpus preparation: five stages that turn `documents` into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and, but for the last,
returns rows with the columns of its input. Empty inputs give empty outputs; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import curve_packing, near_copies, pu_quality, repeat_automata, rule_forest, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    own = tables.apart(docs)
    model = pu_quality.fit(own, tables.table(spark, sf_dir, "labels"))
    return tables.together(pu_quality.score(own, model).where("predicted = 1"), docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their isolation forest keep."""
    own = tables.apart(docs)
    forest = rule_forest.fit(spark, own, tables.table(spark, sf_dir, "labels"))
    return tables.together(rule_forest.judge(own, forest).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies (five-word Jaccard of 0.8 or more)."""
    return near_copies.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that recur; n_chars follows the text. A document may end up empty."""
    found = tables.together(repeat_automata.remove_repeats(tables.apart(docs)), docs.columns)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    import public_tokenizers

    return curve_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: Models, automata and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
