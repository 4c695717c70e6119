"""Positional inverted index as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from textloom.functions.text import tokens

VERSION = "1.2"
#: Tokens that a worker sorts at once, about.
RUN = 1 << 20


@dataclass
class Index:
    """docs (doc_id, url, title, length, title_length, body_length), postings (term, doc_id, tf, three position lists), terms (term, df, cf) and one row of meta.

    facts are the numbers of meta that rankers need; an index that isn't stored has them without counting its terms.
    built is there for an index that was just built: its postings and documents as one table, then its four tables.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    meta: DataFrame
    averages: DataFrame | None = None
    built: tuple[DataFrame, ...] | None = None

    @property
    def whole(self) -> DataFrame | None:
        """Postings and documents as one table, so that storing an index splits the texts once; none if a table was put in another's place."""
        if self.built and all(a is b for a, b in zip(self.built[1:], (self.docs, self.postings, self.terms, self.meta), strict=True)):
            return self.built[0]
        return None

    @property
    def facts(self) -> DataFrame:
        return (self.meta if self.averages is None else self.averages).select("num_docs", "mean_length", "mean_title", "mean_body")


def build_index(pages: DataFrame) -> Index:
    """An index of rows (doc_id, url, title, text). Title tokens come first in the shared positions; null fields are empty.

    Whole documents are dealt out by doc_id, which is less to move than their tokens; grouping by
    (document, term) then needs no further exchange, and a frequent term is no hot key. Only counts
    are gathered by term, after partial sums.
    """
    spark = pages.sparkSession
    # a fixed number, as small tables would else be put back into one task
    spread = pages.select("doc_id", "url", F.coalesce("title", F.lit("")).alias("title"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    split = lambda rows: rows.select("doc_id", "url", "title", tokens("title").alias("head"), tokens("text").alias("body"))
    docs = split(spread).select("doc_id", "url", "title", (F.size("head") + F.size("body")).alias("length"), F.size("head").alias("title_length"), F.size("body").alias("body_length"))
    kind = StructType().add("term", "string").add(spread.schema["doc_id"]).add("tf", "integer").add("positions", ArrayType(IntegerType())).add("cut", "integer").add("url", "string").add("title", "string")
    whole = split(spread.sortWithinPartitions("doc_id")).mapInArrow(_inverted, kind)
    # counts need no positions
    pairs = split(spread).select("doc_id", F.explode(F.concat("head", "body")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    terms = counted(pairs)
    tables = (docs, whole_postings(whole), terms, index_meta(docs, terms))
    return Index(*tables, averages(docs), (whole, *tables))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order of doc_id become runs sorted by term, then document: a row with a null term for each document (tf: its length), then the postings.

    cut is where title tokens end. Rows of one doc_id stay together, as they have common postings.
    """
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        tokens_of = (pc.list_value_length(batch["head"]).to_numpy(zero_copy_only=False) + pc.list_value_length(batch["body"]).to_numpy(zero_copy_only=False)).tolist()
        start = 0
        for i, (doc, n) in enumerate(zip(ids, tokens_of, strict=True)):
            if size >= RUN and doc != last:
                yield _run([*held, batch.slice(start, i - start)])
                held, size, start = [], 0, i
            size, last = size + n, doc
        held.append(batch.slice(start))
    if held:
        yield _run(held)


def _run(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    ids = rows["doc_id"].to_pylist()
    own = np.cumsum([i > 0 and x != ids[i - 1] for i, x in enumerate(ids)])  # the number of each row's document
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    size, flat = {}, {}
    for c in ("head", "body"):
        lists = rows[c].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        size[c] = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat[c] = pc.list_flatten(lists)
    within = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    words = pa.concat_arrays([flat["head"], flat["body"]]).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[words.indices.to_numpy()]
    doc = np.concatenate([np.repeat(own, size["head"]), np.repeat(own, size["body"])])
    pos = np.concatenate([within(size["head"]), np.repeat(size["head"], size["body"]) + within(size["body"])])
    by = np.lexsort((pos, doc, code)) if len(order) * len(ids) * (int(pos.max(initial=0)) + 1) >= 1 << 62 else np.argsort((code * len(ids) + doc) * (int(pos.max(initial=0)) + 1) + pos)
    code, doc, pos = code[by], doc[by], pos[by]
    at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])][: len(code)])
    n, m = len(ids), len(at)
    which = np.concatenate([np.arange(n), first[doc[at]]]) if m else np.arange(n)
    tf = np.concatenate([size["head"] + size["body"], np.diff(np.append(at, len(code)))])
    ends = np.concatenate([np.zeros(n, np.int64), at, [len(code)]])
    terms = pa.concat_arrays([pa.nulls(n, words.dictionary.type), words.dictionary.take(pa.array(order[code[at]]))])
    only = lambda c: pa.concat_arrays([rows[c].combine_chunks().cast(pa.string()), pa.nulls(m, pa.string())])
    return pa.RecordBatch.from_arrays(
        [terms.cast(pa.string()), rows["doc_id"].combine_chunks().take(pa.array(which)), pa.array(tf, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32())), pa.array(size["head"][which], pa.int32()), only("url"), only("title")],
        ["term", "doc_id", "tf", "positions", "cut", "url", "title"],
    )


def whole_postings(whole: DataFrame) -> DataFrame:
    cut = F.col("cut")
    return whole.where("term IS NOT NULL").select(
        "term", "doc_id", "tf", "positions", F.filter("positions", lambda p: p < cut).alias("title_positions"), F.transform(F.filter("positions", lambda p: p >= cut), lambda p: p - cut).alias("body_positions")
    )


def whole_docs(whole: DataFrame) -> DataFrame:
    return whole.where("term IS NULL").select("doc_id", "url", "title", F.col("tf").alias("length"), F.col("cut").alias("title_length"), (F.col("tf") - F.col("cut")).alias("body_length"))


def counted(pairs: DataFrame) -> DataFrame:
    """(term, df, cf) of rows (term, tf), one for each document that has the term."""
    return pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def averages(docs: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return docs.agg(
        F.count("*").alias("num_docs"), F.coalesce(F.sum("length"), zero).alias("total_tokens"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length"), F.coalesce(F.avg("title_length"), F.lit(0.0)).alias("mean_title"), F.coalesce(F.avg("body_length"), F.lit(0.0)).alias("mean_body")
    )


def index_meta(docs: DataFrame, terms: DataFrame) -> DataFrame:
    return averages(docs).crossJoin(terms.agg(F.count("*").alias("num_terms"))).withColumns({"version": F.lit(VERSION), "crawled_at": F.current_timestamp()})


def reconstruct_tokens(postings: DataFrame) -> DataFrame:
    """doc_id and tokens in order, from the postings."""
    return postings.select("doc_id", "term", F.explode("positions").alias("pos")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("tokens"))


def print_term(index: Index, word: str) -> DataFrame:
    """Rows (url, tf, df, cf, positions) of the word's first token."""
    from textloom.operators.boolean import words

    own = words(word)[:1]
    hit = index.postings.where(F.col("term").isin(own))
    return hit.join(index.terms.where(F.col("term").isin(own)), "term").join(index.docs.select("doc_id", "url"), "doc_id").select("url", "term", "df", "cf", "tf", "positions")
