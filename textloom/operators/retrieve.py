"""Ranked retrieval: boolean, AND and phrase queries in one aggregation over the postings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from textloom.functions.rankers import RANKERS, Ranker, Stats
from textloom.operators.boolean import ParseError, has_operators, leaves, parse, predicate, words
from textloom.operators.index import Index


def find(index: Index, query: str, *, mode: str = "and", ranker: Ranker | str = "tfidf", top_k: int | None = None, explain: bool = False) -> DataFrame:
    """Rows (doc_id, url, title, score, matched_terms[, breakdown]), best first, ties by url.

    Scores are rounded to six places before sorting. A query with operators is boolean,
    whatever the mode, unless it can't be parsed: then all of its words, operators too, must be
    found. A word given twice counts twice on the plain path.
    """
    score = RANKERS[ranker] if isinstance(ranker, str) else ranker
    tree = None
    if has_operators(query):
        try:
            tree = parse(query)
        except ParseError:
            tree = None
    asked = leaves(tree) if tree else words(query)
    own = list(dict.fromkeys(asked))
    number = {w: i for i, w in enumerate(own)}
    known = F.col("term").isin(own) if own else F.lit(False)
    hits = index.postings.where(known)
    phrase = tree is None and mode == "phrase" and len(asked) > 1
    per_doc = [c for w, i in number.items() for c in _of_term(w, i, phrase)]
    found = hits.groupBy("doc_id").agg(F.count("*").alias("hits"), *per_doc)
    # one row: how many documents hold each word, from the vocabulary
    seen = index.terms.where(known).agg(F.count("*").alias("any"), *[F.coalesce(F.max(F.when(F.col("term") == w, F.col("df"))), F.lit(0)).alias(f"df{i}") for w, i in number.items()])
    facts = index.facts.crossJoin(seen)
    if tree:
        rows = index.docs.join(found, "doc_id", "left").crossJoin(F.broadcast(facts))
        rows = rows.where((F.col("any") > 0) & predicate(tree, lambda w: F.col(f"tf{number[w]}").isNotNull()))
    else:
        rows = found.where(F.col("hits") == len(own)).join(index.docs, "doc_id").crossJoin(F.broadcast(facts))
        if phrase:
            rows = rows.where(F.size(_adjacent(asked, number)) > 0)
    parts = [F.when(F.col(f"df{number[w]}") > 0, score(_stats(number[w]))).otherwise(0.0) for w in asked]
    total = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    matched = F.array(*[F.lit(w) for w in asked]) if asked else F.array().cast("array<string>")
    out = [F.col("doc_id"), F.col("url"), F.col("title"), F.round(total, 6).alias("score"), matched.alias("matched_terms")]
    if explain:
        rows_of = [F.struct(F.lit(w).alias("term"), F.coalesce(F.col(f"tf{number[w]}"), F.lit(0)).alias("tf"), F.col(f"df{number[w]}").alias("df"), F.round(p, 6).alias("contribution")) for w, p in zip(asked, parts, strict=True)]
        out.append(F.array(*rows_of).alias("breakdown"))
    ranked = rows.select(*out).orderBy(F.desc("score"), "url")
    return ranked if top_k is None else ranked.limit(top_k)


def _of_term(w: str, i: int, phrase: bool) -> list[Column]:
    mine = F.col("term") == w
    out = [F.max(F.when(mine, F.col("tf"))).alias(f"tf{i}"), F.max(F.when(mine, F.size("title_positions"))).alias(f"title{i}"), F.max(F.when(mine, F.size("body_positions"))).alias(f"body{i}")]
    return [*out, F.max(F.when(mine, F.col("positions"))).alias(f"at{i}")] if phrase else out


def _stats(i: int) -> Stats:
    c = F.col
    return Stats(c(f"tf{i}"), c(f"df{i}"), c("num_docs"), c("length"), c("mean_length"), c(f"title{i}"), c(f"body{i}"), c("title_length"), c("body_length"), c("mean_title"), c("mean_body"))


def _adjacent(asked: list[str], number: dict[str, int]) -> Column:
    """Places where the words follow each other."""
    out = F.col(f"at{number[asked[0]]}")
    for step, w in enumerate(asked[1:], 1):
        out = F.array_intersect(out, _moved(F.col(f"at{number[w]}"), step))
    return out


def _moved(places: Column, step: int) -> Column:
    return F.transform(places, lambda p: p - step)


@dataclass
class Log:
    """A query log as each worker holds it: a query's id and how many different words it has, the words that the index knows with their df, and by word (from first on) the queries that ask it and how often."""

    ids: list
    kind: DataType
    size: np.ndarray
    known: list[tuple[str, int]]
    first: np.ndarray
    query: np.ndarray
    times: np.ndarray


def gathered(index: Index, queries: DataFrame, others: DataFrame | None = None) -> Log:
    """The log of rows (query_id, qpos, term); others: a column query_id of queries that may have no words."""
    counts = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    rows = sorted(((r["term"], r["query_id"], r["times"]) for r in counts.collect()), key=lambda r: (r[0], str(r[1])))
    words_of = index.terms.select("term", "df").join(F.broadcast(counts.select("term").distinct()), "term", "left_semi")
    known = sorted((r["term"], r["df"]) for r in words_of.collect())
    more = [] if others is None else [r["query_id"] for r in others.select("query_id").distinct().collect()]
    ids = list(dict.fromkeys([*more, *[q for _, q, _ in rows]]))
    at, number = {q: i for i, q in enumerate(ids)}, {t: i for i, (t, _) in enumerate(known)}
    size = np.bincount([at[q] for _, q, _ in rows], minlength=len(ids)) if rows else np.zeros(len(ids), np.int64)
    own = [(number[t], at[q], n) for t, q, n in rows if t in number]
    first = np.searchsorted([n for n, _, _ in own], np.arange(len(known) + 1))
    return Log(ids, queries.schema["query_id"].dataType, size, known, first, np.array([q for _, q, _ in own], np.int64), np.array([n for _, _, n in own], np.float64))


def hits(index: Index, log: Log, *columns: Column | str) -> DataFrame:
    """(doc_id, number, df, columns) of the postings of the log's words, dealt out by document: no row for each query that asks a word ever travels."""
    spark = index.postings.sparkSession
    numbers = spark.createDataFrame([(t, i, df) for i, (t, df) in enumerate(log.known)], "term string, number int, df long")
    found = index.postings.select("term", "doc_id", *columns).join(F.broadcast(numbers), "term").drop("term")
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


#: Words whose counts are broadcast for `norms`, at most: those that have a FREQUENT-th of all postings or more each.
FREQUENT = 100_000
#: Pairs of a query and a document that a worker adds up at once, about.
CELLS = 1 << 20


def by_document(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of rows in order of doc_id, with the number of each row's document in the piece: whole documents, most of them at a time."""
    held = None
    for batch in _ended(batches):
        rows = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
        if rows is None or not len(rows):
            continue
        ids = pc.dictionary_encode(rows["doc_id"], null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        last = len(starts) if batch is None else len(starts) - 1  # more of the last document may follow
        for i in range(0, last, most):
            j = min(i + most, last)
            end = int(starts[j]) if j < len(starts) else len(rows)
            piece = rows.slice(int(starts[i]), end - int(starts[i]))
            yield piece, np.repeat(np.arange(j - i), np.diff(np.append(starts[i:j], end)))
        held = None if batch is None else rows.slice(int(starts[last]))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def spread(piece: pa.RecordBatch, doc: np.ndarray, log: Log) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (row, query that asks its word): the row, the cell document * queries + query, and how often it is asked."""
    number = pc.fill_null(piece["number"], len(log.known)).to_numpy()
    first = np.append(log.first, log.first[-1])  # a document without hits has one row without a word
    n = first[number + 1] - first[number]
    row = np.repeat(np.arange(len(number)), n)
    of = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[number][row]
    return row, doc[row] * len(log.ids) + log.query[of], log.times[of]


def summed(rows: DataFrame, log: Log, values: list[str], whole: bool = False, top_k: int | None = None) -> DataFrame:
    """(query_id, doc_id, values, hits): sums over the words of a query that a document has, times asked; rows are those of `hits` with values.

    whole: only documents with all words of the query. With top_k a task leaves out rows whose first value is
    below the top_k best that it has seen of the query, by more than rounding to six places can move.
    """
    kind = StructType().add("query_id", log.kind).add(rows.schema["doc_id"])
    for v in values:
        kind = kind.add(v, "double")
    kind = kind.add("hits", "long")
    ids, n = pa.array(log.ids, to_arrow_type(log.kind)), len(log.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((n, top_k or 1), -np.inf)
        for piece, doc in by_document(batches, max(1, CELLS // max(n, 1))):
            row, cell, times = spread(piece, doc, log)
            size = (int(doc[-1]) + 1) * n
            count = np.bincount(cell, minlength=size)
            sums = [np.bincount(cell, piece[v].to_numpy(zero_copy_only=False)[row] * times, size) for v in values]
            found = count == np.tile(log.size, size // n) if whole else count > 0
            if top_k is not None:
                scores = np.where(found, sums[0], -np.inf).reshape(-1, n)
                best = -np.partition(-np.concatenate([best, scores.T], axis=1), top_k - 1, axis=1)[:, :top_k]
                found &= (scores >= best.min(axis=1) - 2e-6).ravel()
            at = np.flatnonzero(found & (count > 0))
            docs = piece["doc_id"].take(pa.array(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])[at // n]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at % n)), docs, *[pa.array(s[at]) for s in sums], pa.array(count[at])], kind.names)

    return rows.sortWithinPartitions("doc_id", "number").mapInArrow(run, kind)


def find_all(index: Index, queries: DataFrame, rankers: list[str], top_k: int = 10) -> DataFrame:
    """Whole query logs at once: (query_id, qpos, term) rows give (ranker, query_id, rank, doc_id, url, score).

    Plain AND queries; each posting list is read once for all queries, and what travels are the postings of the
    log's words, by document. The log itself is held by each worker.
    """
    log = gathered(index, queries)
    c = F.col
    rows = hits(index, log, "tf", F.size("title_positions").alias("title_tf"), F.size("body_positions").alias("body_tf")).join(index.docs.drop("url", "title"), "doc_id").crossJoin(F.broadcast(index.facts))
    s = Stats(c("tf"), c("df"), c("num_docs"), c("length"), c("mean_length"), c("title_tf"), c("body_tf"), c("title_length"), c("body_length"), c("mean_title"), c("mean_body"))
    found = summed(rows.select("doc_id", "number", *[RANKERS[r](s).alias(r) for r in rankers]), log, rankers, whole=True)
    found = found.join(index.docs.select("doc_id", "url"), "doc_id")
    long = found.select("query_id", "doc_id", "url", F.explode(F.array(*[F.struct(F.lit(r).alias("ranker"), F.round(r, 6).alias("score")) for r in rankers])).alias("of")).select("of.ranker", "query_id", "doc_id", "url", "of.score")
    return ranked(long, ["ranker", "query_id"], top_k)


def norms(index: Index) -> DataFrame:
    """(doc_id, norm) of documents as vectors of damped counts times smoothed rarities; store it beside an index that is asked often.

    Frequent words, FREQUENT at most, which have most postings, are broadcast, so their postings are added up where they lie; only
    those of other words are joined by an exchange.
    """
    facts, terms = index.facts.select("num_docs"), index.terms.select("term", "df")
    least = (terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] + FREQUENT - 1) // FREQUENT
    known, rows = F.broadcast(terms.where(F.col("df") >= least)), index.postings.select("term", "doc_id", "tf")
    each = rows.join(known, "term").unionByName(rows.join(known.select("term"), "term", "left_anti").join(terms.where(F.col("df") < least), "term"))
    squares = each.crossJoin(F.broadcast(facts)).select("doc_id", F.pow(_weight(F.col("tf"), F.col("df"), F.col("num_docs")), F.lit(2)).alias("square"))
    return squares.groupBy("doc_id").agg(F.sqrt(F.sum("square")).alias("norm"))


def _weight(tf: Column, df: Column, docs: Column) -> Column:
    return (1 + F.ln(tf.cast("double"))) * _rarity(df, docs)


def _rarity(df: Column, docs: Column) -> Column:
    return F.ln((1 + docs) / (1 + df)) + 1


def cosine_all(index: Index, queries: DataFrame, top_k: int = 10, lengths: DataFrame | None = None) -> DataFrame:
    """Whole query logs by the cosine of weighted words: (query_id, rank, doc_id, url, score), scores above zero only.

    Any shared word is a match. Words unknown to the index are ignored; lengths are those of `norms`.
    """
    c = F.col
    log, docs = gathered(index, queries), index.facts.first()["num_docs"]
    rarity = np.array([math.log((1 + docs) / (1 + df)) + 1 for _, df in log.known])[np.repeat(np.arange(len(log.known)), np.diff(log.first))]
    weight = (1 + np.log(log.times)) * rarity
    own = np.sqrt(np.bincount(log.query, weight * weight, len(log.ids)))
    log = replace(log, times=weight / own[log.query])
    rows = hits(index, log, "tf").join(norms(index) if lengths is None else lengths, "doc_id")
    value = (1 + F.ln(c("tf").cast("double"))) * _rarity(c("df"), F.lit(docs)) / c("norm")
    near = summed(rows.select("doc_id", "number", value.alias("near")), log, ["near"], top_k=top_k)
    scores = near.join(index.docs.select("doc_id", "url"), "doc_id").select("query_id", "doc_id", "url", F.round("near", 6).alias("score")).where("score > 0")
    return ranked(scores, ["query_id"], top_k)


def ranked(rows: DataFrame, by: list[str], top_k: int | None) -> DataFrame:
    """Rank within groups by score, ties by url; the limit lets Spark cut before it shuffles."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc("score"), "url")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rank") <= top_k)
