"""Indexes on disk: Parquet tables with a version, and the older JSON form."""

from __future__ import annotations

import json
import os
import re
from itertools import accumulate

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import codecs
from textloom.functions.codecs import decode_named_blocks
from textloom.functions.text import tokens
from textloom.operators.index import VERSION, Index, counted, index_meta, whole_docs, whole_postings
from textloom.sources.shared import listing

#: Versions that can be read.
VERSIONS = ("1.0", "1.1", "1.2")
TABLES = ("docs", "postings", "terms", "meta")
GENERATION = "generation-"
#: Fixed values of the older form: its position lists, and what is added to the name for their byte codes.
LISTS = ("positions", "title_positions", "body_positions")
SIDECAR = ".postings.bin"


class StorageError(Exception):
    """An index can't be read or written."""


class IndexVersionError(StorageError):
    """The index has a version that isn't known."""


def save(index: Index, path: str) -> None:
    """Four tables; postings sorted by term within files, so that a term's scan prunes row groups or pages.

    They are written beside what is there, as a new generation whose meta comes last; only then are
    older ones deleted. So a save that breaks off leaves the old index readable and whole. An index that
    was just built has its texts split once: its postings are written with its documents among them, as
    runs that workers sorted, and the other tables come from what is written.
    """
    spark = index.docs.sparkSession
    old = _generations(spark, path)
    new = f"{path}/{GENERATION}{max(old, default=0) + 1:06d}"
    if index.whole is not None:
        index.whole.write.mode("overwrite").parquet(f"{new}/postings")
        whole = spark.read.schema(index.whole.schema).parquet(f"{new}/postings")
        whole_docs(whole).write.mode("overwrite").parquet(f"{new}/docs")
        counted(whole.where("term IS NOT NULL")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{new}/terms")
        index_meta(spark.read.parquet(f"{new}/docs"), spark.read.parquet(f"{new}/terms")).write.mode("overwrite").parquet(f"{new}/meta")
    else:
        for name in TABLES:
            df = getattr(index, name)
            if name in ("postings", "terms"):
                df = df.repartitionByRange("term").sortWithinPartitions("term") if name == "terms" else df.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
            df.write.mode("overwrite").parquet(f"{new}/{name}")
    for number in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{GENERATION}{number:06d}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _generations(spark: SparkSession, path: str) -> list[int]:
    return [int(m[1]) for name, _, _ in listing(spark, path) if (m := re.search(rf"/{GENERATION}(\d+)$", name))]


def load(spark: SparkSession, path: str) -> Index:
    """The latest generation that was written to its end."""
    whole = [n for n in _generations(spark, path) if listing(spark, f"{path}/{GENERATION}{n:06d}/meta/_SUCCESS")]
    if not whole:
        raise StorageError(f"no index at {path}")
    found = {name: spark.read.parquet(f"{path}/{GENERATION}{max(whole):06d}/{name}") for name in TABLES}
    version = found["meta"].select("version").first()
    if version is None or version[0] not in VERSIONS:
        raise IndexVersionError(f"unknown version {version and version[0]}")
    if "cut" in found["postings"].columns:
        found["postings"] = whole_postings(found["postings"])
    return Index(**found)


def load_json(spark: SparkSession, path: str) -> Index:
    """An index of the older form: one JSON document, positions plain (1.0) or as differences, in a sidecar of byte codes if so marked.

    Files older than 1.2 have no fields: their title and body positions are null until `migrate` fills them.
    """
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError) as e:
        raise StorageError(f"no readable index at {path}") from e
    if not isinstance(raw, dict):
        raise StorageError("an index is an object")
    meta = raw.get("meta") or {}
    version = meta.get("version") if isinstance(meta, dict) else None
    if version not in VERSIONS:
        raise IndexVersionError(f"unknown version {version}")
    terms = raw.get("terms", {})
    if meta.get("has_postings_bin"):
        if not os.path.exists(path + SIDECAR):
            raise StorageError(f"the byte codes beside {path} are missing")
        with open(path + SIDECAR, "rb") as f:
            blocks = decode_named_blocks(f.read())
        for key, values in blocks.items():
            term, doc, name = key.split("\t")
            try:
                terms[term]["postings"][doc][name] = values
            except KeyError as e:
                raise StorageError(f"no posting for the byte code of {term} in {doc}") from e
    read = list if version == "1.0" else lambda deltas: list(accumulate(deltas))
    rows = []
    for term, entry in terms.items():
        for doc, p in entry["postings"].items():
            rows.append((term, doc, p["tf"], *[None if p.get(name) is None else read(p[name]) for name in LISTS]))
    docs = spark.createDataFrame([(i, d["url"], d.get("title", ""), d["length"], d.get("title_length"), d.get("body_length")) for i, d in raw.get("docs", {}).items()], "doc_id string, url string, title string, length int, title_length int, body_length int")
    postings = spark.createDataFrame(rows, "term string, doc_id string, tf int, positions array<int>, title_positions array<int>, body_positions array<int>")
    counts = spark.createDataFrame([(t, e["df"], e["cf"]) for t, e in terms.items()], "term string, df long, cf long")
    facts = index_meta(docs, counts).withColumn("version", F.lit(version))
    if meta.get("crawled_at"):
        facts = facts.withColumn("crawled_at", F.to_timestamp(F.lit(meta["crawled_at"])))
    return Index(docs, postings, counts, facts)


def save_json(index: Index, path: str, *, compress: bool = False) -> None:
    """The older form, for tools that read it: one local JSON document, rows streamed into it one partition at a time.

    With compress, positions go to a sidecar of byte codes. Each file is written beside its place and then moved
    there; a sidecar from an earlier save goes away if it is no longer wanted.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    name = F.col("doc_id").cast("string")
    docs = index.docs.withColumn("doc_id", name).orderBy("doc_id").toLocalIterator()
    lists = [codecs.delta_encoded(F.col(c)).alias(c) for c in LISTS]
    held = index.postings.select("term", name.alias("doc_id"), "tf", *lists).join(index.terms.select("term", "df", "cf"), "term").orderBy("term", "doc_id").persist(StorageLevel.DISK_ONLY)
    facts = index.meta.select(F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("crawled_at"), "num_docs", "num_terms", "total_tokens").first().asDict()
    facts["version"] = VERSION
    if compress:
        facts["has_postings_bin"] = True
    fresh, side = path + ".part", path + SIDECAR + ".part"
    try:
        with open(fresh, "w", encoding="utf-8") as out:
            say = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
            out.write('{"docs": {')
            for k, r in enumerate(docs):
                row = {c: v for c, v in r.asDict().items() if c != "doc_id" and v is not None}
                out.write(f"{', ' if k else ''}{say(r['doc_id'])}: {say(row)}\n")
            out.write(f'}}, "meta": {say(facts)}, "terms": {{')
            before = None
            for r in held.toLocalIterator():
                if r["term"] != before:
                    out.write(f"{'}}, ' if before is not None else ''}{say(r['term'])}: " + f'{{"cf": {r["cf"]}, "df": {r["df"]}, "postings": {{')
                row = {"tf": r["tf"]} | {c: [] if compress else list(r[c]) for c in LISTS if r[c] is not None}
                out.write(f"{', ' if r['term'] == before else ''}{say(r['doc_id'])}: {say(row)}\n")
                before = r["term"]
            out.write(f"{'}}' if before is not None else ''}}}}}")
        if compress:
            blocks = held.agg(*[F.count(c).alias(c) for c in LISTS]).first()
            with open(side, "wb") as out:
                out.write(codecs.MAGIC + codecs.encode_varint(sum(blocks)))
                for r in held.toLocalIterator():
                    for c in LISTS:
                        if r[c] is not None:
                            key = f"{r['term']}\t{r['doc_id']}\t{c}".encode()
                            out.write(codecs.encode_varint(len(key)) + key + codecs.encode_block(r[c]))
            os.replace(side, path + SIDECAR)
        elif os.path.exists(path + SIDECAR):
            os.unlink(path + SIDECAR)
        os.replace(fresh, path)
    finally:
        held.unpersist()
        for left in (fresh, side):
            if os.path.exists(left):
                os.unlink(left)


def migrate(index: Index) -> Index:
    """An index without fields brought to the present version: positions are split where the title's tokens end."""
    title = F.size(tokens("title"))
    docs = index.docs.withColumns({"title_length": title, "body_length": F.greatest(F.lit(0), F.col("length") - title)})
    return Index(docs, split_fields(index.postings, docs.select("doc_id", "title_length")), index.terms, index_meta(docs, index.terms).drop("crawled_at").crossJoin(index.meta.select("crawled_at")))


def split_fields(postings: DataFrame, title_lengths: DataFrame) -> DataFrame:
    """Postings with title and body positions, from the shared ones and (doc_id, title_length)."""
    cut = F.coalesce("title_length", F.lit(0))
    rows = postings.drop("title_positions", "body_positions").join(title_lengths, "doc_id", "left")
    return rows.select("term", "doc_id", "tf", "positions", F.filter("positions", lambda p: p < cut).alias("title_positions"), F.transform(F.filter("positions", lambda p: p >= cut), lambda p: p - cut).alias("body_positions"))


def positions_long(postings: DataFrame) -> DataFrame:
    """(term, doc_id, field, positions): a row for each of the three lists that isn't empty."""
    fields = ("positions", "title_positions", "body_positions")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("positions")) for f in fields]))
    return postings.select("term", "doc_id", each.alias("of")).select("term", "doc_id", "of.field", "of.positions").where(F.size("positions") > 0)


def positions_restored(long: DataFrame) -> DataFrame:
    return long.groupBy("term", "doc_id").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("positions"))), F.array().cast("array<int>")).alias(f) for f in ("positions", "title_positions", "body_positions")])


def save_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)


def load_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, text) and (query_id, url) of a file of judged queries."""
    kind = "queries array<struct<id string, text string, rationale string, relevant array<string>>>"
    each = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("queries").alias("q"))
    return each.select(F.col("q.id").alias("query_id"), "q.text"), each.select(F.col("q.id").alias("query_id"), F.explode("q.relevant").alias("url"))


__all__ = ["VERSION", "IndexVersionError", "StorageError", "load", "load_json", "load_queries", "migrate", "positions_long", "positions_restored", "save", "save_json", "save_scores", "split_fields"]
