"""Registered queries, and the SQL that a second engine runs for them on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import codecs, text
from textloom.operators import boolean, fuzzy, learned, ranking, retrieve, snippets
from textloom.operators.index import Index, build_index, print_term, reconstruct_tokens
from textloom.plans import sql
from textloom.sources import crawl, shared, storage, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _built(spark: SparkSession, sf_dir: str) -> Index:
    """Plain documents, indexed anew: the address is the document's number, padded so that texts sort as numbers do."""
    docs = _table(spark, sf_dir, "documents")
    return build_index(docs.select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("url"), F.lit("").alias("title"), "text"))


def documents(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of documents."""
    return stored.index(spark, "documents", lambda: _built(spark, sf_dir), f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> Index:
    rows = _table(spark, sf_dir, "pages")
    return stored.index(spark, "pages", lambda: build_index(rows.select(F.col("page_id").alias("doc_id"), "url", text.html_title(F.col("html")).alias("title"), text.html_text(F.col("html")).alias("text"))), f"{sf_dir}/pages.parquet")


def turns(spark: SparkSession, sf_dir: str) -> Index:
    """Turns of conversations; the role is their title."""
    name = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = _table(spark, sf_dir, "conversations").select(name.alias("doc_id"), name.alias("url"), F.col("role").alias("title"), "text")
    return stored.index(spark, "turns", lambda: build_index(rows), f"{sf_dir}/conversations.parquet")


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# index


@query(f"SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS tokens FROM documents")
def tokenize_docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokens("text"), " ").alias("tokens"))


@query(f"SELECT doc_id, CAST(len({sql.tokens('text')}) AS INTEGER) AS length FROM documents")
def doc_lengths(spark, sf_dir):
    return _built(spark, sf_dir).docs.select("doc_id", "length")


@query(sql.DOCS + "SELECT term, doc_id, CAST(tf AS INTEGER) AS tf, array_to_string(positions, ' ') AS positions FROM post")
def index_postings(spark, sf_dir):
    return _built(spark, sf_dir).postings.select("term", "doc_id", "tf", _joined("positions").alias("positions"))


@query(sql.DOCS + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def index_terms(spark, sf_dir):
    return _built(spark, sf_dir).terms


@query(sql.DOCS + "SELECT num_docs, (SELECT count(DISTINCT term) FROM post) AS num_terms, (SELECT CAST(sum(length) AS BIGINT) FROM docs) AS total_tokens, round(mean_length, 6) AS mean_length FROM facts")
def index_meta(spark, sf_dir):
    return _built(spark, sf_dir).meta.select("num_docs", "num_terms", "total_tokens", F.round("mean_length", 6).alias("mean_length"))


@query(sql.PAGES + "SELECT term, doc_id, field, array_to_string(positions, ' ') AS positions FROM (SELECT term, doc_id, 'positions' AS field, positions FROM post UNION ALL SELECT term, doc_id, 'title_positions', title_positions FROM post UNION ALL SELECT term, doc_id, 'body_positions', body_positions FROM post) WHERE len(positions) > 0")
def postings_long(spark, sf_dir):
    return storage.positions_long(pages(spark, sf_dir).postings).select("term", "doc_id", "field", _joined("positions").alias("positions"))


@query(sql.PAGES + "SELECT term, doc_id, array_to_string(positions, ' ') AS positions, array_to_string(title_positions, ' ') AS title_positions, array_to_string(body_positions, ' ') AS body_positions FROM post")
def positions_restored(spark, sf_dir):
    own = storage.positions_restored(storage.positions_long(pages(spark, sf_dir).postings))
    return own.select("term", "doc_id", *[_joined(c).alias(c) for c in ("positions", "title_positions", "body_positions")])


@query(sql.PAGES + "SELECT term, doc_id, array_to_string(title_positions, ' ') AS title_positions, array_to_string(body_positions, ' ') AS body_positions FROM post")
def positions_split_fields(spark, sf_dir):
    index = pages(spark, sf_dir)
    own = storage.split_fields(index.postings, index.docs.select("doc_id", "title_length"))
    return own.select("term", "doc_id", _joined("title_positions").alias("title_positions"), _joined("body_positions").alias("body_positions"))


@query(sql.DOCS + "SELECT term, doc_id, array_to_string(list_transform(positions, lambda x, i: x - CASE WHEN i = 1 THEN 0 ELSE positions[i - 1] END), ' ') AS deltas FROM post")
def delta_encode(spark, sf_dir):
    return documents(spark, sf_dir).postings.select("term", "doc_id", _joined_column(codecs.delta_encoded(F.col("positions"))).alias("deltas"))


@query(sql.DOCS + "SELECT term, doc_id, array_to_string(positions, ' ') AS positions FROM post")
def delta_decode(spark, sf_dir):
    own = documents(spark, sf_dir).postings.withColumn("deltas", codecs.delta_encoded(F.col("positions")))
    return own.select("term", "doc_id", _joined_column(codecs.delta_decoded(F.col("deltas"))).alias("positions"))


def _joined_column(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query(sql.DOCS + "SELECT term, CAST(sum(list_sum(list_transform(list_transform(positions, lambda x, i: x - CASE WHEN i = 1 THEN 0 ELSE positions[i - 1] END), lambda v: CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 ELSE 3 END))) AS BIGINT) AS bytes FROM post GROUP BY term")
def vbyte_size(spark, sf_dir):
    size = F.aggregate(codecs.delta_encoded(F.col("positions")), F.lit(0), lambda a, x: a + codecs.varint_size(x))
    return documents(spark, sf_dir).postings.select("term", size.alias("n")).groupBy("term").agg(F.sum("n").alias("bytes"))


@query(sql.DOCS + "SELECT term, doc_id, array_to_string(positions, ' ') AS positions FROM post")
def vbyte_round_trip(spark, sf_dir):
    own = documents(spark, sf_dir).postings.withColumn("code", codecs.block_encoded("positions"))
    return own.select("term", "doc_id", _joined_column(codecs.block_decoded("code")).alias("positions"))


@query(sql.DOCS + "SELECT url, term, df, cf, CAST(tf AS INTEGER) AS tf, array_to_string(positions, ' ') AS positions FROM post JOIN docs USING (doc_id) JOIN (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term) USING (term) WHERE term = 'ingor'")
def print_term_rows(spark, sf_dir):
    return print_term(documents(spark, sf_dir), "Ingor!").withColumn("positions", _joined("positions"))


@query(f"SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS tokens FROM documents WHERE len({sql.tokens('text')}) > 0")
def reconstruct_tokens_docs(spark, sf_dir):
    return reconstruct_tokens(documents(spark, sf_dir).postings).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


# retrieval


def _found(name: str, index: Callable, corpus: str, asked: str, oracle: str, **options) -> None:
    def run(spark, sf_dir):
        return retrieve.find(index(spark, sf_dir), asked, **options).select("doc_id", "url", "score", F.array_join("matched_terms", " ").alias("matched_terms"))

    run.__name__ = name
    query(corpus + oracle)(run)


for _name in ("frequency", "tfidf", "bm25"):
    _found(f"find_{_name}", documents, sql.DOCS, "the of", sql.find(["the", "of"], _name), ranker=_name)
_found("find_bm25f_pages", pages, sql.PAGES, "the ingor", sql.find(["the", "ingor"], "bm25f"), ranker="bm25f")
_found("find_bm25f_turns", turns, sql.TURNS, "user the", sql.find(["user", "the"], "bm25f"), ranker="bm25f")
_found("find_bm25_pages", pages, sql.PAGES, "the of", sql.find(["the", "of"], "bm25"), ranker="bm25")
_found("find_single_term", documents, sql.DOCS, "ingor", sql.find(["ingor"], "tfidf"))
_found("find_and2", documents, sql.DOCS, "Ingor, the", sql.find(["ingor", "the"], "bm25"), ranker="bm25")
_found("find_and3", documents, sql.DOCS, "the of to", sql.find(["the", "of", "to"], "bm25"), ranker="bm25")
_found("find_duplicate_token", documents, sql.DOCS, "the the ingor", sql.find(["the", "the", "ingor"], "tfidf"))
_found("find_phrase2", documents, sql.DOCS, "of the", sql.find(["of", "the"], "tfidf", phrase=True), mode="phrase")
_found("find_phrase3", documents, sql.DOCS, "of the in", sql.find(["of", "the", "in"], "tfidf", phrase=True), mode="phrase")
_found("find_phrase_repeated", documents, sql.DOCS, "the the", sql.find(["the", "the"], "tfidf", phrase=True), mode="phrase")
_found("find_unknown_empty", documents, sql.DOCS, "the zzzunknown", sql.find(["the", "zzzunknown"], "tfidf"))
_found("find_top_k", documents, sql.DOCS, "the", sql.find(["the"], "bm25", top_k=10), ranker="bm25", top_k=10)
_found("bool_and", documents, sql.DOCS, "the and ingor", sql.boolean(["the", "ingor"], "the AND ingor", "bm25"), ranker="bm25")
_found("bool_or", documents, sql.DOCS, "atou OR ingor", sql.boolean(["atou", "ingor"], "atou OR ingor", "bm25"), ranker="bm25")
_found("bool_not", documents, sql.DOCS, "NOT the", sql.boolean(["the"], "NOT the", "tfidf"))
_found("bool_compound", documents, sql.DOCS, "(the OR ingor) AND NOT of", sql.boolean(["the", "ingor", "of"], "(the OR ingor) AND NOT of", "tfidf"))
_found("bool_precedence", documents, sql.DOCS, "de OR the AND NOT of", sql.boolean(["de", "the", "of"], "de OR (the AND NOT of)", "bm25"), ranker="bm25")
_found("bool_ignores_phrase", documents, sql.DOCS, "of AND the", sql.boolean(["of", "the"], "of AND the", "tfidf"), mode="phrase")
_found("bool_unknown_term", documents, sql.DOCS, "ingor OR zzzunknown", sql.boolean(["ingor", "zzzunknown"], "ingor OR zzzunknown", "tfidf"))
_found("bool_not_unknown", documents, sql.DOCS, "NOT zzzunknown", sql.boolean(["zzzunknown"], "NOT zzzunknown", "tfidf"))
_found("bool_fallback_plain", documents, sql.DOCS, "the in and", sql.find(["the", "in", "and"], "tfidf"))


@query(sql.DOCS + sql.explain(["the", "ingor"], "bm25"))
def find_explain(spark, sf_dir):
    own = retrieve.find(documents(spark, sf_dir), "the ingor", ranker="bm25", explain=True)
    return own.select("doc_id", "score", F.explode("breakdown").alias("b")).select("doc_id", "score", "b.term", "b.tf", "b.df", "b.contribution")


# vocabulary


# the second engine counts bytes; a mark in place of each wider letter, which no word asked for has, leaves distances as they are
_NARROW = "regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g')"


@query(sql.DOCS + f"SELECT term, distance FROM (SELECT term, CAST(levenshtein({_NARROW}, 'ingro') AS INTEGER) AS distance FROM (SELECT DISTINCT term FROM post)) WHERE distance <= 2 ORDER BY distance, term LIMIT 5")
def suggest_levenshtein(spark, sf_dir):
    return fuzzy.suggest(documents(spark, sf_dir).terms, "ingro")


def _symspell(most: int, name: str, asked: list[str]) -> None:
    values = ", ".join(f"('{w}')" for w in asked)

    @query(sql.DOCS + f"SELECT word, term, distance FROM (SELECT word, term, CAST(levenshtein({_NARROW}, word) AS INTEGER) AS distance FROM (SELECT DISTINCT term FROM post), (VALUES {values}) w(word)) WHERE distance <= {most}", name)
    def run(spark, sf_dir):
        wanted = spark.createDataFrame([(w,) for w in asked], "word string")
        return fuzzy.symspell_lookup(fuzzy.build_symspell(documents(spark, sf_dir).terms, most), wanted, most, most)


_symspell(1, "suggest_symspell", ["ingro", "thx", "wtih"])
_symspell(2, "suggest_symspell2", ["ingroo", "thx", "wtihe"])


@query(sql.DOCS + "SELECT DISTINCT term, deletion FROM (SELECT term, term AS deletion FROM post UNION ALL SELECT term, concat(substr(term, 1, i - 1), substr(term, i + 1)) FROM (SELECT term, unnest(generate_series(1, length(term))) AS i FROM (SELECT DISTINCT term FROM post)))")
def symspell_deletions(spark, sf_dir):
    return fuzzy.build_symspell(documents(spark, sf_dir).terms, 1)


@query(sql.DOCS + "SELECT term, CAST(sum(tf) AS BIGINT) AS cf FROM post WHERE starts_with(term, 'in') GROUP BY term ORDER BY cf DESC, term LIMIT 10")
def autocomplete_prefix(spark, sf_dir):
    return fuzzy.autocomplete(documents(spark, sf_dir).terms, "in", 10)


@query(sql.snippet(["the", "ingor"], 20, render=False))
def snippet_best_window(spark, sf_dir):
    return _snippets(spark, sf_dir).select("doc_id", "start")


@query(sql.snippet(["the", "ingor"], 20, render=True))
def snippet_render(spark, sf_dir):
    return _snippets(spark, sf_dir)


def _snippets(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return snippets.snippets(docs.select("doc_id", text.tokens("text").alias("tokens")), ["the", "ingor"], 20)


# pages


@query(f"SELECT page_id, {sql.html_title('html')} AS title, {sql.html_text('html')} AS text FROM pages")
def html_title_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), text.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, i - 1 AS pos, link FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1), lambda x: replace(trim(x), '&amp;', '&')), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(javascript:|mailto:|tel:|#)')) AS l FROM pages))")
def html_links(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.html_links(F.col("html"))).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query("SELECT page_id, url, regexp_replace(url, '#.*$', '') AS plain FROM pages")
def url_normalise(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url", text.url_normalised(F.col("url")).alias("plain"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages")
def url_host(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))


@query("SELECT min(doc_id) AS doc_id, sha1(text) AS digest, count(*) AS copies FROM documents GROUP BY sha1(text)")
def content_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


#: A small graph with loops, two ways to one page, and a page that nothing leads to.
EDGES = [("s", 0, "a"), ("s", 1, "b"), ("a", 0, "c"), ("a", 1, "s"), ("b", 0, "d"), ("b", 1, "c"), ("c", 0, "e"), ("d", 0, "e"), ("d", 1, "a"), ("x", 0, "s"), ("e", 0, "f")]


@query(f"WITH RECURSIVE links AS (SELECT * FROM (VALUES {', '.join(map(str, EDGES))}) v(src, pos, dst)), walks AS (SELECT 's' AS url, 0 AS level, '' AS path UNION ALL SELECT dst, level + 1, path || lpad(CAST(pos AS VARCHAR), 6, '0') || '/' FROM walks JOIN links ON url = src WHERE level < 8) SELECT url, CAST(min(level) AS INTEGER) AS level, arg_min(path, CAST(level + 100 AS VARCHAR) || path) AS path FROM walks GROUP BY url")
def crawl_bfs(spark, sf_dir):
    return crawl.walk(spark.createDataFrame(EDGES, "src string, pos int, dst string"), "s")


# vectors and fusion


def _vector(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"]


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark, sf_dir):
    return ranking.dense_top(_table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm, CASE WHEN list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unit FROM embeddings")
def l2_normalise(spark, sf_dir):
    v = F.col("embedding")
    unit = text.l2_normalised(v)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(text.dot(v, v)), 6).alias("norm"), F.round(F.sqrt(text.dot(unit, unit)), 6).alias("unit"))


@query(sql.DOCS + f"SELECT url, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT url, row_number() OVER (ORDER BY score DESC, url) AS rank FROM ({sql.find(['the', 'of'], 'tfidf', top_k=20)}) UNION ALL SELECT url, row_number() OVER (ORDER BY score DESC, url) AS rank FROM ({sql.find(['the', 'of'], 'bm25', top_k=20)})) GROUP BY url")
def rrf_hybrid(spark, sf_dir):
    index = documents(spark, sf_dir)
    runs = [retrieve.ranked(retrieve.find(index, "the of", ranker=r, top_k=20).withColumn("query_id", F.lit(0)), ["query_id"], 20) for r in ("tfidf", "bm25")]
    return ranking.fuse(runs).select("url", "score")


# query logs and evaluation


def query_log(spark, sf_dir) -> DataFrame:
    """(query_id, qpos, term): all tokens of each benchmark item."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(text.tokens("text")).alias("qpos", "term"))


def _judged(spark, sf_dir) -> DataFrame:
    """Good documents, relevant to every query."""
    return _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()


LOG_RANKERS = ["frequency", "tfidf", "bm25"]


@query(sql.DOCS + sql.LOG + "SELECT ranker, query_id, doc_id, score, rank FROM run")
def find_query_log(spark, sf_dir):
    run = retrieve.find_all(documents(spark, sf_dir), query_log(spark, sf_dir), LOG_RANKERS)
    return run.select("ranker", "query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _run(spark, sf_dir) -> DataFrame:
    """The log's run under LOG_RANKERS, written once."""
    return stored.rows(spark, "run", lambda: retrieve.find_all(documents(spark, sf_dir), query_log(spark, sf_dir), LOG_RANKERS), *[f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark")])


def _scores(spark, sf_dir):
    return ranking.metrics(_run(spark, sf_dir), _judged(spark, sf_dir), query_log(spark, sf_dir))


@query(sql.DOCS + sql.LOG + sql.METRICS + "SELECT ranker, query_id, round(p_5, 6) AS p_5, round(r_5, 6) AS r_5, round(p_10, 6) AS p_10, round(r_10, 6) AS r_10 FROM scores")
def precision_recall_at_k(spark, sf_dir):
    return _scores(spark, sf_dir).select("ranker", "query_id", *[F.round(c, 6).alias(c) for c in ("p_5", "r_5", "p_10", "r_10")])


@query(sql.DOCS + sql.LOG + sql.METRICS + "SELECT ranker, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map FROM scores GROUP BY ranker")
def mrr_map(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("ranker").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ap"), 6).alias("map"))


@query(sql.DOCS + sql.LOG + sql.METRICS + "SELECT ranker, coalesce(CAST(query_id AS VARCHAR), '_MEAN_') AS query_id, round(avg(p_5), 6) AS p_5, round(avg(p_10), 6) AS p_10, round(avg(r_5), 6) AS r_5, round(avg(rr), 6) AS rr, round(avg(ap), 6) AS ap FROM scores GROUP BY GROUPING SETS ((ranker, query_id), (ranker))")
def eval_rankers_batch(spark, sf_dir):
    return ranking.with_means(_scores(spark, sf_dir)).select("ranker", "query_id", "p_5", "p_10", "r_5", "rr", "ap")


@query(sql.DOCS + sql.LOG + "SELECT query_id, round(CASE WHEN na IS NULL THEN 1.0::DOUBLE ELSE common::DOUBLE / greatest(na, nb) END, 6) AS overlap FROM (SELECT DISTINCT query_id FROM log) LEFT JOIN (SELECT query_id, sum(a) AS na, sum(b) AS nb, sum(a * b) AS common FROM (SELECT query_id, doc_id, max(CASE WHEN ranker = 'tfidf' THEN 1 ELSE 0 END) AS a, max(CASE WHEN ranker = 'bm25' THEN 1 ELSE 0 END) AS b FROM run WHERE rank <= 5 AND ranker <> 'frequency' GROUP BY ALL) GROUP BY query_id) USING (query_id)")
def overlap_at_5(spark, sf_dir):
    run = retrieve.find_all(documents(spark, sf_dir), query_log(spark, sf_dir), ["tfidf", "bm25"], 5)
    own = ranking.overlap(run.where("ranker = 'tfidf'"), run.where("ranker = 'bm25'"), query_log(spark, sf_dir))
    return own.select("query_id", F.round("overlap", 6).alias("overlap"))


@query(sql.DOCS + sql.LOG + sql.COSINE + "SELECT query_id, doc_id, score, rank FROM cosines")
def cosine_query_log(spark, sf_dir):
    run = retrieve.cosine_all(documents(spark, sf_dir), query_log(spark, sf_dir))
    return run.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(sql.DOCS + sql.LOG + sql.COSINE + sql.overlap("SELECT * FROM run WHERE ranker = 'tfidf' AND rank <= 5", "SELECT * FROM cosines WHERE rank <= 5"))
def overlap_cosine_at_5(spark, sf_dir):
    index, log = documents(spark, sf_dir), query_log(spark, sf_dir)
    own = ranking.overlap(retrieve.find_all(index, log, ["tfidf"], 5), retrieve.cosine_all(index, log, 5), log)
    return own.select("query_id", F.round("overlap", 6).alias("overlap"))


def _asked(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).distinct()


@query(sql.DOCS + sql.LOG + sql.FEATURES)
def ltr_features(spark, sf_dir):
    """Every query beside every document: a stated query log against all rows."""
    return learned.features(documents(spark, sf_dir), query_log(spark, sf_dir), asked=_asked(spark, sf_dir))


def _learnable(spark, sf_dir) -> DataFrame:
    """Every query beside every document; those without any of its words have zeros for terms. Written once."""

    def build() -> DataFrame:
        grades = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("grade"))
        return ltr_features(spark, sf_dir).join(grades, "doc_id", "left").fillna(0.0, ["grade"])

    return stored.rows(spark, "learnable", build, *[f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "labels")])


@query()
def ltr_rank(spark, sf_dir):
    rows = _learnable(spark, sf_dir)
    return learned.rank(learned.train(rows), rows)


def _folds(spark, sf_dir) -> DataFrame:
    """Average precision of the learned ranker on each query, with that query left out of its training, beside that of BM25; both rank all documents."""
    rows = _learnable(spark, sf_dir)
    own = learned.cross_validated(rows, F.col("query_id")).withColumn("ranker", F.lit("learned"))
    plain = retrieve.ranked(rows.select("query_id", "doc_id", F.col("bm25_sum").alias("score"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("url")), ["query_id"], None).withColumn("ranker", F.lit("bm25"))
    run = shared.kept(own.select("ranker", "query_id", "doc_id", "rank").unionByName(plain.select("ranker", "query_id", "doc_id", "rank")))
    return ranking.metrics(run, _judged(spark, sf_dir), _asked(spark, sf_dir)).select("ranker", "query_id", "ap")


@query()
def ltr_folds(spark, sf_dir):
    return _folds(spark, sf_dir).groupBy("query_id").agg(*[F.round(F.max(F.when(F.col("ranker") == r, F.col("ap"))), 6).alias(f"ap_{r}") for r in ("learned", "bm25")])


@query(sql.DOCS + sql.LOG + sql.METRICS + "SELECT count(*) AS queries, count(*) FILTER (a.ap > b.ap + 1e-9) AS wins, round(avg(a.ap), 6) AS mean_a, round(avg(b.ap), 6) AS mean_b FROM (SELECT * FROM scores WHERE ranker = 'bm25') a JOIN (SELECT * FROM scores WHERE ranker = 'frequency') b USING (query_id)")
def ranker_wins(spark, sf_dir):
    own = shared.kept(_scores(spark, sf_dir).select("ranker", "query_id", "ap"))
    won = ranking.wins(own.where("ranker = 'bm25'"), own.where("ranker = 'frequency'"))
    return won.select("queries", "wins", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


# indexes on disk and pages at hand


@query(sql.PAGES + "SELECT term, doc_id, CAST(tf AS INTEGER) AS tf, array_to_string(positions, ' ') AS positions, array_to_string(title_positions, ' ') AS titles FROM post")
def storage_round_trip(spark, sf_dir):
    """Saved twice, so that an older generation gives way, and loaded."""
    path = shared.fresh(spark, "index")
    storage.save(pages(spark, sf_dir), path)
    storage.save(storage.load(spark, path), path)
    return storage.load(spark, path).postings.select("term", "doc_id", "tf", _joined("positions").alias("positions"), _joined("title_positions").alias("titles"))


@query(sql.DOCS + sql.LOG + sql.METRICS + "SELECT ranker, query_id, round(p_5, 6) AS p_5, round(rr, 6) AS rr FROM scores")
def scores_csv_round_trip(spark, sf_dir):
    path = shared.fresh(spark, "scores")
    storage.save_scores(_scores(spark, sf_dir).select("ranker", "query_id", F.round("p_5", 6).alias("p_5"), F.round("rr", 6).alias("rr")), path)
    return spark.read.option("header", True).schema("ranker string, query_id long, p_5 double, rr double").csv(path)


@query(sql.PAGES + sql.find(["the", "of"], "bm25"))
def find_bm25f_without_fields(spark, sf_dir):
    """An index without fields, as older ones are: BM25F falls back to BM25."""
    own = pages(spark, sf_dir)
    bare = Index(own.docs.withColumns({c: F.lit(None).cast("int") for c in ("title_length", "body_length")}), own.postings.withColumns({c: F.lit(None).cast("array<int>") for c in ("title_positions", "body_positions")}), own.terms, own.meta)
    return retrieve.find(bare, "the of", ranker="bm25f").select("doc_id", "url", "score", F.array_join("matched_terms", " ").alias("matched_terms"))


_LINKS = "SELECT DISTINCT url AS src, i - 1 AS pos, root || link AS dst FROM (SELECT regexp_replace(url, '#.*$', '') AS url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM (SELECT url, list_filter(list_transform(regexp_extract_all(html, '<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1), lambda x: replace(trim(x), '&amp;', '&')), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(javascript:|mailto:|tel:|#)')) AS l FROM pages)) WHERE starts_with(link, '/')"


@query(_LINKS)
def page_links(spark, sf_dir):
    """Resolved links on each page's own host."""
    own = _table(spark, sf_dir, "pages").select(text.url_normalised(F.col("url")).alias("url"), "html")
    return crawl.links_of(own).distinct().select("src", F.col("pos").cast("long").alias("pos"), "dst")


@query("SELECT url, min(doc_id) AS doc_id FROM (SELECT url, page_id AS doc_id FROM pages) GROUP BY url")
def doc_id_by_url(spark, sf_dir):
    return pages(spark, sf_dir).docs.groupBy("url").agg(F.min("doc_id").alias("doc_id"))


__all__ = ["ORACLES", "QUERIES", "boolean"]
