"""SQL for a second engine (DuckDB), put together from common table expressions."""

from __future__ import annotations


def tokens(c: str) -> str:
    quotes = "'‘’“”', '''''\"\"'"
    return f"list_filter(regexp_split_to_array(replace(lower(translate(coalesce({c}, ''), {quotes})), '''', ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def _characters(c: str) -> str:
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{plain}')"
    return c


def html_title(c: str) -> str:
    return f"trim(regexp_replace({_characters(f'''regexp_extract({c}, '<title[^>]*>(.*?)</title\\s*>', 1, 'si')''')}, '\\s+', ' ', 'g'))"


def html_text(c: str) -> str:
    c = f"regexp_replace({c}, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "noscript"):
        c = f"regexp_replace({c}, '<{tag}\\b.*?</{tag}\\s*>', ' ', 'gsi')"
    c = _characters(f"regexp_replace({c}, '<[^>]*>', ' ', 'gs')")
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _corpus(rows: str) -> str:
    return f"""WITH split AS (SELECT doc_id, url, title, {tokens('title')} AS head, {tokens('text')} AS body FROM ({rows})),
docs AS (SELECT doc_id, url, title, len(head) + len(body) AS length, len(head) AS title_length, len(body) AS body_length FROM split),
each_token AS (SELECT doc_id, cut, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM (SELECT doc_id, len(head) AS cut, list_concat(head, body) AS toks FROM split)),
post AS (SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions, coalesce(list(pos ORDER BY pos) FILTER (pos < cut), []) AS title_positions, coalesce(list(pos - cut ORDER BY pos) FILTER (pos >= cut), []) AS body_positions FROM each_token GROUP BY term, doc_id),
facts AS (SELECT count(*) AS num_docs, avg(length) AS mean_length, avg(title_length) AS mean_title, avg(body_length) AS mean_body FROM docs)
"""


DOCS = _corpus("SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS url, '' AS title, text FROM documents")
PAGES = _corpus(f"SELECT page_id AS doc_id, url, {html_title('html')} AS title, {html_text('html')} AS text FROM pages")


def score(ranker: str, i: int | str) -> str:
    """A term's contribution from columns tf, df, title and body with a suffix."""
    tf, df = f"tf{i}", f"df{i}"
    idf = f"log10(1 + (num_docs - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE))"
    if ranker == "frequency":
        value = f"{tf}::DOUBLE"
    elif ranker == "tfidf":
        value = f"(1 + log10({tf}::DOUBLE)) * log10(1 + num_docs::DOUBLE / {df})"
    elif ranker == "bm25":
        value = f"{idf} * {tf} * 2.5::DOUBLE / ({tf} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / greatest(mean_length, 1.0::DOUBLE)))"
    else:
        w = f"(5.0::DOUBLE * (title{i} / 1.0::DOUBLE) + body{i} / greatest(0.25::DOUBLE + 0.75::DOUBLE * body_length / greatest(mean_body, 1.0::DOUBLE), 1e-9::DOUBLE))"
        value = f"{idf} * {w} * 2.5::DOUBLE / ({w} + 1.5::DOUBLE)"
    return f"(CASE WHEN coalesce({tf}, 0) <= 0 OR {df} <= 0 THEN 0.0::DOUBLE ELSE {value} END)"


def _wide(words: list[str]) -> str:
    per = ", ".join(f"max(CASE WHEN term = '{w}' THEN tf END) AS tf{i}, max(CASE WHEN term = '{w}' THEN len(title_positions) END) AS title{i}, max(CASE WHEN term = '{w}' THEN len(body_positions) END) AS body{i}, max(CASE WHEN term = '{w}' THEN positions END) AS at{i}" for i, w in enumerate(words))
    seen = ", ".join(f"count(*) FILTER (term = '{w}') AS df{i}" for i, w in enumerate(words))
    some = ", ".join(f"'{w}'" for w in words)
    return f"(SELECT doc_id, count(*) AS hits, {per} FROM post WHERE term IN ({some}) GROUP BY doc_id) found", f"(SELECT count(*) AS known, {seen} FROM post WHERE term IN ({some})) seen"


def find(asked: list[str], ranker: str, phrase: bool = False, top_k: int | None = None) -> str:
    own = list(dict.fromkeys(asked))
    found, seen = _wide(own)
    total = " + ".join(score(ranker, own.index(w)) for w in asked)
    where = f"hits = {len(own)}"
    if phrase:
        places = f"at{own.index(asked[0])}"
        for step, w in enumerate(asked[1:], 1):
            places = f"list_intersect({places}, list_transform(at{own.index(w)}, lambda p: p - {step}))"
        where += f" AND len({places}) > 0"
    out = f"SELECT doc_id, url, round({total}, 6) AS score, '{' '.join(asked)}' AS matched_terms FROM {found} JOIN docs USING (doc_id), facts, {seen} WHERE {where}"
    return out if top_k is None else f"SELECT * FROM ({out}) ORDER BY score DESC, url LIMIT {top_k}"


def boolean(words: list[str], condition: str, ranker: str) -> str:
    found, seen = _wide(words)
    for i, w in enumerate(words):
        condition = condition.replace(w, f"(tf{i} IS NOT NULL)")
    total = " + ".join(score(ranker, i) for i in range(len(words)))
    return f"SELECT doc_id, url, round({total}, 6) AS score, '{' '.join(words)}' AS matched_terms FROM docs LEFT JOIN {found} USING (doc_id), facts, {seen} WHERE known > 0 AND ({condition})"


def explain(asked: list[str], ranker: str) -> str:
    own = list(dict.fromkeys(asked))
    found, seen = _wide(own)
    total = " + ".join(score(ranker, own.index(w)) for w in asked)
    parts = " UNION ALL ".join(f"SELECT doc_id, score, '{w}' AS term, CAST(coalesce(tf{own.index(w)}, 0) AS INTEGER) AS tf, df{own.index(w)} AS df, round({score(ranker, own.index(w))}, 6) AS contribution FROM wide" for w in asked)
    return f", wide AS (SELECT *, round({total}, 6) AS score FROM {found} JOIN docs USING (doc_id), facts, {seen} WHERE hits = {len(own)}) {parts}"


def snippet(words: list[str], window: int, render: bool) -> str:
    some = ", ".join(f"'{w}'" for w in words)
    head = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos, len(toks) AS n FROM t),
s AS (SELECT doc_id, pos, n, sum(CASE WHEN tok IN ({some}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS hits FROM e),
b AS (SELECT doc_id, pos FROM s WHERE n > {window} AND pos <= n - {window} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) = 1),
w AS (SELECT t.doc_id, toks, CAST(coalesce(pos, 0) AS INTEGER) AS start FROM t LEFT JOIN b USING (doc_id))
"""
    if not render:
        return head + "SELECT doc_id, start FROM w"
    return head + f"SELECT doc_id, start, concat(CASE WHEN start > 0 THEN '... ' ELSE '' END, array_to_string(list_transform(toks[start + 1:start + {window}], lambda x: CASE WHEN x IN ({some}) THEN concat('**', x, '**') ELSE x END), ' '), CASE WHEN start + {window} < len(toks) THEN ' ...' ELSE '' END) AS snippet FROM w"


_S = {r: score(r, "") for r in ("frequency", "tfidf", "bm25")}
LOG = f""", log AS (SELECT item_id AS query_id, unnest(q) AS term, generate_subscripts(q, 1) - 1 AS qpos FROM (SELECT item_id, {tokens('text')} AS q FROM benchmark)),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS times FROM log GROUP BY ALL),
size AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
hits AS (SELECT query_id, doc_id, url, times, tf, df, length, num_docs, mean_length FROM asked JOIN terms USING (term) JOIN post USING (term) JOIN docs USING (doc_id), facts),
sums AS (SELECT query_id, doc_id, url, count(*) AS found, {', '.join(f'round(sum({e} * times), 6) AS {r}' for r, e in _S.items())} FROM hits GROUP BY ALL),
whole AS (SELECT sums.* FROM sums JOIN size USING (query_id) WHERE found = n),
long AS ({' UNION ALL '.join(f"SELECT '{r}' AS ranker, query_id, doc_id, url, {r} AS score FROM whole" for r in _S)}),
run AS (SELECT ranker, query_id, doc_id, url, score, row_number() OVER (PARTITION BY ranker, query_id ORDER BY score DESC, url) AS rank FROM long QUALIFY rank <= 10)
"""
METRICS = """, good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
judged AS (SELECT run.*, CASE WHEN good.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM run LEFT JOIN good ON run.doc_id = good.doc_id),
cum AS (SELECT *, sum(rel) OVER (PARTITION BY ranker, query_id ORDER BY rank) AS h FROM judged),
agg AS (SELECT ranker, query_id, sum(rel) FILTER (rank <= 5) AS h5, sum(rel) FILTER (rank <= 10) AS h10, min(rank) FILTER (rel = 1) AS first, sum(h::DOUBLE / rank) FILTER (rel = 1) AS precs FROM cum GROUP BY ALL),
scores AS (SELECT r.ranker, q.query_id, coalesce(h5 / 5.0::DOUBLE, 0) AS p_5, coalesce(h10 / 10.0::DOUBLE, 0) AS p_10, coalesce(h5::DOUBLE / nrel, 0) AS r_5, coalesce(h10::DOUBLE / nrel, 0) AS r_10, coalesce(1.0::DOUBLE / first, 0) AS rr, coalesce(precs / nrel, 0) AS ap
FROM (SELECT DISTINCT ranker FROM run) r CROSS JOIN (SELECT DISTINCT query_id FROM log) q LEFT JOIN agg ON agg.ranker = r.ranker AND agg.query_id = q.query_id, (SELECT count(*) AS nrel FROM good))
"""
_IDF = "log10(1 + (num_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
FEATURES = f""", mean AS (SELECT query_id, round(sum({_IDF} * times) / sum(times), 6) AS avg_query_idf FROM asked JOIN terms USING (term), facts GROUP BY query_id),
own AS (SELECT query_id, doc_id, round(sum({_S['bm25']} * times), 6) AS bm25_sum, round(sum({_S['tfidf']} * times), 6) AS tfidf_sum, sum(tf * times)::DOUBLE AS freq_sum, sum(times)::DOUBLE AS matched_terms FROM hits GROUP BY ALL)
SELECT query_id, doc_id, coalesce(bm25_sum, 0) AS bm25_sum, coalesce(tfidf_sum, 0) AS tfidf_sum, coalesce(freq_sum, 0) AS freq_sum, length::DOUBLE AS doc_length, coalesce(matched_terms, 0) AS matched_terms, coalesce(avg_query_idf, 0) AS avg_query_idf
FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) CROSS JOIN docs LEFT JOIN own USING (query_id, doc_id) LEFT JOIN mean USING (query_id)"""
_WEIGHT = "(1 + ln({n}::DOUBLE)) * (ln((1 + num_docs)::DOUBLE / (1 + df)) + 1)"
COSINE = f""", norms AS (SELECT doc_id, sqrt(sum(pow({_WEIGHT.format(n='tf')}, 2))) AS norm FROM post JOIN terms USING (term), facts GROUP BY doc_id),
weights AS (SELECT query_id, term, df, num_docs, {_WEIGHT.format(n='times')} AS w FROM asked JOIN terms USING (term), facts),
own AS (SELECT query_id, sqrt(sum(w * w)) AS own FROM weights GROUP BY query_id),
common AS (SELECT query_id, doc_id, sum(w * {_WEIGHT.format(n='tf')}) AS common FROM weights JOIN post USING (term) GROUP BY ALL),
near AS (SELECT query_id, doc_id, url, round(common / (own * norm), 6) AS score FROM common JOIN own USING (query_id) JOIN norms USING (doc_id) JOIN docs USING (doc_id)),
cosines AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM near WHERE score > 0 QUALIFY rank <= 10)
"""


def overlap(a: str, b: str) -> str:
    """Common share of two lists of (query_id, doc_id), by query of the log."""
    sides = f"SELECT query_id, doc_id, max(a) AS a, max(b) AS b FROM (SELECT query_id, doc_id, 1 AS a, 0 AS b FROM ({a}) UNION ALL SELECT query_id, doc_id, 0, 1 FROM ({b})) GROUP BY ALL"
    return f"SELECT query_id, round(CASE WHEN na IS NULL THEN 1.0::DOUBLE ELSE both_::DOUBLE / greatest(na, nb) END, 6) AS overlap FROM (SELECT DISTINCT query_id FROM log) LEFT JOIN (SELECT query_id, sum(a) AS na, sum(b) AS nb, sum(a * b) AS both_ FROM ({sides}) GROUP BY query_id) USING (query_id)"


TURNS = _corpus("SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS doc_id, CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS url, role AS title, text FROM conversations")
