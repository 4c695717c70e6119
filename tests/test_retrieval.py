import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import codecs, text
from textloom.functions.rankers import bm25
from textloom.operators import boolean, fuzzy, learned, ranking, retrieve, snippets
from textloom.operators.index import build_index, print_term, reconstruct_tokens
from textloom.sources import crawl, fetch, storage


def index_of(spark, texts, titles=None):
    rows = [(i, f"https://x.com/p{i}", titles[i] if titles else "", t) for i, t in enumerate(texts)]
    return build_index(spark.createDataFrame(rows, "doc_id long, url string, title string, text string"))


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_tokens(spark):
    cases = {"It's a truth, universally acknowledged.": "its a truth universally acknowledged", "don’t": "dont", "hello-world": "hello world", "café": "café", "good — friends": "good friends", "1984": "1984", "": "", "a_b": "a_b"}
    got = spark.createDataFrame(list(cases.items()), "t string, e string").select(F.array_join(text.tokens("t"), " ").alias("g"), "e").collect()
    assert all(r["g"] == r["e"] for r in got)
    assert all(" ".join(boolean.words(t)) == e for t, e in cases.items())


def test_index_counts(spark):
    index = index_of(spark, ["the cat sat on the mat", "foo foo bar", None])
    rows = {(r["term"], r["doc_id"]): r for r in index.postings.collect()}
    assert rows["the", 0]["tf"] == 2 and rows["the", 0]["positions"] == [0, 4]
    terms = {r["term"]: (r["df"], r["cf"]) for r in index.terms.collect()}
    assert terms["foo"] == (1, 2)
    m = index.meta.first()
    assert (m["num_docs"], m["total_tokens"], m["num_terms"]) == (3, 9, 7)
    assert {r["doc_id"]: r["tokens"] for r in reconstruct_tokens(index.postings).collect()}[1] == ["foo", "foo", "bar"]


def test_empty_index(spark):
    index = index_of(spark, ["x"])
    none = build_index(spark.createDataFrame([], "doc_id long, url string, title string, text string"))
    m = none.meta.first()
    assert (m["num_docs"], m["num_terms"], m["total_tokens"], m["mean_length"]) == (0, 0, 0, 0.0)
    assert ids(retrieve.find(none, "x")) == [] and ids(retrieve.find(index, "!!")) == [] and ids(retrieve.find(index, "")) == []


def test_title_positions(spark):
    index = index_of(spark, ["hello world"], ["Greeting"])
    r = index.postings.where("term = 'world'").first()
    assert (r["positions"], r["title_positions"], r["body_positions"]) == ([2], [], [1])
    assert index.docs.first()["length"] == 3
    assert ids(retrieve.find(index, "greeting hello", mode="phrase")) == [0]


def test_and_ranking_ties(spark):
    index = index_of(spark, ["good day", "good news", "happy days", "good day"])
    assert ids(retrieve.find(index, "good day")) == [0, 3]
    assert ids(retrieve.find(index, "good zzz")) == []
    assert ids(retrieve.find(index_of(spark, ["foo bar", "foo foo bar", "baz qux"]), "foo")) == [1, 0]
    assert ids(retrieve.find(index, "good", top_k=2)) == [0, 1]


def test_phrase(spark):
    index = index_of(spark, ["good morning friends", "good day for old friends", "foo foo bar", "foo bar foo"])
    assert ids(retrieve.find(index, "good friends", mode="phrase")) == []
    assert ids(retrieve.find(index, "foo foo", mode="phrase")) == [2]


def test_explain_and_bm25(spark):
    r = retrieve.find(index_of(spark, ["foo foo bar"]), "foo", explain=True).first()
    assert (r["breakdown"][0]["tf"], r["breakdown"][0]["df"]) == (2, 1)
    assert abs(r["score"] - sum(b["contribution"] for b in r["breakdown"])) < 1e-5
    from textloom.functions.rankers import Stats

    s = Stats(F.lit(2), F.lit(3), F.lit(10), F.lit(100), F.lit(100.0))
    assert abs(spark.range(1).select(bm25()(s)).first()[0] - math.log10(1 + 7.5 / 3.5) * 5 / 3.5) < 1e-9
    with pytest.raises(ValueError):
        bm25(b=2)


def test_bm25f_prefers_titles(spark):
    index = index_of(spark, ["word here now", "other thing word"], ["plain", "word"])
    assert ids(retrieve.find(index, "word", ranker="bm25f"))[0] == 1


@pytest.mark.parametrize(("query", "expected"), [("a", [0, 1]), ("a AND b", [0]), ("a OR b", [0, 1, 2]), ("NOT a", [2, 3]), ("(a OR b) AND NOT c", [0]), ("a AND zzz", []), ("a OR zzz", [0, 1]), ("NOT zzz", []), ("a and b", [0])])
def test_boolean(spark, query, expected):
    index = index_of(spark, ["a b", "a c", "b c", "d"])
    assert sorted(ids(retrieve.find(index, query))) == expected


def test_boolean_grammar():
    assert not boolean.has_operators("Bandwidth") and boolean.has_operators("apple AND") and boolean.has_operators("(x")
    for bad in ("(a OR b", "a AND", "", "to be", "a)"):
        with pytest.raises(boolean.ParseError):
            boolean.parse(bad)
    assert boolean.parse("a OR b AND NOT c") == boolean.Or(boolean.Term("a"), boolean.And(boolean.Term("b"), boolean.Not(boolean.Term("c"))))


def test_fuzzy(spark):
    terms = index_of(spark, ["cat bat car"]).terms
    assert [r["term"] for r in fuzzy.suggest(terms, "rat").collect()] == ["bat", "cat", "car"]
    assert fuzzy.suggest(terms, "cat").collect() == []
    with pytest.raises(ValueError):
        fuzzy.symspell_lookup(fuzzy.build_symspell(terms, 1), terms, 3, 1)


def test_symspell_equals_scan(spark):
    terms = index_of(spark, ["apple apply amber ample ripple é a"]).terms
    words = ["aplle", "appl", "ample", "xyz", "e"]
    got = {(r["word"], r["term"]) for r in fuzzy.symspell_lookup(fuzzy.build_symspell(terms, 2), spark.createDataFrame([(w,) for w in words], "word string"), 2, 2).collect()}
    for w in words:
        near = {r["term"] for r in terms.where(F.levenshtein("term", F.lit(w)) <= 2).collect()}
        assert {t for x, t in got if x == w} == near


def test_autocomplete(spark):
    terms = spark.createDataFrame([("cab", 1, 1), ("car", 1, 5), ("cat", 1, 5), ("card", 1, 2)], "term string, df long, cf long")
    assert [r["term"] for r in fuzzy.autocomplete(terms, "ca").collect()] == ["car", "cat", "card", "cab"]
    assert fuzzy.autocomplete(terms, "").collect() == [] and fuzzy.autocomplete(terms, "ca", 0).collect() == []


def test_snippets(spark):
    rows = [(0, ["foo", "bar"]), (1, ["x"] * 20 + ["alpha", "beta", "alpha", "beta", "alpha"] + ["y"] * 20), (2, [])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    assert snippets.snippets(docs, ["foo"], 10).first()["snippet"] == "**foo** bar"
    one = [r for r in snippets.snippets(docs, ["alpha", "beta"], 5).collect() if r["doc_id"] == 1][0]
    assert one["snippet"].count("**") == 10 and one["snippet"].startswith("... ") and one["snippet"].endswith(" ...")


def test_fusion_and_metrics(spark):
    run = lambda urls: spark.createDataFrame([(u, u, i + 1) for i, u in enumerate(urls)], "url string, title string, rank int")
    got = [(r["url"], r["score"]) for r in ranking.fuse([run(["u1", "u2"]), run(["u1", "u3"])]).collect()]
    assert got == [("u1", round(2 / 61, 6)), ("u2", round(1 / 62, 6)), ("u3", round(1 / 62, 6))]
    with pytest.raises(ValueError):
        ranking.fuse([run(["a"])], 0)
    found = spark.createDataFrame([("r", 1, x, i + 1) for i, x in enumerate("abcde")], "ranker string, query_id int, doc_id string, rank int")
    rels = spark.createDataFrame([(1, "a"), (1, "c"), (2, "z")], "query_id int, doc_id string")
    m = {r["query_id"]: r for r in ranking.metrics(found, rels, rels).collect()}
    assert abs(m[1]["ap"] - 5 / 6) < 1e-9 and m[1]["p_5"] == 0.4 and m[1]["rr"] == 1 and m[2]["ap"] == 0


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ranking.dense_top(v, [0.0, 3.0], 2).collect()] == [(1, 1.0), (0, 0.0)]


def test_codes(spark):
    for n, b in ((0, "00"), (127, "7f"), (128, "8001"), (16383, "ff7f")):
        assert codecs.encode_varint(n).hex() == b
    with pytest.raises(ValueError):
        codecs.encode_varint(-1)
    with pytest.raises(EOFError):
        codecs.decode_varint(b"\x80")
    named = {"a\tb": [1, 300], "": []}
    assert codecs.decode_named_blocks(codecs.encode_named_blocks(named)) == named
    with pytest.raises(ValueError):
        codecs.decode_named_blocks(b"nope")
    df = spark.createDataFrame([([313, 322, 331, 341, 350],), ([],)], "v array<int>")
    got = [r[0] for r in df.select(codecs.delta_encoded(F.col("v"))).collect()]
    assert got == [[313, 9, 9, 10, 9], []]
    assert [r[0] for r in df.select(codecs.delta_decoded(codecs.delta_encoded(F.col("v")))).collect()] == [[313, 322, 331, 341, 350], []]


@given(st.integers(0, 2**40))
@settings(max_examples=40, deadline=None)
def test_varint_round_trip(n):
    assert codecs.decode_varint(codecs.encode_varint(n)) == (n, len(codecs.encode_varint(n)))


def test_storage(spark, tmp_path):
    index = index_of(spark, ["hello world", "hello again"])
    storage.save(index, str(tmp_path / "i"))
    back = storage.load(spark, str(tmp_path / "i"))
    assert sorted(map(str, back.postings.collect())) == sorted(map(str, index.postings.collect()))
    with pytest.raises(storage.StorageError):
        storage.load(spark, str(tmp_path / "none"))
    (tmp_path / "old.json").write_text('{"meta": {"version": "1.1"}, "docs": {"0": {"url": "u", "title": "", "length": 3}}, "terms": {"a": {"df": 1, "cf": 2, "postings": {"0": {"tf": 2, "positions": [1, 4]}}}}}')
    assert storage.load_json(spark, str(tmp_path / "old.json")).postings.first()["positions"] == [1, 5]
    (tmp_path / "bad.json").write_text("[1, 2]")
    with pytest.raises(storage.StorageError):
        storage.load_json(spark, str(tmp_path / "bad.json"))
    (tmp_path / "new.json").write_text('{"meta": {"version": "999.0"}}')
    with pytest.raises(storage.IndexVersionError):
        storage.load_json(spark, str(tmp_path / "new.json"))


def test_crawl(spark):
    page = lambda body, *links: f"<html><head><title>T</title></head><body>{body}{''.join(f'<a href=\"{x}\">l</a>' for x in links)}</body></html>"
    rows = [("https://h.x/", page("root", "/a", "b#frag", "mailto:x@y", "https://other.y/z")), ("https://h.x/a", page("same", "/c")), ("https://h.x/b", page("same", "/d")), ("https://h.x/c", page("c", "/")), ("https://h.x/d", page("d"))]
    got = crawl.crawl(spark.createDataFrame(rows, "url string, html string"), "https://h.x/")
    assert [r["url"] for r in got.collect()] == ["https://h.x/", "https://h.x/a", "https://h.x/c", "https://h.x/d"]
    with pytest.raises(crawl.CrawlError):
        crawl.crawl(spark.createDataFrame(rows, "url string, html string"), "nohost")


def test_fetcher():
    calls, naps = [], []
    site = {"https://h.x/robots.txt": "User-agent: *\nDisallow: /private", "https://h.x/": '<a href="/a">1</a><a href="/private/b">2</a><a href="#x">3</a>', "https://h.x/a": '<a href="/">back</a>'}

    def ask(url):
        calls.append(url)
        if url == "https://h.x/a" and calls.count(url) == 1:
            return 503, ""
        return (200, site[url]) if url in site else (404, "")

    f = fetch.Fetcher(delay=6, ask=ask, sleep=naps.append, clock=lambda: 0.0)
    assert [u for u, _ in f.walk("https://h.x/")] == ["https://h.x/", "https://h.x/a"]
    assert calls.count("https://h.x/a") == 2 and 6 in naps
    with pytest.raises(ValueError):
        fetch.Fetcher(retries=0)


def test_fetcher_counts_texts():
    alias = '<script>{}</script><p>same</p><a href="{}">next</a>'
    site = {"https://h.x/": '<a href="/a">1</a><a href="/b">2</a>', "https://h.x/a": alias.format(1, "/c"), "https://h.x/b": alias.format(2, "/d"), "https://h.x/c": "c", "https://h.x/d": "d"}
    f = fetch.Fetcher(delay=0, retries=1, ask=lambda u: (200, site[u]) if u in site else (404, ""))
    assert [u[-1] for u, _ in f.walk("https://h.x/", 3)] == ["/", "a", "b", "c"]
    assert len(f.walk("https://h.x/")) == 5


def test_learned(spark):
    index = index_of(spark, ["alpha beta", "zeta"])
    log = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "unknown")], "query_id long, qpos int, term string")
    rows = {r["doc_id"]: r for r in learned.features(index, log, spark.createDataFrame([(1, 0), (1, 1), (1, 99)], "query_id long, doc_id long")).collect()}
    assert rows[0]["freq_sum"] == 1 and rows[1]["freq_sum"] == 0 and rows[1]["avg_query_idf"] > 0
    assert all(rows[99][f] == 0 for f in learned.FEATURES)


def test_shell(spark, tmp_path):
    from textloom.cli import Shell

    rows = [(i, f"https://x.com/p{i}", f"<title></title><p>{t}</p>") for i, t in enumerate(["hello world", "hello again friends", "goodbye friends"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    said: list[str] = []
    Shell(spark, said.append).run([f"build {tmp_path}/pages {tmp_path}/index", "print hello", "find hello friends --explain --snippet", "find helo", "find don't", "suggest he", "nope", "exit", "print never"])
    text_ = "\n".join(said)
    assert "3 documents" in text_ and "hello: df=2" in text_ and "**hello** again **friends**" in text_ and "did you mean: hello" in text_ and "parse error" in text_ and "unknown command" in text_ and "never" not in text_


def test_shell_builds_a_site(spark, tmp_path):
    from textloom.cli import Shell

    pages = {f"https://h.x/p{i}": f"<title>P{i}</title><p>word number{i}</p>" for i in range(30)}
    site = {"https://h.x/": "".join(f'<a href="/p{i}">l</a>' for i in range(30)) + '<a href="/copy">c</a>', "https://h.x/copy": pages["https://h.x/p3"], **pages}
    said: list[str] = []
    shell = Shell(spark, said.append, fetcher=fetch.Fetcher(delay=0, retries=1, ask=lambda u: (200, site[u]) if u in site else (404, "")))
    shell.run([f"build https://h.x/ {tmp_path}/site", "find word", 'suggest "don\'t"', "suggest NUMBER2", "suggest --", f"build nohost {tmp_path}/none"])
    text_ = "\n".join(said)
    assert "fetched 32 pages" in text_ and "31 documents" in text_ and "30. " in text_ and "31. " not in text_
    assert "no terms begin with 'dont'" in text_ and "number2 (" in text_ and "empty prefix" in text_ and "error" in text_


def test_broken_save_leaves_the_old_index(spark, tmp_path):
    path = str(tmp_path / "i")
    storage.save(index_of(spark, ["old words"]), path)
    new = index_of(spark, ["new words"])
    new.meta = new.meta.where("assert_true(false) is null")  # the last table fails
    with pytest.raises(Exception):
        storage.save(new, path)
    assert {r["term"] for r in storage.load(spark, path).postings.collect()} == {"old", "words"}
    storage.save(index_of(spark, ["newer"]), path)
    assert {r["term"] for r in storage.load(spark, path).postings.collect()} == {"newer"}
    assert len([x for x in (tmp_path / "i").iterdir() if x.name.startswith("generation")]) == 1


def test_find_reads_a_stored_index(spark, tmp_path):
    from textloom.sources import stored

    texts = ["alpha beta", "beta gamma", "alpha"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    built = []

    def build():
        built.append(1)
        return index_of(spark, texts)

    for _ in range(2):
        found = retrieve.find(stored.index(spark, "t", build, str(tmp_path / "documents.parquet")), "alpha beta")
        assert [r["doc_id"] for r in found.collect()] == [0]
    assert len(built) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [alpha,beta])" in plan and "explode" not in plan.lower() and "Generate" not in plan
    spark.createDataFrame([(9, "other")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    stored.index(spark, "t", build, str(tmp_path / "documents.parquet"))
    assert len(built) == 2  # other files, another index


def test_snippets_and_codes_are_linear_and_equal_brute_force(spark):
    import random
    import time

    r = random.Random(1)
    docs = [[r.choice("abcd") for _ in range(r.randint(0, 60))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>")
    for window in (1, 7, 20):
        got = {x["doc_id"]: x["start"] for x in snippets.snippets(df, ["a", "b"], window).collect()}
        for i, d in enumerate(docs):
            hits = [sum(t in "ab" for t in d[s : s + window]) for s in range(max(1, len(d) - window + 1))]
            assert got[i] == (0 if len(d) <= window else hits.index(max(hits)))
    long = spark.createDataFrame([(0, ["a", "x"] * 100_000)], "doc_id long, tokens array<string>")
    deltas = spark.createDataFrame([(list(range(1, 400_001)),)], "v array<int>")
    start = time.time()
    assert snippets.snippets(long, ["a"], 20).first()["start"] == 0
    assert deltas.select(codecs.delta_decoded(codecs.delta_encoded(F.col("v"))).alias("d")).first()["d"][-1] == 400_000
    assert time.time() - start < 20
    lists = [[], [0], [127, 128, 2**40, 5], None, [2**62], list(range(300))]
    own = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, v array<long>").coalesce(1)
    codes = {x["i"]: x["c"] for x in own.select("i", codecs.block_encoded("v").alias("c")).collect()}
    assert [codes[i] and bytes(codes[i]) for i in range(len(lists))] == [None if x is None else codecs.encode_block(x) for x in lists]
    back = {x["i"]: x["v"] for x in own.select("i", codecs.block_decoded(codecs.block_encoded("v")).alias("v")).collect()}
    assert [back[i] for i in range(len(lists))] == lists
    with pytest.raises(Exception):
        spark.createDataFrame([(bytearray(b"\x03\x01"),)], "c binary").select(codecs.block_decoded("c")).collect()


def test_stream(spark, tmp_path):
    from textloom.streaming import append_postings, appended

    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "doc_id long, url string, title string, text string"
    with pytest.raises(storage.StorageError):
        appended(spark, out)
    pages = [(1, "u", "", "a b a"), (2, "v", "B", "c"), (3, "w", None, None)]
    for part in (pages[:1], pages[1:]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(into)
        append_postings(spark.readStream.schema(kind).parquet(into), out, str(tmp_path / "mark")).awaitTermination(60)
    (tmp_path / "out" / "postings" / "batch=9").mkdir()  # one that broke off
    found, whole = appended(spark, out), build_index(spark.createDataFrame(pages, kind))
    for name in ("docs", "postings", "terms", "facts"):
        rows = [sorted(map(str, getattr(x, name).select(getattr(whole, name).columns).collect())) for x in (found, whole)]
        assert rows[0] == rows[1]
    storage.save(found, str(tmp_path / "saved"))
    back = storage.load(spark, str(tmp_path / "saved"))
    assert sorted(ids(retrieve.find(back, "b"))) == [1, 2]


def test_print_term(spark):
    rows = print_term(index_of(spark, ["a b", "b"]), "B!").orderBy("url").collect()
    assert [(r["url"], r["df"], r["cf"]) for r in rows] == [("https://x.com/p0", 2, 2), ("https://x.com/p1", 2, 2)]


def test_entry_has_sql_for_its_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_older_form(spark, tmp_path):
    index = index_of(spark, ["hello world hello", "hello again", None], ["Greeting", "hello", ""])
    path = str(tmp_path / "deep" / "index.json")
    for compress in (True, False):
        storage.save_json(index, path, compress=compress)
        back = storage.load_json(spark, path)
        text_rows = lambda df, *c: sorted(map(str, df.select(F.col("doc_id").cast("string").alias("doc_id"), *c).collect()))
        assert text_rows(back.postings, "term", "tf", *storage.LISTS) == text_rows(index.postings, "term", "tf", *storage.LISTS)
        assert text_rows(back.docs, "url", "title", "length", "title_length", "body_length") == text_rows(index.docs, "url", "title", "length", "title_length", "body_length")
        assert sorted(map(str, back.terms.collect())) == sorted(map(str, index.terms.collect()))
        assert sorted(x.name for x in (tmp_path / "deep").iterdir()) == ["index.json"] + ["index.json.postings.bin"] * compress
    storage.save_json(index, path, compress=True)
    (tmp_path / "deep" / "index.json.postings.bin").write_bytes(codecs.encode_named_blocks({"zzz\t0\tpositions": [1]}))
    with pytest.raises(storage.StorageError):
        storage.load_json(spark, path)
    (tmp_path / "deep" / "index.json.postings.bin").unlink()
    with pytest.raises(storage.StorageError):
        storage.load_json(spark, path)
    from textloom.cli import Shell

    storage.save_json(index, path)
    said: list[str] = []
    Shell(spark, said.append).run([f"load {path}", "find again"])
    assert said[0] == "3 documents, 4 terms" and said[1].startswith("1. https://x.com/p1")
    none = index_of(spark, ["x"])
    none.postings, none.terms, none.docs = none.postings.limit(0), none.terms.limit(0), none.docs.limit(0)
    storage.save_json(none, path)
    assert storage.load_json(spark, path).postings.count() == 0


def test_indexes_without_fields(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"meta": {"version": "1.0"}, "docs": {"0": {"url": "u", "title": "A b", "length": 3}, "1": {"url": "v", "title": "", "length": 9}}, "terms": {"a": {"df": 2, "cf": 3, "postings": {"0": {"tf": 2, "positions": [0, 2]}, "1": {"tf": 1, "positions": [4]}}}}}')
    old = storage.load_json(spark, str(tmp_path / "old.json"))
    scores = [{r["url"]: r["score"] for r in retrieve.find(old, "a", ranker=r).collect()} for r in ("bm25", "bm25f")]
    assert scores[0] == scores[1] and min(scores[0].values()) > 0
    new = storage.migrate(old)
    assert {r["doc_id"]: (r["title_positions"], r["body_positions"]) for r in new.postings.collect()} == {"0": ([0], [0]), "1": ([], [4])}
    assert {r["doc_id"]: (r["title_length"], r["body_length"]) for r in new.docs.collect()} == {"0": (2, 1), "1": (0, 9)}
    assert new.meta.first()["version"] == "1.2"


def test_markup_references_and_links(spark):
    pages = [("https://h.x/a/b/c?q", '<title>A &amp;lt; &eacute;&#233;&#xE9; &nope; &#0; x&y</title><A class="c" HREF=\'../d/./e?x=../y\'>1</A><a data-href="no" href=f&amp;g>2</a><a href="../../../z/..">3</a><a href="./">4</a>')]
    r = spark.createDataFrame(pages, "url string, html string").select(text.html_title(F.col("html")).alias("t"), text.html_links(F.col("html")).alias("l"), F.transform(text.html_links(F.col("html")), lambda x: text.url_resolved(x, F.col("url"))).alias("r")).first()
    assert r["t"] == "A &lt; ééé &nope; &#0; x&y"
    assert r["l"] == ["../d/./e?x=../y", "f&g", "../../../z/..", "./"]
    assert r["r"] == ["https://h.x/a/d/e?x=../y", "https://h.x/a/b/f&g", "https://h.x/", "https://h.x/a/b/"]


def test_encoded_documents(spark, tmp_path):
    from textloom.operators import dense

    def encoder(texts):
        return [[t.lower().count(w) * 2.0 for w in ("cat", "dog", "fish")] for t in texts]

    index = index_of(spark, ["purr", "bark", None, "none"], ["Cats", "Dogs", "Fish", ""])
    vectors = dense.from_index(index, encoder)
    dense.save(vectors, str(tmp_path / "v"), "counts")
    back, model = dense.load(spark, str(tmp_path / "v"))
    assert model == "counts" and {r["doc_id"]: list(r["embedding"]) for r in back.collect()} == {0: [1, 0, 0], 1: [0, 1, 0], 2: [0, 0, 1], 3: [0, 0, 0]}
    rows = dense.rank(index, back, "Cats query", encoder, 2).collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(0, 1.0), (1, 0.0)] and rows[0]["matched_terms"] == []
    assert dense.rank(index, back, "  ", encoder).collect() == []
    with pytest.raises(storage.StorageError):
        dense.load(spark, str(tmp_path / "nothing"))


def test_cosine(spark):
    texts = ["a b b c", "a a a", "d", "", "b d"]
    index = index_of(spark, texts)
    log = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "zzz"), (2, 0, "zzz")], "query_id long, qpos int, term string")
    split = [t.split() for t in texts]
    rare = {w: math.log((1 + len(texts)) / (1 + sum(w in s for s in split))) + 1 for w in "abcd"}
    vector = lambda ws: {w: (1 + math.log(ws.count(w))) * rare[w] for w in ws if w in rare}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = vector(["a", "b", "a"])
    expected = {i: round(sum(q[w] * v.get(w, 0) for w in q) / size(q) / size(v), 6) for i, v in enumerate(map(vector, split)) if v}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieve.cosine_all(index, log).collect()}
    assert got == {(1, i): s for i, s in expected.items() if s > 0}


def test_cross_validation(spark):
    rows = spark.createDataFrame([(q, d, float(d), 0.0, 0.0, 1.0, 1.0, 0.5, float(d > 2)) for q in range(3) for d in range(6)], "query_id long, doc_id long, bm25_sum double, tfidf_sum double, freq_sum double, doc_length double, matched_terms double, avg_query_idf double, grade double")
    got = learned.cross_validated(rows, F.col("query_id"), rounds=2).collect()
    assert len(got) == 18 and all((r["rank"] <= 3) == (r["doc_id"] > 2) for r in got)
    assert {r["score"] for r in learned.cross_validated(rows, F.lit(1), rounds=2).collect()} == {0.0}
    a, b = (spark.createDataFrame(list(enumerate(x)), "query_id int, ap double") for x in ([1.0, 0.5, 0.2], [0.5, 0.5, 0.4]))
    assert tuple(ranking.wins(a, b).first())[:2] == (3, 1)
