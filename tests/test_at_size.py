"""What must not grow beyond the input: how often texts are split, what is broadcast, what travels between tasks."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.operators import fuzzy, index, learned, retrieve
from textloom.sources import storage


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_split_once(spark, tmp_path):
    """Storing an index read and split all texts for each table, twice for sorted ones."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(t):
        seen.add(1)
        return t

    read = read.asNondeterministic()
    texts = spark.createDataFrame([(i, f"u{i}", "On top", f"the word{i} the end") for i in range(20)], "doc_id long, url string, title string, text string")
    built = index.build_index(texts.withColumn("text", read("text")))
    storage.save(built, str(tmp_path / "index"))
    assert seen.value == 20
    stored = storage.load(spark, str(tmp_path / "index"))
    for name in ("docs", "postings", "terms"):
        assert sorted(map(str, getattr(stored, name).collect())) == sorted(map(str, getattr(built, name).collect())), name
    m = stored.meta.first()
    assert (m["num_docs"], m["num_terms"], m["total_tokens"], m["mean_title"]) == (20, 24, 120, 2.0)
    assert retrieve.find(stored, "word3").first()["doc_id"] == 3


def test_runs_of_postings(monkeypatch):
    """Runs end between documents; rows of one doc_id, null too, have common postings; batches are cut anywhere."""
    monkeypatch.setattr(index, "RUN", 7)
    rng = random.Random(1)
    rows = sorted(((rng.choice([None, *range(12)]), [rng.choice("ab") for _ in range(rng.randrange(3))], [rng.choice("abcdé") for _ in range(rng.randrange(9))]) for _ in range(40)), key=lambda r: -1 if r[0] is None else r[0])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(["u"] * 40), pa.array([""] * 40), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["doc_id", "url", "title", "head", "body"])
    runs = [b.to_pylist() for b in index._inverted(iter([batch.slice(0, 13), batch.slice(13, 1), batch.slice(14, 0), batch.slice(14)]))]
    assert len(runs) > 5 and all([r["term"] for r in run if r["term"]] == sorted(r["term"] for r in run if r["term"]) for run in runs)
    want = {}
    for doc, head, body in rows:
        for pos, term in enumerate(head + body):
            want.setdefault((term, doc), []).append(pos)
    got = [((r["term"], r["doc_id"]), r["positions"]) for run in runs for r in run if r["term"]]
    assert len(got) == len(want) and dict(got) == {k: sorted(v) for k, v in want.items()}
    assert all(r["tf"] == len(r["positions"]) for run in runs for r in run if r["term"])
    assert sorted(r["tf"] for run in runs for r in run if r["term"] is None) == sorted(len(h) + len(b) for _, h, b in rows)


def test_dictionary_is_not_broadcast(spark):
    """The dictionary was, as its size is taken for that of the vocabulary, and the words asked for are of unknown size."""
    terms = spark.range(2000).select(F.concat(F.lit("word"), "id").alias("term"))
    found = fuzzy.symspell_lookup(fuzzy.build_symspell(terms, 2), spark.createDataFrame([("word77",), ("wrd9",), ("",)], "word string"), 2, 2)
    sent = plan_of(found).split("BroadcastExchange")
    assert len(sent) == 2 and "term#" not in sent[1] and "length(" in sent[0]
    got = {(r["word"], r["term"], r["distance"]) for r in found.collect()}
    assert ("word77", "word77", 0) in got and ("wrd9", "word9", 1) in got and ("word77", "word1", 2) in got
    assert fuzzy.symspell_lookup(fuzzy.build_symspell(terms, 2), spark.createDataFrame([], "word string"), 2, 2).count() == 0


def corpus(spark, n=60):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(12))) for _ in range(n)]
    built = index.build_index(spark.createDataFrame([(i, f"u{i:03d}", "", t) for i, t in enumerate(texts)], "doc_id long, url string, title string, text string"))
    log = [(q, p, t) for q, words in enumerate(["a b", "c", "a a j", "zz a", "zz"]) for p, t in enumerate(words.split())]
    return texts, built, spark.createDataFrame(log, "query_id long, qpos int, term string"), log


def test_only_postings_travel(spark):
    """Pairs of a query and a document, of which there are many times the input, were joined and grouped by exchanges."""
    texts, built, log, rows = corpus(spark)
    asked = spark.createDataFrame([(q,) for q in [0, 1, 2, 3, 4, 9]], "query_id long")
    dense = learned.features(built, log, asked=asked)
    assert "hashpartitioning(query_id" not in plan_of(dense)
    got = {(r["query_id"], r["doc_id"]): r for r in dense.collect()}
    assert set(got) == {(q, d) for q in [0, 1, 2, 3, 4, 9] for d in range(len(texts))}
    named = learned.features(built, log, spark.createDataFrame(list(got), "query_id long, doc_id long"))
    assert {(r["query_id"], r["doc_id"]): r for r in named.collect()} == got
    for (q, d), r in got.items():
        tokens = texts[d].split()
        words = [t for own, _, t in rows if own == q]
        assert r["freq_sum"] == sum(tokens.count(w) for w in words) and r["matched_terms"] == sum(w in tokens for w in words) and r["doc_length"] == len(tokens)
    found = retrieve.find_all(built, log, ["frequency", "bm25"], 5)
    assert "hashpartitioning(query_id" not in plan_of(found).replace("hashpartitioning(ranker", "")
    for q in range(5):
        words = {t for own, _, t in rows if own == q}
        whole = sorted((-got[q, d]["freq_sum"], d) for d, t in enumerate(texts) if words <= set(t.split()))[:5]
        assert [(r["score"], r["doc_id"]) for r in found.where(f"query_id = {q} AND ranker = 'frequency'").orderBy("rank").collect()] == [(-s, d) for s, d in whole]


def test_pieces_of_documents():
    """Documents are whole in a piece, wherever batches are cut."""
    ids = [5, 5, 5, 6, 7, 7, None, None, 9]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])
    for cut in range(10):
        for most in (1, 2, 9):
            pieces = list(retrieve.by_document(iter([batch.slice(0, cut), batch.slice(cut)]), most))
            assert [x for p, _ in pieces for x in p["doc_id"].to_pylist()] == ids
            for p, doc in pieces:
                own = p["doc_id"].to_pylist()
                assert doc[-1] + 1 == len(set(own)) <= most and np.array_equal(doc, np.unique(doc, return_inverse=True)[1])
            assert sum(len(set(p["doc_id"].to_pylist())) for p, _ in pieces) == 5


def test_norms_of_frequent_and_rare_words(spark, monkeypatch):
    """All postings were joined to the vocabulary by an exchange of them."""
    texts, built, _, _ = corpus(spark)
    monkeypatch.setattr(retrieve, "FREQUENT", 10)
    df = {t: sum(t in x.split() for x in texts) for t in "abcdefghij"}
    least = -(-sum(df.values()) // 10)
    assert {v >= least for v in df.values()} == {True, False}
    own = retrieve.norms(built)
    assert "LeftAnti" in plan_of(own)
    got = {r["doc_id"]: r["norm"] for r in own.collect()}
    weight = lambda words, t: (1 + np.log(words.count(t))) * (np.log(61 / (1 + df[t])) + 1)
    want = {d: np.sqrt(sum(weight(x.split(), t) ** 2 for t in set(x.split()))) for d, x in enumerate(texts) if x}
    assert set(got) == set(want) and all(abs(got[d] - want[d]) < 1e-9 for d in want)
