"""Rows without a doc_id, and null labels: no operator fails or loses them."""

import public_tokenizers as P

from textloom.llm import curve_packing, katz_backoff, piece_backtracking, pu_quality, repeat_automata, rule_forest, simhash_groups, token_files, weighted_fingerprints


def test_all(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, None), (3, "a b c d"), (4, "other words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, None), (4, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    byte, word, piece = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
    for size in (1 << 30, 10):
        found = [
            weighted_fingerprints.compare_with_next(docs, size), katz_backoff.score_corpus(docs, size), token_files.round_trip(docs, word, size), repeat_automata.remove_repeats(docs, 3, size),
            pu_quality.score(docs, pu_quality.fit(docs, labels)), rule_forest.judge(docs, rule_forest.fit(spark, docs, labels)), simhash_groups.group_documents(docs), piece_backtracking.encoded(docs, piece),
        ]
        for df in found:
            got = df.collect()
            assert sum(r["doc_id"] is None for r in got) == 3 and len(got) == 5
        pieces = curve_packing.pack(docs, byte, 4, size).collect()
        assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    groups = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_groups.group_documents(docs).collect()}
    assert groups[None, next(f for d, f in groups if d == 3)] == 3
    kept = [(r["doc_id"], r["text"]) for r in simhash_groups.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, None), (3, "a b c d"), (4, "other words stand here")], key=str)
