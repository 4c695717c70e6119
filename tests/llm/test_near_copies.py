"""The stage of near duplicates against brute force: one row of each group at a five-word Jaccard of 0.8 or more."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from textloom.llm import near_copies


def runs_of(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_force(rows: list[tuple]) -> set[int]:
    sets, up = {d: runs_of(t or "") for d, t in rows}, {d: d for d, _ in rows}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) * 5 >= 4 * len(x | y):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {top(d) for d in sets}


def sample() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for size in (5, 40, 60, 120, 300, 900):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for part in (0.005, 0.01, 0.02, 0.03, 0.05):  # from near 0.95 to well below 0.8
                texts.append(" ".join(word() if rng.random() < part else w for w in base))
            texts.append(" ".join(base[: int(size * 0.8) + 1]).upper())
    chain = [word() for _ in range(400)]
    texts += [" ".join(chain[15 * k : 15 * k + 200]) for k in range(10)]  # only neighbours are near
    texts += ["", None, " \n", "one two", "ONE  two", "one three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_keeps_one_of_each_group(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == kept_by_force(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_clusters_beyond_a_task(spark, monkeypatch):
    """The same rows, with clusters dealt out in blocks of three sets."""
    from pyspark.sql import functions as F

    rows = sample()
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, name string, n int, place int").repartition(3)
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and kept.agg(F.sum("n"), F.sum("place")).first()[0] == kept.count()
    assert {r["doc_id"] for r in kept.collect()} == kept_by_force(rows)


def test_exact_groups_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(40) < 0.09, rng.integers(0, 1 << 60, 40).astype(np.uint64), base)) for _ in range(30)]
        label = near_copies.exact_groups(np.repeat(np.arange(30), [len(s) for s in sets]), np.concatenate(sets))
        want = list(range(30))
        for i, j in combinations(range(30), 2):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
        assert label.tolist() == want


def test_fingerprints_link_by_themselves(spark, monkeypatch):
    """Without the MinHash keys, the stage still finds what SimHash fingerprints bring within its limit, and only that."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(900)]
        other = list(base)
        other[rng.randrange(len(base))] = "changed"
        texts += [" ".join(base), " ".join(other)]
    prints = [int(near_copies.vote(h, np.zeros(1, int))[0]) for h in (s[3] for t in texts for s in near_copies.shingles(pa.array([t])))]
    near = {i for i in range(0, 24, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= near_copies.NEAR_BITS}
    assert len(near) > 6

    def silent(batches):
        yield from (b.slice(0, 0).rename_columns(["a", "b"]) for b in batches)

    monkeypatch.setattr(near_copies, "_met", silent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(range(24)) - {i + 1 for i in near}


def test_links_by_fingerprints_against_all_pairs(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(150):
        x = rng.choice(prints)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    rows = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(prints)]
    found = near_copies.components(near_copies.by_prints(spark.createDataFrame(rows, "name long, fp long")))
    want = list(range(len(prints)))
    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3 and want[i] != want[j]:
            a, b = sorted((want[i], want[j]))
            want = [a if x == b else x for x in want]
    assert {r["node"]: r["root"] for r in found.collect()} == {k: x for k, x in enumerate(want) if want.count(x) > 1}
