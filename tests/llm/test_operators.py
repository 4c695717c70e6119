import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash

from textloom.sources import shared
from textloom.llm import (
    components, curve_packing, dom_marginals, katz_backoff, labelled_pages, packed, piece_backtracking, pu_quality, repeat_automata, rule_forest, simhash_groups, subwords, tables, token_files, weighted_fingerprints as wf, wordscan,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(4)
LONG = " ".join("".join(R.choice("abcdé") for _ in range(R.randint(1, 6))) for _ in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [None, "", " \t\n ", "a", "A b", LONG, "x " + PASSAGE + " y", "z\n" + PASSAGE, "x " + PASSAGE + " y", "same line\nsame line\n\nother", "Of " * 50, "日本 🎉 <|endoftext|> ▁ ok", "it's 1984 don’t stop  two", "Tie one", "Tie one"]
ROWS = [(i * 3, t, "en", f"c{i}", i, i, i, i) for i, t in enumerate(TEXTS)] + [(39, "Tie one", "en", "c", 1, 1, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, a repeated row, and columns with names that operators use."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, score string, n_words int, bucket int, fp int, shard int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def plain():
    return [(r[0], r[1] or "") for r in ROWS]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# words and packing of numbers


def test_words_and_grams():
    texts = [t or "" for t in TEXTS[:5] + TEXTS[6:]]
    data, bounds = wordscan.buffers(pa.array(texts))
    w = wordscan.scan(data, bounds)
    raw = data.tobytes()
    assert [[raw[a:b].decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])] for i in range(len(texts))] == [WORD.findall(t) for t in texts]
    names, h = [x for t in texts for x in WORD.findall(t)], w.hashes()
    assert len(set(h.tolist())) == len(set(names))
    g, at = wordscan.grams(h, w, 3, short=True)
    spans = [tuple(x[i : i + 3]) for t in texts for x in [WORD.findall(t)] for i in (range(max(1, len(x) - 2)) if x else [])]
    assert len(g) == len(spans) and len(set(g.tolist())) == len(set(spans))


def test_packed():
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 999).astype(np.uint64))
    back = packed.unpack(packed.pack(h, np.arange(999), np.linspace(0, 1, 999)))
    assert (back[0] == h).all() and (back[1] == np.arange(999)).all() and np.allclose(back[2].view(np.float64), np.linspace(0, 1, 999))
    assert len(packed.unpack(packed.pack(h[:0]))[0]) == 0


# 1


def test_fingerprint_collisions_equal_jaccard():
    rng = np.random.default_rng(0)
    gap = []
    for _ in range(60):
        k = rng.integers(1, 2**62, 200).astype(np.uint64)
        x = rng.integers(0, 4, 200)
        y = np.where(rng.random(200) < 0.7, x, rng.integers(0, 4, 200))
        a, b = (wf.signatures(np.zeros(w.sum(), int), np.repeat(k, w), 1)[0] for w in (x, y))
        gap.append((a == b).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(gap)) < 0.02 and np.std(gap) < 0.07


def test_compare_with_next(docs, none):
    for size in (1 << 30, 2000):
        got = sorted(wf.compare_with_next(docs, size).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
        rows = sorted(plain())
        assert len(got) == len(rows)
        for r, (i, (d, x)) in zip(got, enumerate(rows), strict=True):
            y = rows[(i + 1) % len(rows)][1]
            cut = len(x) // 4
            assert (r["doc_id"], r["n_chars"]) == (d, len(x))
            assert r["edited_sha256"] == hashlib.sha256((x[: len(x) - cut] + y[:cut]).encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    # likenesses are those of the texts' weighted sets of five-word runs, but for the error of 128 slots
    def weights(x):
        w = WORD.findall(x)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    def jaccard(x, y):
        a, b = weights(x), weights(y)
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    rng = random.Random(7)
    base = [f"w{rng.randrange(40)}" for _ in range(400)]  # runs repeat now and then
    some = [" ".join(w if rng.random() > 0.01 * i else f"x{rng.random()}" for w in base) for i in range(40)]
    got2 = sorted(wf.compare_with_next(docs.sparkSession.createDataFrame(list(enumerate(some)), "doc_id long, text string"), 5000).collect())
    off = []
    for r, x, y in zip(got2, some, some[1:] + some[:1], strict=True):
        off += [r["near_next"] - jaccard(x, y), r["near_edited"] - jaccard(x, x[: len(x) - len(x) // 4] + y[: len(x) // 4])]
    assert abs(np.mean(off)) < 0.02 and max(map(abs, off)) < 0.2, off
    by = {}
    for r in got:
        by.setdefault(dict(rows).get(r["doc_id"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert wf.compare_with_next(none).collect() == []


# 2


def plain_discounts(count):
    """Katz's ratios by the formula, for counts 1 to 5; Ney's absolute discount where they don't serve; what 5 loses, for more."""
    n = [0] + [sum(1 for x in count.values() if x == r) for r in range(1, 7)]
    cut = min(max(n[1] / (n[1] + 2 * n[2]), 0.05), 0.95) if n[1] and n[2] else 0.5
    out = [0.0] * 7
    for r in range(1, 6):
        ratio = None
        if n[r] and n[1] and 6 * n[6] != n[1]:
            big = 6 * n[6] / n[1]
            ratio = ((r + 1) * n[r + 1] / (r * n[r]) - big) / (1 - big)
        out[r] = ratio * r if ratio is not None and 0 < ratio < 1 else r - cut
    out[6] = 5 - out[5]
    return out


def test_discounts_by_the_formula():
    rng = random.Random(3)
    for spread in (1.1, 1.5, 2.5, 4.0):
        count = Counter({i: int(rng.paretovariate(spread)) for i in range(3000)})
        got = katz_backoff.discounts(katz_backoff.of_counts(np.array(list(count.values()))))
        assert np.allclose(got, plain_discounts(count))
    assert np.allclose(katz_backoff.discounts(np.zeros(6)), plain_discounts({}))
    assert np.allclose(katz_backoff.discounts(np.array([4, 0, 1, 0, 0, 9])), plain_discounts(dict(enumerate([1] * 4 + [3] + [6] * 9))))


def katz(rows):
    toks = [WORD.findall(lower(x)) + ["</s>"] for _, x in rows]
    out = [zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c, b = Counter(), Counter()
    for w, o in zip(toks, out):
        if not o:
            c.update(w)
            b.update(zip(["<s>"] + w[:-1], w))
    n, v = sum(c.values()), len(c)
    d1, d2 = plain_discounts(c), plain_discounts(b)
    cut = lambda r, d: r - d[6] if r > 5 else d[r]
    rest = n - sum(cut(r, d1) for r in c.values())
    p = lambda w: (cut(c[w], d1) if w in c else rest) / n
    ctx, lost, mass = Counter(), Counter(), Counter()
    for (x, w), r in b.items():
        ctx[x] += r
        lost[x] += r - cut(r, d2)
        mass[x] += p(w)
    q = lambda x, w: cut(b[x, w], d2) / ctx[x] if b[x, w] else (lost[x] / ctx[x] / (1 - mass[x]) * p(w) if x in ctx else p(w))
    for x in ["<s>", *list(c)[:5]]:
        if x in ctx:
            assert abs(sum(q(x, w) for w in c) + q(x, "\0") - 1) < 1e-9
    return [(d, o, len(w), sum(t in c for t in w), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w), sum(math.log10(q(x, t)) for x, t in zip(["<s>"] + w[:-1], w))) for (d, _), o, w in zip(rows, out, toks)]


def test_katz(docs, none, monkeypatch):
    want = sorted(katz(plain()))
    for size, flush in ((1 << 30, 1 << 20), (20_000, 500)):
        monkeypatch.setattr(katz_backoff, "FLUSH", flush)
        got = sorted(map(tuple, katz_backoff.score_corpus(docs, size).collect()))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    # pairs that don't travel: a frequent one in both folds, one in training alone, one held out alone
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, "of the " * 40 + f"w{i} rest") for i in range(200)] + [(i, "only here " * 30) for i in held if i >= 200] + [(i, "in training " * 30 + "of x") for i in range(200, 300) if i not in held]
    more = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(katz_backoff, "FLUSH", 2000)
    words = katz_backoff.count_words(more, 12, 2000)
    assert len(katz_backoff.vocabulary(words, 12).pairs) >= 6
    got, want = sorted(map(tuple, katz_backoff.score_corpus(more, 12_000).collect())), sorted(katz(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert katz_backoff.score_corpus(none).collect() == []
    # no training row: one unknown word
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = docs.sparkSession.createDataFrame([(held, "a b")], "doc_id long, text string")
    assert tuple(katz_backoff.score_corpus(one).first()) == (held, True, 3, 0, 0, 0.0, 0.0)


# 3, 9, 10


def test_token_code():
    v = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        assert (token_files.decode(*token_files.encode(v[:n]), n) == v[:n]).all()


@pytest.mark.parametrize(("file", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_stretches_equal_the_tokenizer(file, spaced):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(file))
    r = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(" \n\t 　 abcÀé'’.,1日s<|") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    made = subwords.byte_level(P.path(file), spaced)
    got = [ids[a:b].tolist() for _, ids, at in made.batches(pa.array(texts)) for a, b in itertools.pairwise(at.tolist())]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_files.round_trip(docs, P.path("word_bpe_49k.json"), 2000).collect()
    ids = lambda x: np.array(tok.encode(x, add_special_tokens=False).ids + [2], "<u4")
    want = Counter((d, len(ids(x)), zlib.crc32(ids(x).tobytes())) for d, x in plain())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(d for d, _ in plain())
    assert token_files.round_trip(none, P.path("word_bpe_49k.json")).collect() == []
    # a folder says all that its reader needs
    path = f"{shared.folder(docs.sparkSession)}/files-of-ids"
    token_files.write_ids(token_files.tokenised(docs, P.path("word_bpe_49k.json"), False, 2), path, 3)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_ids(docs.sparkSession, path).collect()) == want


def test_hilbert_is_a_walk():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = curve_packing.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_ranges_of_even_weight(spark):
    """A key with a third of the rows, and rows of very different weights."""
    rng = random.Random(1)
    rows = [(7 if i % 3 == 0 else rng.randrange(1000), i, 1 if rng.random() < 0.9 else 50) for i in range(6000)]
    df = spark.createDataFrame(rows, "key long, tie long, weight long")
    cuts = tables.ranges(df, 12)
    to = cuts.of(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    load = np.bincount(to, weights=[r[2] for r in rows], minlength=len(cuts))
    assert len(cuts) == 12 and load.max() < 2 * load.mean()
    ordered = [r for _, r in sorted(zip(to.tolist(), rows), key=lambda x: (x[0], x[1]))]
    assert ordered == sorted(rows)
    got = tables.by_range(df, 12).rdd.glom().collect()
    assert [tuple(r)[:2] for part in got for r in part] == sorted(r[:2] for r in rows)
    assert len(tables.ranges(df.limit(0), 5)) == 1


def test_neighbours_on_the_curve_are_alike():
    rng = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    kind = [rng.randrange(6) for _ in range(600)]
    texts = [" ".join(rng.choice(topics[k]) if rng.random() < 0.7 else f"common{rng.randrange(50)}" for _ in range(rng.choice([40, 200, 1000]))) for k in kind]
    order = np.argsort(curve_packing.hilbert_key(curve_packing.cells(pa.array(texts))), kind="stable")
    along = np.array(kind)[order]
    same = lambda x: float(np.mean(x[1:] == x[:-1]))
    assert same(along) > 0.6 > 3 * same(np.array(kind))


def test_stretches_with_equal_hashes(monkeypatch):
    from tokenizers import Tokenizer

    weak = lambda data, start, end: wordscan.span_hashes(data, start, end) & np.uint64(3)
    monkeypatch.setattr(subwords, "span_hashes", weak)
    for file, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        tok = Tokenizer.from_file(P.path(file))
        made = subwords.byte_level.__wrapped__(P.path(file), spaced)
        texts = [t or "" for t in TEXTS if t is not LONG] + ["one", "two", "one two"]
        got = [ids[a:b].tolist() for _, ids, at in made.batches(pa.array(texts)) for a, b in itertools.pairwise(at.tolist())]
        assert got == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces_without_spaces():
    import time

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    for letters, n in (("日本語中文字", 40_000), ("ABCDabcd0123+/", 400_000)):
        text = "".join(r.choice(letters) for _ in range(n))
        made = piece_backtracking.PieceEncoder(path)
        start = time.time()
        assert made.encode("▁" + text) == sp.encode(text)
        assert time.time() - start < 20


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = curve_packing.pack(docs, P.path("byte_bpe_50k.json"), 256, 20_000).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["length"] > 0
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 256 and n & (n - 1) == 0 for n in ends.values())
    texts = dict(plain())
    for d in {d for d, _ in plain()}:
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        ids = np.array(tok.encode(texts[d], add_special_tokens=False).ids + [1], "<u4")
        copies = sum(x == d for x, _ in plain())
        assert sum(r["length"] for r in own) == copies * len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    assert curve_packing.pack(none, P.path("byte_bpe_50k.json")).collect() == []


def test_pieces(docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    made, stretches = piece_backtracking._worker(path)
    r = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("  ▁\n\tabcdetionTHE.éñ日🎉\x00") for _ in range(r.randint(0, 80))) for _ in range(2000)] + ["a" * 3000, " " * 500 + "x"]
    got = [ids[a:b].tolist() for _, ids, at in stretches.batches(piece_backtracking.spaced(pa.array(texts))) for a, b in itertools.pairwise(at.tolist())]
    assert got == [sp.encode(t) for t in texts]
    rows = {x["doc_id"]: x for x in piece_backtracking.encoded(docs, path).collect()}
    assert all(rows[d]["ids"] == sp.encode(x) and rows[d]["decoded"] == sp.decode(sp.encode(x)) for d, x in plain())
    assert piece_backtracking.encoded(none, path).collect() == []


# 4


def test_pages(spark):
    model = dom_marginals.train()
    hit = [0, 0, 0]
    for page in labelled_pages.pages(80, 20241):  # neither the training seed nor the one that choices were made on
        tree = dom_marginals.parse(page)
        b = dom_marginals.assemble([tree])
        keep = dom_marginals.marginals(b, model)[0][:, 1] >= 0.5
        for text, leaf, k in zip(tree.texts, tree.leaf, keep):
            if leaf:
                good = labelled_pages.MARK in text
                hit[0] += k and good
                hit[1] += k and not good
                hit[2] += good and not k
    assert hit[0] / (hit[0] + hit[1]) > 0.97 and hit[0] / (hit[0] + hit[2]) > 0.97
    page = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p>One\n  two <b>th</b>ree.<p>Four<br>five.</article><section class='comments'><p>Nice post, thanks a lot.</p></section><footer>&copy; me</footer>"
    rows = [(1, page), (2, None), (3, ""), (4, "<<<>>"), (5, "<article><p>" + "word " * 50_000 + "</article>"), (5, page)]
    got = dom_marginals.main_text(spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' as url", "1 as n_chars"))
    by = [(r["page_id"], r["text"], r["n_chars"]) for r in got.collect()]
    assert by[0][1] == "A & B One two three. Four five." and by[1][1:] == ("", 0) and by[2][1] == "" and len(by) == 6 and by[5][1] == by[0][1]
    assert len(by[4][1].split()) == 50_000


BODY = "<article><h1>Heading of it</h1>" + "".join(f"<p>Sentence number {i} of the article stands here. It has some words more, too.</p>" for i in range(6)) + "</article>"
SAID = " ".join(["Heading of it", *[f"Sentence number {i} of the article stands here. It has some words more, too." for i in range(6)]])
MENU = "<nav class=menu><a href=/a>Home</a> <a href=/b>News</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><body>{MENU}{BODY}</body></html>",  # head without an end
        f"<title>T</title><meta charset=utf-8>{MENU}{BODY}",
        f'<html><head></head><body><script>var a="<!--";</script>{MENU}{BODY}</body></html>',
        f"<html><head></head><body><script>if (a < b) x = '<div';</script><style>p > a {{}}</style>{MENU}{BODY}</body></html>",
        f"<html><body>{MENU}<div><button>Press</div>{BODY}</body></html>",  # a button without an end
        f"<html><body><button>Press{MENU}{BODY}</body></html>",
        f"<html><body><button><div>Press</div></button>{MENU}{BODY}</body></html>",
        f"<html><body>{MENU}<select><option>One<option>Two{BODY}</body></html>",
        f"<html><body>{MENU}<noscript>Turn it on{BODY}</body></html>",
        f"<html><body>{MENU}{BODY}<p class='x>broken <b>quote</b></body></html>",
        f"<html><body>{MENU}{BODY}<!-- never closed <p>gone</p>",
    ],
)
def test_unclosed_markup(page):
    text = dom_marginals.extract([page], dom_marginals.train())[0]
    assert SAID in text and "Home" not in text and "gone" not in text and "var a" not in text


def test_deep_and_odd_pages():
    import time

    model, start = dom_marginals.train(), time.time()
    deep = "<div>" * 100_000 + BODY + "</b>" * 50_000 + "</div>" * 100_000
    inline = "<b>" * 50_000 + "<p>a" * 20_000
    odd = ["<a <a <a " * 20_000, "<title>" * 20_000 + "x", "<button>" * 20_000 + "x", "<p class='" * 5_000, "<li>a" * 20_000, "<" * 100_000]
    assert len(dom_marginals.extract([deep, inline, *odd], model)) == 8
    assert time.time() - start < 10
    shallow = dom_marginals.extract(["<div>" * 20 + BODY + "</div>" * 3 + "</i>"], model)
    assert shallow == [SAID]


def test_marginals_equal_enumeration():
    tree = dom_marginals.parse(labelled_pages.pages(1, 5)[0])
    small = dom_marginals.parse("<div><p>a b c.</p><ul><li>x</li><li>y</li></ul></div>")
    model = dom_marginals.train()
    b = dom_marginals.assemble([small, tree])
    got = dom_marginals.marginals(b, model)[0][: len(small.parent), 1]
    one = dom_marginals.assemble([small])
    total, sums = 0.0, np.zeros(len(small.parent))
    for y in itertools.product((0, 1), repeat=len(small.parent)):
        s = sum(float(one.x[i] @ model.weight) for i in range(len(y)) if y[i])
        s += sum(model.tie[one.kind[i], y[one.parent[i]], y[i]] for i in range(1, len(y)))
        total += math.exp(s)
        sums += np.array(y) * math.exp(s)
    assert np.allclose(got, sums / total)


# 5, 7


def corpus(spark, n=400):
    r = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(80)]
        rows.append((i, " ".join(w + "***" for w in words) if bad else " ".join(words) + "."))
        marks.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality(spark, docs, none):
    rows, labels = corpus(spark)
    model = pu_quality.fit(rows, labels)
    got = pu_quality.score(rows, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and sum((r["predicted"] == 1) == (r["doc_id"] % 5 > 0) for r in held) / len(held) > 0.95
    # labels of the held-out fold, and columns other than text, change nothing
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    assert [r["score"] for r in pu_quality.score(rows, pu_quality.fit(rows, turned)).collect()] == [r["score"] for r in got]
    edge = pu_quality.score(docs, model).collect()
    assert len(edge) == len(ROWS) and all(0 <= r["score"] <= 1 for r in edge)
    assert pu_quality.fit(rows, labels.limit(0)) is None and pu_quality.score(rows, None).first()["score"] == 0.5
    assert pu_quality.score(none, model).collect() == []


def counts(t):
    w = WORD.findall(t)
    g = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k in range(len(w) - 2) if g[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)]


def test_forest_scores_by_a_plain_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 7))
    forest = rule_forest.grow(x, trees=20, rows=64)

    def expected(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (sum(1 / i for i in range(1, n)) - (n - 1) / n)

    seen = rng.choice(300, 40, replace=False)
    for row in [*x[seen], np.full(7, 50.0)]:
        lengths = []
        for f, c, k, n in zip(forest.feature, forest.cut, forest.child, forest.length):
            node, steps = 0, 0
            while f[node] >= 0:
                node, steps = k[node] + (row[f[node]] >= c[node]), steps + 1
            assert steps <= 6 and n[node] >= steps  # 64 rows a tree
            lengths.append(n[node])
        assert abs(forest.score(row[None])[0] - 2 ** (-np.mean(lengths) / forest.norm)) < 1e-12
    assert abs(forest.norm - expected(64)) < 0.02
    assert forest.score(np.full((1, 7), 50.0))[0] > forest.score(x).max()  # what lies far out has short paths


def test_rules(spark, docs, none):
    rows, labels = corpus(spark)
    forest = rule_forest.fit(spark, rows, labels)
    got = rule_forest.judge(rows, forest).collect()
    assert sum(r["kept"] == (r["doc_id"] % 5 > 0) for r in got) / len(got) > 0.98
    edge = rule_forest.judge(docs, forest).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in edge) == Counter((d, *counts(x)) for d, x in plain())
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in edge)
    assert rule_forest.fit(spark, rows, labels.limit(0)) is None and rule_forest.judge(none, forest).collect() == []


def test_rules_learn_from_all_labels(spark, monkeypatch):
    """Threshold and forest against all labelled rows, more than the 20,000 that were once used at most."""
    rng = np.random.default_rng(6)
    n = 24_000
    stats = np.zeros((n, len(rule_forest.COUNTS)), np.int64)
    stats[:, 0], stats[:, 8] = 400, 9
    stats[:, 1] = rng.integers(1600, 2400, n)
    good = rng.random(n) < 0.7
    stats[:, 2] = np.where(good, rng.integers(0, 6, n), rng.integers(20, 300, n))
    counted = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(stats)], "doc_id long, counts array<long>").repartition(4)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    drawn, draw = [], rule_forest._draw
    monkeypatch.setattr(rule_forest, "_draw", lambda known, m: drawn.append((m, known.count(), draw(known, m))) or drawn[0][2])
    forest = rule_forest.fit_counted(counted, labels)
    (goods, rows, own), = drawn
    assert (goods, rows) == (good.sum(), n) and [len(x) for x in own] == [rule_forest.TREE_ROWS] * rule_forest.TREES
    assert len(np.unique(np.concatenate(own), axis=0)) > 0.5 * len(np.unique(rule_forest.features(stats[good]), axis=0))
    score = forest.score(rule_forest.features(stats))
    tried = np.unique(np.ceil(score * rule_forest.CELLS)) / rule_forest.CELLS
    tried = [t for t in tried if np.mean(score[good] <= t) >= rule_forest.KEEP_GOOD]
    assert forest.threshold == max(tried, key=lambda t: (np.mean(score[~good] > t) - np.mean(score[good] > t), -t))
    none = rule_forest.fit_counted(counted, labels.selectExpr("doc_id", "0 as quality"))
    assert none is None


# 6


def kept(rows, n):
    words = [WORD.findall(x) for _, x in rows]
    c = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {k for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("n", [35, 4, 5])
def test_repeats(docs, none, monkeypatch, n):
    for size, flush in ((1 << 30, 1 << 20), (3000, 100)):
        monkeypatch.setattr(repeat_automata, "FLUSH", flush)
        got = repeat_automata.remove_repeats(docs, n, size).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"]))) for r in got) == kept(plain(), n)
        assert {r["doc_id"]: r["lang"] for r in got}[0] == "en" and {r["shard"] for r in got if r["doc_id"] == 3} == {1}
    assert repeat_automata.remove_repeats(none).collect() == []


@pytest.mark.parametrize("mask", [0xFFFFF00000000000, 0xFFFFFF0000000000])
def test_windows_with_equal_hashes(docs, mask):
    """The first hash forced to be the same for many windows: the second tells them apart."""
    for n, size in ((4, 1 << 30), (5, 3000)):
        got = repeat_automata.remove_repeats(docs.withColumn("found", docs.doc_id), n, size, mask).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["text"]))) for r in got) == kept([(d, x) for d, x in plain()], n)
        assert all(r["found"] == r["doc_id"] for r in got)


def test_repeats_random(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for i in range(60)]
    got = repeat_automata.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 7, 300).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], " ".join(x["text"].split())) for x in got) == kept(rows, 7)


# 8


def near_groups(prints):
    least = {p: p for p in prints}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    own = sorted(least)
    for i, x in enumerate(own):
        for y in own[:i]:
            if (x ^ y).bit_count() <= 2:
                a, b = root(x), root(y)
                least[max(a, b)] = min(a, b)
    return {p: root(p) for p in least}


def test_gray_index():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5).astype(np.uint64)
    prints = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 2)).astype(np.uint64), axis=1) for b in base] + [base]))
    tree = simhash_groups.GrayIndex(prints)
    q, n = tree.search(prints, 2)
    want = {(int(a), int(b)) for a in prints for b in prints if (int(a) ^ int(b)).bit_count() <= 2}
    assert {(int(prints[i]), int(tree.prints[j])) for i, j in zip(q, n)} == want


def test_links_in_crowded_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash_groups, "MOST_IN_GROUP", 4)
    r = random.Random(5)
    prints = {0}
    for _ in range(300):
        x = r.choice(sorted(prints))
        for _ in range(r.choice([1, 2, 3, 5])):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    found = components.components(simhash_groups.links(spark.createDataFrame(signed, "fp long")))
    got = {r["node"] & (2**64 - 1): r["root"] for r in found.collect()}
    want = near_groups(prints)
    same = {}
    for x in prints:
        same.setdefault(want[x], set()).add(got.get(x, x - (1 << 64) if x >> 63 else x))
    assert all(len(v) == 1 for v in same.values()) and len(set().union(*same.values())) == len(same)


def test_simhash(docs, none):
    prints = {}
    for d, x in plain():
        w = WORD.findall(lower(x))
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in g]
        prints[d] = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
    root = near_groups(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    got = simhash_groups.group_documents(docs).collect()
    assert sorted(map(tuple, got)) == sorted((d, format(prints[d], "016x"), least[root[prints[d]]]) for d, _ in plain())
    one = simhash_groups.keep_one(docs.selectExpr("*", "7 as n", "8 as place")).collect()
    assert {(r["n"], r["place"]) for r in one} == {(7, 8)} and [r["fp"] for r in one] == [r["doc_id"] // 3 if r["doc_id"] != 39 else r["fp"] for r in one]
    assert sorted(r["doc_id"] for r in one) == sorted(least.values())
    assert simhash_groups.group_documents(none).collect() == []


def test_components_of_a_path(spark):
    n = 40
    order = list(range(n))
    random.Random(0).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(spark, 200)
    extra = [(1000 + i, rows.where("doc_id = 1").first()["text"]) for i in range(3)] + [(2000, None), (2001, "")]
    all_rows = rows.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "'x' as score", "1 as rest")
    all_rows.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = all_rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == all_rows.columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = {r["doc_id"] for r in docs.collect()}
    good = {i for i in range(200) if i % 5}
    assert len(good - left) <= 3 and not any(i % 5 == 0 for i in left if i < 200) and not left & {1000, 1001, 1002, 2000, 2001}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == left
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, all_rows.limit(0), str(tmp_path)).collect() == []
