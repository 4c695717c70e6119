"""A Katz backoff language model, trained on and evaluated over whole corpora.

Tokens are lower-cased words and one end per document. With Good-Turing discounts d_r

    P(w | v) = d c(v,w) / c(v)   if the pair was seen, else   a(v) P(w)
    P(w)     = d c(w) / N        if the word was seen, else   the mass left over

and a(v) = (1 - sum of seen P(. | v)) / (1 - sum of P(w) over words seen after v), so
each distribution sums to one over the vocabulary and one unknown word. Counts above K
are lowered by as much as K is, which leaves every context some mass.

All work is by hash buckets. Pairs lie in the bucket of the predicted word, where c(w)
and c(v,w) are counted; the terms of log P that depend on the context alone, -log c(v)
for each occurrence of v and log(a(v) c(v)) for each pair not seen, are added where v lies.
Words so frequent that they would fill a bucket (a bounded list with counts) are spread by
pair instead, and tokens of pairs as frequent (a bounded list, too) don't travel at all: each task
counts them by document. What is dealt between tasks is packed: sorted hashes as differences,
contexts through a dictionary. Word counts and context weights are written as
tables by bucket; pair counts live in the exchange by bucket that all steps read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed, tables
from .wordscan import U, buffers, mix, runs, scan

FOLDS, HELD_OUT, K = 5, 1, 5
#: Tokens packed at a time; bytes of text for each bucket (both grow with the root of large inputs, so rows between tasks grow with the input); a word is spread if it has over this share of a bucket's tokens.
FLUSH, BUCKET_BYTES, SPREAD = 1 << 20, 9 << 20, 0.25
END, BEGIN = U(0x1234567890ABCDEF), U(0x0FEDCBA987654321)


def discounts(of: np.ndarray) -> np.ndarray:
    """What is left of counts 0 to K, and last how much larger ones lose. of: how many types have counts 1 to K + 1.

    Good-Turing as by Katz; counts for which it gives no ratio between 0 and 1 (copies can cause that) are lowered by Ney's absolute discount.
    """
    n = of.astype(np.float64)
    out = np.zeros(K + 2)
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        big = (K + 1) * n[K] / n[0]
        ratio = ((r + 1) * n[1:] / n[:K] / r - big) / (1 - big)
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
    cut = min(max(cut, 0.05), 0.95)
    out[1 : K + 1] = np.where(np.isfinite(ratio) & (ratio > 0) & (ratio < 1), ratio * r, r - cut)
    out[K + 1] = K - out[K]
    return out


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = count.astype(np.int64)
    return np.where(c > K, c - d[K + 1], d[np.minimum(c, K)])


def of_counts(count: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2]


def lost_of(types: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What counts lose in all, by rows of how many types have counts 1 to K + 1, and more."""
    return types[:, :K] @ (np.arange(1, K + 1) - d[1 : K + 1]) + types[:, K:].sum(axis=1) * d[K + 1]


def _tokens(docs_batches: Iterator[pa.RecordBatch], flush: int):
    """For runs of about flush tokens: word hashes, context hashes, document of each token, and of the documents: ids, held out, tokens."""
    held: list[tuple] = []
    total = 0

    def out():
        shift = np.cumsum([0, *[len(x[3]) for x in held[:-1]]])
        return (np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] + s for x, s in zip(held, shift, strict=True)]), np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]), np.concatenate([x[5] for x in held]))

    for b in docs_batches:
        data, bounds = buffers(b["text"])
        ids = b["doc_id"].to_pylist()
        for i, j in runs(bounds):
            w = scan(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower=True)
            n = j - i
            h = np.insert(w.hashes(), w.first[1:], END)
            doc = np.insert(w.doc, w.first[1:], np.arange(n))
            before = np.concatenate([[BEGIN], h[:-1]])
            before[np.r_[True, doc[1:] != doc[:-1]]] = BEGIN
            out_fold = np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in ids[i:j]], bool)
            held.append((h, before, doc, np.array(ids[i:j], object), out_fold, w.counts + 1))
            total += len(h)
            if total >= flush:
                yield out()
                held, total = [], 0
    if held:
        yield out()


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])


def _split(h: np.ndarray, bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices by bucket of rows in ascending bucket order."""
    cut = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), slice(int(cut[b]), int(cut[b + 1]))


def count_words(rows: DataFrame, buckets: int, flush: int) -> DataFrame:
    """The written table of training words: bucket, n (types), tokens, how many types have counts 1 to K + 1, packed (hash, count).

    And of pairs that may be frequent, packed (pair, word, context, count): those that fill half of their share of a run of tokens.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, before, doc, _, out, _ in _tokens(batches, flush):
            own, count = np.unique(h[~out[doc]], return_counts=True)
            found = [(b, b"W" + packed.pack(own[s], count[s])) for b, s in _split(own, packed.bucket_of(own, buckets), buckets)]
            pair = _pair(h, before)
            order = np.argsort(pair)
            first = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
            count = np.diff(np.r_[first, len(pair)])
            often = count >= max(2, SPREAD / 2 * len(pair) / buckets)
            at, count = order[first[often]], count[often]
            found += [(b, b"P" + packed.pack(pair[at[s]], h[at[s]], before[at[s]], count[s])) for b, s in _split(pair[at], packed.bucket_of(pair[at], buckets), buckets)]
            if found:
                yield _rows(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x.as_py() for b in batches for x in b["data"]]
        if not got:
            return
        words, pairs = ([packed.unpack(x[1:]) for x in got if x[:1] == kind] for kind in (b"W", b"P"))
        none = np.zeros(0, U)
        h, count = _summed(np.concatenate([none, *[g[0] for g in words]]), np.concatenate([none, *[g[1] for g in words]]).astype(np.int64))
        pair, word, before, times = (np.concatenate([none, *[g[k] for g in pairs]]) for k in range(4))
        order = np.argsort(pair)
        first = order[np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]][: len(pair)])]
        row = [
            pa.array([int(packed.bucket_of((h if len(h) else pair)[:1], buckets)[0])], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(count.sum())], pa.int64()),
            pa.array([of_counts(count).tolist()], pa.list_(pa.int64())), pa.array([packed.pack(h, count)], pa.binary()), pa.array([packed.pack(pair[first], word[first], before[first], _summed(pair, times)[1])], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(row, ["bucket", "n", "tokens", "types", "data", "pairs"])

    dealt = tables.deal(rows.mapInArrow(part, "bucket int, data binary"), buckets, "bucket")
    return tables.keep(dealt.mapInArrow(merge, "bucket int, n long, tokens long, types array<long>, data binary, pairs binary"))


def _summed(h: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(h):
        return h, *columns
    order = np.argsort(h)
    h = h[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[start], *[np.add.reduceat(c[order], start) for c in columns]


@dataclass
class Vocabulary:
    """Numbers of the word table; words that are spread, and frequent pairs: at most a few times buckets / SPREAD of each."""

    tokens: int
    types: int
    left: np.ndarray  # discounts
    spread: np.ndarray
    spread_count: np.ndarray
    documents: int  # in training
    pairs: np.ndarray  # frequent ones, with their words and contexts
    pair_word: np.ndarray
    pair_before: np.ndarray

    def counts(self, h: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Local counts, but for words that are spread."""
        at, hit = self.find(h)
        return np.where(hit, self.spread_count[at], local)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.spread, h), len(self.spread) - 1)
        return at, self.spread[at] == h

    def log_word(self, count: np.ndarray) -> np.ndarray:
        """log10 P(w) by training count; unknown words share what is left over."""
        return np.log10(np.where(count > 0, discounted(count, self.left), self.rest) / self.tokens)

    rest: float = 0.0


def vocabulary(words: DataFrame, buckets: int) -> Vocabulary | None:
    sums = words.select("n", "tokens", "types").collect()  # a row for each bucket
    tokens, types = sum(r["tokens"] for r in sums), sum(r["n"] for r in sums)
    if not tokens:
        return None
    of = np.sum([r["types"] for r in sums], axis=0)
    least = max(1, int(SPREAD * tokens / buckets))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b["pairs"]:
                pair, word, before, count = packed.unpack(x.as_py())
                some = count >= max(2, least // 2)
                yield pa.RecordBatch.from_arrays([pa.array([np.stack([pair[some], word[some], before[some]]).tobytes()], pa.binary())], ["pairs"])

    got = [np.frombuffer(r["pairs"], U).reshape(3, -1) for r in words.select("pairs").mapInArrow(often, "pairs binary").collect()]  # SPREAD bounds the pairs
    pairs = np.concatenate(got, axis=1)
    pairs = pairs[:, np.argsort(pairs[0])]

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b["data"]:
                h, c = packed.unpack(x.as_py())
                c = c.astype(np.int64)
                some = (c >= least) | (h == END) | np.isin(h, pairs[1])
                left = discounted(c, discounts(of)).sum()
                yield pa.RecordBatch.from_arrays([pa.array([h[some].tobytes()], pa.binary()), pa.array([c[some].tobytes()], pa.binary()), pa.array([float(left)])], ["h", "c", "kept"])

    found = words.select("data").mapInArrow(common, "h binary, c binary, kept double").collect()  # SPREAD bounds the words
    h = np.concatenate([np.frombuffer(r["h"], U) for r in found])
    c = np.concatenate([np.frombuffer(r["c"], np.int64) for r in found])
    order = np.argsort(h)
    out = Vocabulary(tokens, types, discounts(of), h[order], c[order], int(c[h == END][0]), *pairs)
    out.rest = tokens - sum(r["kept"] for r in found)
    return out


def _pair(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(h + mix(before + U(0x9E3779B97F4A7C15)))


def deal_pairs(rows: DataFrame, vocab: Vocabulary, buckets: int, flush: int) -> DataFrame:
    """Each token with its context, packed, in the bucket of the word (spread words: of the pair)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        for h, before, doc, ids, out, size in _tokens(batches, flush):
            pair = _pair(h, before)
            key = first + np.arange(len(ids))
            to = packed.bucket_of(mix(key.astype(U)), buckets)
            found = []
            if len(vocab.pairs):
                at = np.minimum(np.searchsorted(vocab.pairs, pair), len(vocab.pairs) - 1)
                hot = vocab.pairs[at] == pair
                name, n = np.unique(at[hot & ~out[doc]], return_counts=True)
                found += [(b, b"C" + packed.pack(vocab.pairs[name[s]], n[s])) for b, s in _split(name, packed.bucket_of(vocab.pairs[name], buckets), buckets)]
                both, n = np.unique(doc[hot] * len(vocab.pairs) + at[hot], return_counts=True)
                own, name = both // len(vocab.pairs), both % len(vocab.pairs)
                order = np.argsort(to[own], kind="stable")
                own, name, n = own[order], name[order], n[order]
                found += [(b, b"H" + packed.pack(key[own[s]].astype(U), name[s], n[s])) for b, s in _split(own, to[own], buckets)]
                h, before, doc, pair = h[~hot], before[~hot], doc[~hot], pair[~hot]
            _, wide = vocab.find(h)
            place = packed.bucket_of(np.where(wide, pair, h), buckets)
            order = np.lexsort((before, h, place))
            h, before, doc, place = h[order], before[order], doc[order], place[order]
            for b, s in _split(h, place, buckets):
                names, at = np.unique(before[s], return_inverse=True)
                head = packed.pack(names)
                body = packed.pack(h[s], at, doc[s], (~out[doc[s]]).astype(np.uint8))
                found.append((b, b"P" + np.array([first, len(head)], "<i8").tobytes() + head + body))
            known = np.array([x is not None for x in ids])
            own = np.array([x if x is not None else 0 for x in ids], np.int64)
            for b in np.unique(to):
                k = to == b
                found.append((int(b), b"D" + zstandard.ZstdCompressor(level=1).compress(np.stack([key[k], own[k], known[k], out[k], size[k]]).astype("<i8").tobytes())))
            first += len(ids)
            yield _rows(found)

    return tables.deal(rows.mapInArrow(part, "bucket int, data binary"), buckets, "bucket")


@dataclass
class Pairs:
    """The tokens of a bucket: word, context, document key, whether in training, and counts of word and pair."""

    h: np.ndarray
    before: np.ndarray
    key: np.ndarray
    train: np.ndarray
    word_count: np.ndarray
    pair_count: np.ndarray
    first: np.ndarray  # a token of each distinct pair


def _pairs(rows: Iterator, vocab: Vocabulary) -> tuple[Pairs | None, dict[bytes, list[bytes]]]:
    """The tokens, and other rows by kind: documents (D), frequent pairs by document (H) and in training (C)."""
    hs, vs, ks, ts, other = [], [], [], [], {b"D": [], b"H": [], b"C": []}
    for r in rows:
        data = bytes(r["data"])
        if data[:1] != b"P":
            other[data[:1]].append(data[1:])
            continue
        first, size = np.frombuffer(data, "<i8", 2, 1).tolist()
        (names,) = packed.unpack(data[17 : 17 + size])
        h, at, doc, train = packed.unpack(data[17 + size :])
        hs.append(h)
        vs.append(names[at])
        ks.append(first + doc.astype(np.int64))
        ts.append(train)
    if not sum(map(len, hs)):
        return None, other
    h, before, key, train = np.concatenate(hs), np.concatenate(vs), np.concatenate(ks), np.concatenate(ts)
    del hs, vs, ks, ts
    pair = _pair(h, before)
    order = np.argsort(pair)
    h, before, key, train, pair = h[order], before[order], key[order], train[order].astype(np.int64), pair[order]
    new = np.r_[True, pair[1:] != pair[:-1]]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    count = np.add.reduceat(train, first)
    names, at = np.unique(h[first], return_inverse=True)
    words = vocab.counts(names, np.bincount(at, weights=count, minlength=len(names)).astype(np.int64))
    return Pairs(h, before, key, train, words[at][group], count[group], first), other


def score_corpus(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Training leaves out the fold of crc32(doc_id). A null text is empty (its end alone); a null
    doc_id is in training. Rows that repeat count, and are scored, each. Without a training row
    the probabilities are those of a model that knows one unknown word: zero in log10. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rows = tables.texts(docs)
    size = tables.text_bytes(rows)
    buckets, flush = tables.tasks_for(size, bucket_bytes), int(FLUSH * tables.grown(size))
    words = count_words(rows, buckets, flush)
    vocab = vocabulary(words, buckets)
    if vocab is None:
        return _untrained(rows)
    # one exchange, read by each of the steps below
    dealt = deal_pairs(rows, vocab, buckets, flush).select("data").rdd

    def contexts(part):
        """By context: how many of its seen pairs have counts 1 to K + 1, and more, and P of the words seen after it. Frequent pairs' counts go to bucket 0's table."""
        p, other = _pairs(part, vocab)
        v, count, mass = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if p:
            k = p.first[p.pair_count[p.first] > 0]
            v, count, mass = [p.before[k]], [p.pair_count[k]], [discounted(p.word_count[k], vocab.left)]
        if got := [packed.unpack(x) for x in other[b"C"]]:
            pair, n = _summed(np.concatenate([g[0] for g in got]), np.concatenate([g[1].astype(np.int64) for g in got]))
            at = np.searchsorted(vocab.pairs, pair)
            v.append(vocab.pair_before[at])
            count.append(n)
            mass.append(discounted(pair_words[at], vocab.left))
            yield int(packed.bucket_of(pair[:1], buckets)[0]), bytearray(b"C" + packed.pack(pair, n))
        v, count = np.concatenate(v), np.concatenate(count)
        if len(v):
            own = np.minimum(count, K + 2)
            v, mass, *types = _summed(v, np.concatenate(mass), *[(own == r).astype(np.int64) for r in range(1, K + 3)])
            for b, s in _split(v, packed.bucket_of(v, buckets), buckets):
                yield b, bytearray(b"V" + packed.pack(v[s], mass[s], *[t[s] for t in types]))

    pair_words = vocab.counts(vocab.pair_word, np.zeros(len(vocab.pairs), np.int64))
    partial = spark.createDataFrame(dealt.mapPartitions(contexts), "bucket int, data binary", verifySchema=False)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x.as_py() for b in batches for x in b["data"]]
        if not got:
            return
        rows = [packed.unpack(x[1:]) for x in got if x[:1] == b"V"]
        hot = [packed.unpack(x[1:]) for x in got if x[:1] == b"C"]
        v, mass, *types = _summed(np.concatenate([np.zeros(0, U), *[g[0] for g in rows]]), *[np.concatenate([np.zeros(0, t), *[g[k].view(t) if t is np.float64 else g[k] for g in rows]]).astype(t) for k, t in enumerate([np.float64] + [np.int64] * (K + 2), 1)])
        pair, n = (np.concatenate([np.zeros(0, U), *[g[k] for g in hot]]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([[int(t.sum()) for t in types]], pa.list_(pa.int64())), pa.array([packed.pack(v, mass, *types)], pa.binary()), pa.array([pair.tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary())], ["types", "data", "pair", "n"])

    kept = tables.keep(tables.deal(partial, buckets, "bucket").mapInArrow(merged, "types array<long>, data binary, pair binary, n binary"))
    totals = kept.select("types", "pair", "n").collect()  # a row for each bucket, and the frequent pairs
    left = discounts(np.sum([r["types"] for r in totals], axis=0)[: K + 1])
    hot_count = np.zeros(len(vocab.pairs), np.int64)
    for r in totals:
        hot_count[np.searchsorted(vocab.pairs, np.frombuffer(r["pair"], U))] = np.frombuffer(r["n"], np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log10 of a(v) c(v), by context."""
        for b in batches:
            for x in b["data"]:
                v, mass, *types = packed.unpack(x.as_py())
                if not len(v):
                    continue
                lost = lost_of(np.stack(types, axis=1).astype(np.float64), left)
                back = np.log10(lost) - np.log10(np.maximum(1 - mass.view(np.float64) / vocab.tokens, vocab.rest / vocab.tokens))
                wide = vocab.find(v)[1] | (v == BEGIN) | np.isin(v, vocab.pair_before)
                yield pa.RecordBatch.from_arrays([pa.array([int(packed.bucket_of(v[:1], buckets)[0])], pa.int32()), pa.array([packed.pack(v, back)], pa.binary()), pa.array([v[wide].tobytes()], pa.binary()), pa.array([back[wide].tobytes()], pa.binary())], ["bucket", "data", "h", "back"])

    weights = tables.keep(kept.select("data").mapInArrow(weigh, "bucket int, data binary, h binary, back binary"))
    top = weights.select("h", "back").collect()  # the words that are spread, and the contexts of frequent pairs
    top_h = np.concatenate([np.frombuffer(r["h"], U) for r in top])
    top_back = np.concatenate([np.frombuffer(r["back"], np.float64) for r in top])
    order = np.argsort(top_h)
    top_h, top_back = top_h[order], top_back[order]
    scale = np.log10(vocab.tokens + 0.5 * (vocab.types + 1))

    def values(word_count, pair_count, before, end):
        """What tokens add to their documents' base, and to their score but for weights in other buckets; each takes off log c(v) as the next one's context."""
        value = np.where(pair_count > 0, np.log10(np.maximum(discounted(pair_count, left), 1e-300)), vocab.log_word(word_count))
        value -= np.where((word_count > 0) & ~end, np.log10(np.maximum(word_count, 1)), 0.0)
        value -= np.where(before == BEGIN, np.log10(vocab.documents), 0.0)
        at = np.minimum(np.searchsorted(top_h, before), len(top_h) - 1)
        return np.log10(word_count + 0.5) - scale, value + np.where((pair_count == 0) & (top_h[at] == before), top_back[at], 0.0)

    hot_base, hot_value = values(pair_words, hot_count, vocab.pair_before, vocab.pair_word == END)

    def unseen(part):
        """Contexts of pairs not seen in training, to the bucket of the context."""
        p, _ = _pairs(part, vocab)
        if not p:
            return
        k = np.flatnonzero(p.pair_count == 0)
        k = k[top_h[np.minimum(np.searchsorted(top_h, p.before[k]), len(top_h) - 1)] != p.before[k]]
        k = k[np.argsort(p.before[k])]
        v = p.before[k]
        for b, s in _split(v, packed.bucket_of(v, buckets), buckets):
            yield b, bytearray(packed.pack(v[s], p.key[k[s]].astype(U)))

    def backed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ask = None, []
        for b in batches:
            for is_weight, x in zip(b["weight"].to_pylist(), b["data"], strict=True):
                if is_weight:
                    known = packed.unpack(x.as_py())
                else:
                    ask.append(packed.unpack(x.as_py()))
        if known is None or not ask:
            return
        v, key = np.concatenate([a[0] for a in ask]), np.concatenate([a[1].astype(np.int64) for a in ask])
        at = np.minimum(np.searchsorted(known[0], v), len(known[0]) - 1)
        value = np.where(known[0][at] == v, known[1].view(np.float64)[at], 0.0)
        yield _rows(list(_by_document(key, np.zeros(len(key)), value, np.zeros(len(key), np.int64), buckets)))

    def seen(part):
        """What words and pairs add to their documents, and -log c(v) for each v that is a context."""
        p, other = _pairs(part, vocab)
        for d in other[b"D"]:
            yield packed_bucket(d, buckets), bytearray(b"D" + d)
        for x in other[b"H"]:
            key, name, n = packed.unpack(x)
            for b, data in _by_document(key, n * hot_base[name], n * hot_value[name], n * (pair_words[name] > 0).astype(np.int64), buckets):
                yield b, bytearray(data)
        if not p:
            return
        base, value = values(p.word_count, p.pair_count, p.before, p.h == END)
        for b, data in _by_document(p.key, base, value, (p.word_count > 0).astype(np.int64), buckets):
            yield b, bytearray(data)

    one = spark.createDataFrame(dealt.mapPartitions(seen), "bucket int, data binary", verifySchema=False)
    asked = spark.createDataFrame(dealt.mapPartitions(unseen), "bucket int, data binary", verifySchema=False).withColumn("weight", F.lit(False))
    both = asked.unionByName(weights.select("bucket", "data").withColumn("weight", F.lit(True)))
    two = tables.deal(both, buckets, "bucket").select("weight", "data").mapInArrow(backed, "bucket int, data binary")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, info = [], []
        for b in batches:
            for x in b["data"]:
                data = x.as_py()
                if data[:1] == b"D":
                    info.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "<i8").reshape(5, -1))
                else:
                    sums.append(packed.unpack(data[1:]))
        if not info:
            return
        key, doc, known, out, size = np.concatenate(info, axis=1)
        k, base, value, n = _summed(np.concatenate([s[0] for s in sums]), *[np.concatenate([s[c].view(np.float64) for s in sums]) for c in (1, 2)], np.concatenate([s[3].astype(np.int64) for s in sums]))
        at = np.searchsorted(k, key.astype(U))
        yield pa.RecordBatch.from_arrays([pa.array(doc, mask=known == 0), pa.array(out == 1), pa.array(size), pa.array(n[at]), pa.array(np.full(len(key), vocab.tokens)), pa.array(base[at]), pa.array(value[at])], OUT)

    return tables.deal(one.unionByName(two), buckets, "bucket").select("data").mapInArrow(total, OUT_TYPES)


OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
OUT_TYPES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed_bucket(info: bytes, buckets: int) -> int:
    key = np.frombuffer(zstandard.ZstdDecompressor().decompress(info), "<i8", 1)
    return int(packed.bucket_of(mix(key.astype(U)), buckets)[0])


def _by_document(key: np.ndarray, base: np.ndarray, value: np.ndarray, known: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Sums by document, packed for the documents' buckets."""
    k, base, value, known = _summed(key.astype(U), base, value, known)
    to = packed.bucket_of(mix(k), buckets)
    order = np.lexsort((k, to))
    k, base, value, known, to = k[order], base[order], value[order], known[order], to[order]
    for b, s in _split(k, to, buckets):
        yield b, b"S" + packed.pack(k[s], base[s], value[s], known[s])


def _untrained(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, ids, out, size in _tokens(batches, FLUSH):
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.int64()), pa.array(out), pa.array(size.astype(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n)), pa.array(np.zeros(n))], OUT)

    return rows.mapInArrow(run, OUT_TYPES)


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(tables.table(spark, sf_dir, "documents"))
