"""Document fingerprints by consistent weighted sampling.

The weighted terms of a text are its runs of SHINGLE words with their counts (a
shorter text: its whole word sequence). For each term k and slot d, a hash of the
term seeds r ~ Gamma(2,1), c ~ Gamma(2,1) and b ~ Uniform(0,1). With weight S:

    t = floor(ln S / r + b),  y = exp(r (t - b)),  a = c exp(-r) / y

and slot d keeps the (k, t) with the least a. Two texts agree in a slot with a
probability equal to their generalised Jaccard similarity.

Drawing all terms times slots is too slow, so the draws are re-ordered without a
change of their law. With E = r b and E' = r (1 - b), E and E' are independent
Exp(1) values, and at weight 1 (t = 0) a = c exp(-E') =: a1 is Exp(1). Given a1,
exp(E') = 1 + Exp(1) / a1, and c = a1 exp(E'). So a term first draws its a1 values
over all slots in ascending order (order statistics, slots by an affine
permutation) and stops once they pass a bound that each slot's minimum lies below.
Terms of weight 1 need no more; the few others draw E and E' for every slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .wordscan import U, buffers, grams, mix, runs, scan, uniform

SLOTS, SHINGLE = 128, 5
_G = 0x9E3779B97F4A7C15


def _draw(h: np.ndarray, kind: int, j) -> np.ndarray:
    """Exp(1) values that belong to a term, a use and a number."""
    step = np.atleast_1d(np.asarray(j)).astype(U) + U(1)
    return -np.log(uniform(mix(h + U((_G * (2 * kind + 1)) & (2**64 - 1)) * step)))


def _weights(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of terms found once in their document; first places of the others, with counts."""
    key = mix(h + doc.astype(U) * U(_G))
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.arange(len(h)), np.zeros(0, np.int64), np.zeros(0)
    hint = np.zeros(1 << 16, bool)
    hint[(again >> U(48)).astype(np.int64)] = True
    some = np.flatnonzero(hint[(key >> U(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(again, key[some]), len(again) - 1)
    some = some[again[at] == key[some]]
    once = np.ones(len(h), bool)
    once[some] = False
    _, first, count = np.unique(key[some], return_index=True, return_counts=True)
    return np.flatnonzero(once), some[first], count.astype(np.float64)


def signatures(doc: np.ndarray, h: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """Rows of slots numbers of 16 bits; terms may repeat, their count is their weight. No term: zeros."""
    assert slots & (slots - 1) == 0
    best = np.full(docs * slots, np.inf)
    out = np.zeros(docs * slots, np.uint16)
    one, many, count = _weights(doc, h)

    def offer(place: np.ndarray, a: np.ndarray, name: np.ndarray) -> None:
        np.minimum.at(best, place, a)
        won = best[place] == a
        out[place[won]] = (name[won] >> U(48)).astype(np.uint16)

    for i in range(0, len(many), 1024):
        k, s = many[i : i + 1024], count[i : i + 1024, None]
        hk = h[k]
        j = np.arange(slots)
        a1 = np.cumsum(_draw(hk[:, None], 0, j[None, :]) / (slots - j), axis=1)
        slot = _slot(hk[:, None], j[None, :], slots)
        grow = 1 + _draw(hk[:, None], 1, j[None, :]) / a1
        e = _draw(hk[:, None], 2, j[None, :])
        r = e + np.log(grow)
        b = e / r
        t = np.floor(np.log(s) / r + b)
        a = a1 * grow * np.exp(-r - r * (t - b))
        name = mix(mix(hk)[:, None] + t.astype(np.int64).astype(U) * U(_G))
        offer((doc[k][:, None] * slots + slot).ravel(), a.ravel(), name.ravel())

    d1, h1 = doc[one], h[one]
    own = np.bincount(d1, minlength=docs)
    bound = (np.log(slots) + 7) / np.maximum(own, 1)
    due = own > 0
    while due.any():
        pick = np.flatnonzero(due[d1]) if not due.all() else np.arange(len(d1))
        d, k = d1[pick], h1[pick]
        a, j = np.zeros(len(d)), 0
        while len(d) and j < slots:
            a = a + _draw(k, 0, j) / (slots - j)
            near = a <= bound[d]
            d, k, a = d[near], k[near], a[near]
            offer(d * slots + _slot(k, np.int64(j), slots), a, mix(mix(k)))
            j += 1
        due &= ~(best.reshape(docs, slots) <= bound[:, None]).all(axis=1)
        due &= bound < 1e3
        bound = bound * 3
    return out.reshape(docs, slots)


def _slot(h: np.ndarray, j, slots: int) -> np.ndarray:
    p = mix(h ^ U(0x5DEECE66D5DEECE6))
    odd, shift = (p >> U(20)) | U(1), p >> U(40)
    return ((odd * np.atleast_1d(np.asarray(j)).astype(U) + shift) & U(slots - 1)).astype(np.int64)


def fingerprint(arr: pa.Array, slots: int = SLOTS, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of whole texts, and which have a word."""
    data, bounds = buffers(arr)
    out, some = [], []
    for i, j in runs(bounds):
        w = scan(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        h, at = grams(w.hashes(), w, n, short=True)
        out.append(signatures(w.doc[at], h, j - i, slots))
        some.append(w.counts > 0)
    if not out:
        return np.zeros((0, slots), np.uint16), np.zeros(0, bool)
    return np.concatenate(out), np.concatenate(some)


def likeness(x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray) -> np.ndarray:
    """Share of equal slots; two texts without words are alike, one such text is like no other."""
    return np.where(has_x & has_y, (x == y).mean(axis=1), (has_x == has_y).astype(float))


def hexed(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u2").tobytes().hex()
    n = sig.shape[1] * 4
    return [raw[i : i + n] for i in range(0, len(raw), n)]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place, key and text, the next range's first row last: each row with the one behind it."""
    import hashlib

    ids: list[int] = []
    held: list[str] = []

    def out(close: bool) -> Iterator[pa.RecordBatch]:
        n = len(ids) - 1
        if n < 1 or (not close and sum(map(len, held)) < 1 << 20):
            return
        edited = []
        for x, y in zip(held, held[1:], strict=False):
            cut = len(x) // 4
            edited.append(x[: len(x) - cut] + y[:cut])
        own, has = fingerprint(pa.array(held, pa.large_string()))
        new, has_new = fingerprint(pa.array(edited, pa.large_string()))
        yield tables.to_batch(
            SCHEMA, doc_id=ids[:-1], n_chars=[len(x) for x in held[:-1]], edited_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in edited], fingerprint=hexed(own[:-1]), edited_fingerprint=hexed(new),
            near_edited=likeness(own[:-1], new, has[:-1], has_new), near_next=likeness(own[:-1], own[1:], has[:-1], has[1:]),
        )
        del ids[:-1], held[:-1]

    after = False
    for b in batches:
        for key, text, far in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["far"].to_pylist(), strict=True):
            if far and after:
                continue  # a tie of the next range's first row
            after = after or far
            ids.append(key)
            held.append(text)
            yield from out(False)
    yield from out(True)


def compare_with_next(docs: DataFrame, task_bytes: int = tables.TASK_BYTES) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and both likenesses.

    The next document is the one behind it by (doc_id, text), nulls first; after the
    last comes the first. Texts are dealt once, into ranges of doc_id of even bytes; the
    first rows of a range also go to the range before it. A null text is empty; an
    empty text has a fingerprint of zeros; an empty table gives no rows; other columns
    are ignored.
    """
    rows = tables.texts(docs)
    keyed = rows.select(F.coalesce("doc_id", F.lit(tables.LOW)).alias("key"), F.lit(0).cast("long").alias("tie"), (F.octet_length("text") + 1).cast("long").alias("weight"))
    size, least = keyed.agg(F.sum("weight"), F.min("key")).first()
    cuts = tables.ranges(keyed, tables.tasks_for(size or 0, task_bytes))
    cuts = tables.Ranges(cuts.key[cuts.key > (least or 0)], cuts.tie[cuts.key > (least or 0)])
    lows = np.r_[np.int64(least or 0), cuts.key]  # the first key of each range

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = pc.fill_null(b["doc_id"], tables.LOW).to_numpy()
            to = cuts.of(key, np.zeros(len(key), np.int64))
            first = np.flatnonzero(lows[to] == key)
            for rows_of, at, far in ((b, to, False), (b.take(pa.array(first)), (to[first] - 1) % len(lows), True)):
                yield pa.RecordBatch.from_arrays([rows_of["doc_id"], rows_of["text"], pa.array(at, pa.int32()), pa.array(np.full(len(at), far))], ["doc_id", "text", "to", "far"])

    dealt_out = tables.deal(rows.mapInArrow(dealt, "doc_id long, text string, to int, far boolean"), len(lows), "to")
    ordered = dealt_out.sortWithinPartitions("far", F.asc_nulls_first("doc_id"), "text")
    return ordered.select("doc_id", "text", "far").mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(tables.table(spark, sf_dir, "documents"))
