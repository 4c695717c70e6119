"""Substring dedup by repeated-phrase automata.

1. Each task hashes all windows of WINDOW words of its documents. A window found
   twice in the task is known to recur; of each distinct window one row goes to the
   bucket of its hash, where windows of several tasks meet. So a window that a third
   of all documents share is one row for each task. What recurs is reported to the
   shards (by hash of the document) that hold it.
2. Each shard gets its whole documents and its recurring windows. Their first places,
   joined to runs, are the recurring passages, cut into tiles of TILE words; every
   window of a passage holds a whole tile. The shard's tiles are compiled into an
   Aho-Corasick automaton over word numbers (three letters a word), all documents of the shard are streamed
   through it, and each hit is extended in both directions as far as document and
   passage agree. An extended hit of a window or more is an occurrence.

The text of an occurrence is cut out. Windows are compared by 80 bits, two hashes of their
words made independently; of n different windows about n^2 / 2^81 pairs collide.
Streaming every document through every shard's automaton would cost shards times corpus;
instead a document meets the one automaton that holds all recurring passages found in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed, tables
from .wordscan import U, buffers, grams, mix, powers, runs, scan

WINDOW = 35
#: Windows hashed at a time, and bytes of text in a shard; both grow with the root of large inputs, so rows between tasks grow with the input.
FLUSH, SHARD_BYTES = 1 << 19, 3 << 20
#: Letters that stand for a word's number in an automaton; more words in a shard share letters, and the extension tells them apart.
BASE, DIGITS = 128, 3
_STEP, _OTHER = 0xD6E8FEB86659FD93 | 1, U(0xA0761D6478BD642F)
FULL = (1 << 64) - 1


def window_hashes(word_hash: np.ndarray, words, n: int, mask: int = FULL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window, 64 bits (those of the mask), 16 others from words hashed anew, and its first word."""
    h, at = grams(word_hash, words, n)
    more, _ = grams(mix(word_hash ^ _OTHER), words, n)
    return h & U(mask), (more >> U(48)).astype(np.uint16), at


def _sorted(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of both hashes, and where a new window begins."""
    order = np.argsort(h)
    a, b = h[order], g[order]
    same, equal = a[1:] == a[:-1], b[1:] == b[:-1]
    if (same & ~equal).any():  # seldom: different windows with the same first hash
        order = np.lexsort((g, h))
        a, b = h[order], g[order]
        same, equal = a[1:] == a[:-1], b[1:] == b[:-1]
    return order, np.r_[True, ~(same & equal)][: len(h)]


def _flush(h: np.ndarray, g: np.ndarray, shard: np.ndarray, shards: int, buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    """Rows (to, report, data): a bucket's hashes with shards (none: no answer is due), or reports, by way of any bucket."""
    order, new = _sorted(h, g)
    h, g, shard = h[order], g[order], shard[order]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(h)])
    asks = np.where(count == 1, shard[first], shards)
    own, more = h[first], g[first]
    cut = np.searchsorted(packed.bucket_of(own, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[b], cut[b + 1])
        yield b, False, packed.pack(own[s], more[s], asks[s])
    often = np.repeat(count > 1, count)
    for s, data in _reports(h[often], g[often], shard[often]):
        yield s % buckets, True, data


def _reports(h: np.ndarray, g: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Distinct windows for each shard; the data carries the shard in its first bytes."""
    if not len(h):
        return
    order = np.lexsort((g, h, shard))
    h, g, shard = h[order], g[order], shard[order]
    start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(start, [*start[1:], len(h)], strict=True):
        own, more = h[a:b], g[a:b]
        new = np.r_[True, (own[1:] != own[:-1]) | (more[1:] != more[:-1])]
        yield int(shard[a]), int(shard[a]).to_bytes(8, "little") + packed.pack(own[new], more[new])


def _windows(n: int, shards: int, buckets: int, flush: int, mask: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, gs, ss, total = [], [], [], 0

        def out() -> pa.RecordBatch:
            rows = list(_flush(np.concatenate(hs), np.concatenate(gs), np.concatenate(ss), shards, buckets))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "report", "data"])

        for batch in batches:
            data, bounds = buffers(batch["text"])
            shard = batch["shard"].to_numpy(zero_copy_only=False)
            for i, j in runs(bounds):
                w = scan(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                h, g, at = window_hashes(w.hashes(), w, n, mask)
                hs.append(h)
                gs.append(g)
                ss.append(shard[i + w.doc[at]])
                total += len(h)
                if total >= flush:
                    yield out()
                    hs, gs, ss, total = [], [], [], 0
        if total:
            yield out()

    return run


def _meet(shards: int):
    """Of a bucket's rows: reports pass through, and windows of several rows are reported to those who ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, gs, asks = [], [], []
        for batch in batches:
            to, passed = [], []
            for report, data in zip(batch["report"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if report:
                    to.append(int.from_bytes(data[:8], "little"))
                    passed.append(data)
                else:
                    h, g, s = packed.unpack(data)
                    hs.append(h)
                    gs.append(g.astype(np.uint16))
                    asks.append(s.astype(np.int64))
            if to:
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(passed, pa.binary())], ["shard", "found"])
        if hs:
            h, g, s = np.concatenate(hs), np.concatenate(gs), np.concatenate(asks)
            order, new = _sorted(h, g)
            h, g, s = h[order], g[order], s[order]
            due = ~(new & np.r_[new[1:], True]) & (s < shards)
            rows = list(_reports(h[due], g[due], s[due]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "found"])

    return run


def _among(h: np.ndarray, g: np.ndarray, known_h: np.ndarray, known_g: np.ndarray) -> np.ndarray:
    """Which windows are among the known ones, whose first hashes ascend."""
    out = np.zeros(len(h), bool)
    if not len(known_h):
        return out
    first = np.flatnonzero(np.r_[True, known_h[1:] != known_h[:-1]])
    at = np.searchsorted(known_h, h)
    for step in range(int(np.diff(np.r_[first, len(known_h)]).max())):
        k = np.minimum(at + step, len(known_h) - 1)
        out |= (known_h[k] == h) & (known_g[k] == g)
    return out


def covered(word_hash: np.ndarray, first: np.ndarray, name: np.ndarray, at: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Which words of a shard lie in an occurrence of a recurring window.

    first: of each document's words, one more than documents; name, at: hashes and first
    words of the windows that recur.
    """
    count = len(word_hash)
    if not len(at):
        return np.zeros(count, bool)
    tile = (n + 1) // 2
    _, one = np.unique(name, return_index=True)
    start = np.sort(at[one])
    # passages: runs of consecutive first places
    split = np.flatnonzero(np.diff(start) != 1) + 1
    begin, stop = start[np.r_[0, split]], start[np.r_[split - 1, len(start) - 1]] + n
    per = (stop - begin - tile) // tile + 1
    passage = np.repeat(np.arange(len(begin)), per)
    tile_at = begin[passage] + tile * (np.arange(len(passage)) - np.repeat(np.cumsum(per) - per, per))
    _, number = np.unique(word_hash, return_inverse=True)
    doc_of = np.searchsorted(first[1:], np.arange(count), "right")
    # a word is DIGITS letters, each place with letters of its own, as an automaton's state is slow with many ways on
    letters = np.stack([(number // BASE**k) % BASE + k * BASE + 1 for k in range(DIGITS)], axis=1).astype("<u4").ravel()
    stream = np.insert(letters, first[1:-1] * DIGITS, 0).tobytes().decode("utf-32-le")
    spot = np.arange(count) * DIGITS + doc_of  # a zero stands before each document but the first
    known: dict[str, int] = {}
    member = np.empty(len(tile_at), np.int64)
    for k, q in enumerate(spot[tile_at].tolist()):
        member[k] = known.setdefault(stream[q : q + tile * DIGITS], len(known))
    machine = ahocorasick.Automaton()
    for s, k in known.items():
        machine.add_word(s, k)
    machine.make_automaton()
    by_tile = np.argsort(member, kind="stable")
    low = np.searchsorted(member[by_tile], np.arange(len(known) + 1))
    up, down = powers(_STEP, count + 1)
    total = np.zeros(count + 1, U)
    np.cumsum(word_hash * up[:count], out=total[1:])

    def equal(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (total[x + size] - total[x]) * down[x] == (total[y + size] - total[y]) * down[y]

    def agree(x: np.ndarray, y: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
        """Words from x and y on (or before them) that are equal, up to most."""
        lo, hi = np.zeros(len(x), np.int64), most.copy()
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi + 1) // 2, lo)
            ok = equal(x, y, mid) if ahead else equal(x - mid, y - mid, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    cover = np.zeros(count + 1, np.int64)

    def extend(ends: list[int], tiles: list[int]) -> None:
        t = np.array(tiles)
        q = np.searchsorted(spot, np.array(ends) - tile * DIGITS + 1)
        many = low[t + 1] - low[t]
        q = np.repeat(q, many)
        k = by_tile[np.repeat(low[t], many) + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)]
        p, own = tile_at[k], passage[k]
        left = agree(q, p, np.minimum(p - begin[own], q - first[doc_of[q]]), False)
        right = agree(q, p, np.minimum(stop[own] - p, first[doc_of[q] + 1] - q), True)
        whole = left + right >= n
        np.add.at(cover, (q - left)[whole], 1)
        np.add.at(cover, (q + right)[whole], -1)

    ends, tiles = [], []
    for end, k in machine.iter(stream):
        ends.append(end)
        tiles.append(k)
        if len(ends) >= 1 << 16:
            extend(ends, tiles)
            ends, tiles = [], []
    if ends:
        extend(ends, tiles)
    return np.cumsum(cover[:-1]) > 0


def _cut(n: int, names: list[str], mask: int):
    """A shard's documents and reports: documents without their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, found = [], []
        for batch in batches:
            data = batch["found"]
            is_doc = np.asarray(data.is_null().to_numpy(zero_copy_only=False))
            found += [packed.unpack(x[8:]) for x in data.to_pylist() if x is not None]
            docs.append(batch.select(names).filter(pa.array(is_doc)))
        known_h, known_g = np.concatenate([np.zeros(0, U), *[f[0] for f in found]]), np.concatenate([np.zeros(0, np.uint16), *[f[1].astype(np.uint16) for f in found]])
        order, new = _sorted(known_h, known_g)
        known_h, known_g = known_h[order][new], known_g[order][new]
        rows = pa.Table.from_batches(docs) if docs else None
        if rows is None or not len(rows):
            return
        data, bounds = buffers(rows["text"])
        hs, firsts, gs, ats, spans = [], [np.zeros(1, np.int64)], [], [], []
        words = 0
        for i, j in runs(bounds):
            w = scan(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            h = w.hashes()
            g, more, at = window_hashes(h, w, n, mask)
            hit = _among(g, more, known_h, known_g)
            hs.append(h)
            gs.append(g[hit] ^ mix(more[hit].astype(U)))
            ats.append(at[hit] + words)
            firsts.append(w.first[1:] + words)
            spans.append(w.start + bounds[i])
            words += len(h)
        first = np.concatenate(firsts)
        start = np.concatenate(spans)
        gone = covered(np.concatenate(hs), first, np.concatenate(gs), np.concatenate(ats), n)
        removed = np.concatenate([[0], np.cumsum(gone)])[first]
        removed = np.diff(removed)
        texts, raw = [], data.tobytes()
        for d in range(len(rows)):
            a, b = first[d], first[d + 1]
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            if not removed[d]:
                texts.append(raw[lo:hi].decode())
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False].astype(np.int8)))
            cuts = np.append(start[a:b], hi)[edge].tolist()
            kept, at = [], lo
            for x, y in zip(cuts[::2], cuts[1::2], strict=True):
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:hi])
            texts.append(b"".join(kept).decode())
        k = rows.schema.get_field_index("text")
        rows = rows.set_column(k, "text", pa.array(texts, rows.schema.field(k).type))
        rows = rows.append_column("n_words", pa.array(np.diff(first))).append_column("n_removed", pa.array(removed.astype(np.int64)))
        yield from rows.combine_chunks().to_batches(max_chunksize=2000)

    return run


def remove_repeats(docs: DataFrame, n: int = WINDOW, task_bytes: int = SHARD_BYTES, mask: int = FULL) -> DataFrame:
    """All columns of docs, text without the words of recurring windows, n_words before and n_removed behind them.

    What stays keeps its own white space. A null text becomes empty; documents of fewer
    than n words, and those where nothing recurs, keep their text as it is. Rows that
    repeat are copies of each other. Columns of docs named n_words or n_removed are
    replaced, others may have any names. An empty table gives no rows. mask: the bits
    used of windows' first hashes, for tests.
    """
    docs = docs.drop("n_words", "n_removed")
    columns = docs.columns
    rows = tables.apart(docs).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    names = rows.columns
    size = tables.text_bytes(rows)
    shards = buckets = tables.tasks_for(size, task_bytes)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    asked = rows.select("text", "shard").mapInArrow(_windows(n, shards, buckets, int(FLUSH * tables.grown(size)), mask), "bucket int, report boolean, data binary")
    reports = tables.deal(asked, buckets, "bucket").select("report", "data").mapInArrow(_meet(shards), "shard int, found binary")
    both = rows.withColumn("found", F.lit(None).cast("binary")).unionByName(reports, allowMissingColumns=True)
    out = tables.with_columns(rows.select(names).schema, [("n_words", "long"), ("n_removed", "long")])
    made = tables.deal(both, shards, "shard").mapInArrow(_cut(n, names, mask), out)
    return tables.together(made, columns, "n_words", "n_removed")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [hashlib.sha256(b" ".join(x.encode().split())).hexdigest() for x in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_words"], b["n_removed"], pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def op6_repeat_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
