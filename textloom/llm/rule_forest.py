"""Quality rules: an isolation forest over rule statistics.

Statistics of each whole text are counted exactly. A forest of random splits is grown:
each tree draws TREE_ROWS rows of its own, as the method has it, from all rows labelled
good; the score of a document is 2^(-mean path length / expected length), so documents
that random splits isolate early score high. The threshold is set on all labelled rows: of
the multiples of 1 / CELLS that at least KEEP_GOOD of the good rows stay under, the one
that separates the labels best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import tables
from .wordscan import IS_SPACE, U, buffers, grams, mix, runs, scan, span_hashes

TREES, TREE_ROWS, KEEP_GOOD, SEED = 128, 256, 0.995, 7
#: Scores are counted by cells of this width's inverse, so that the driver holds no row of the input.
CELLS = 1 << 18
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = np.isin(np.arange(256), list(b"!?\"'()[]{}/\\:;_=+~^@`"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_types")
#: Features of a document.
WIDTH = 7
MADE = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("rule_score", "double")]


def _again(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values with an owner: which are found twice or more; which repeat an earlier one."""
    key = mix(h + owner.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    often[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return often, later


def statistics(arr: pa.Array) -> np.ndarray:
    """A row of COUNTS for each whole text."""
    data, bounds = buffers(arr)
    out = np.zeros((len(bounds) - 1, len(COUNTS)), np.int64)
    for i, j in runs(bounds):
        own = data[bounds[i] : bounds[j]]
        at = bounds[i : j + 1] - bounds[i]
        w = scan(own, at)
        n = j - i

        def per_doc(flags: np.ndarray, at=at) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[at[1:]] - total[at[:-1]]

        h = w.hashes()
        g, first = grams(h, w, 3)
        often, _ = _again(w.doc[first], g)
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, first[often], 1)
        np.add.at(cover, first[often] + 3, -1)
        repeated = np.cumsum(cover[:-1]) > 0
        _, known = _again(w.doc, h)
        # lines: from a document's start or behind a line feed
        feed = np.flatnonzero(own == 10)
        start = np.unique(np.concatenate([at[:-1], feed + 1]))
        start = start[start < len(own)]
        owner = np.searchsorted(at[1:], start, "right")
        stop = np.minimum(np.append(start[1:], len(own)), at[1:][owner])
        stop = stop - ((stop > start) & (own[stop - 1] == 10))
        solid = np.concatenate([[0], np.cumsum(~IS_SPACE[own])])
        real = solid[stop] > solid[start]
        start, stop, owner = start[real], stop[real], owner[real]
        _, dup = _again(owner, span_hashes(own, start, stop))
        out[i:j] = np.stack([
            w.counts, per_doc(~IS_SPACE[own] & ((own & 0xC0) != 0x80)), per_doc(_SYMBOL[own]), np.bincount(owner[dup], minlength=n), np.bincount(w.doc[repeated], minlength=n),
            per_doc(_UPPER[own]), per_doc(_DIGIT[own]), per_doc(_MARK[own]), np.bincount(owner, minlength=n), w.counts - np.bincount(w.doc[known], minlength=n),
        ], axis=1)
    return out


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeat = counts[:, 0], counts[:, 4]
    return (words < 50) | (100 * repeat > 50 * words)


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of rates, so that small ones are told apart."""
    c = counts.astype(np.float64)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 8], 1)
    return np.sqrt(np.stack([c[:, 1] / words, c[:, 2] / chars, c[:, 3] / lines, c[:, 4] / words, c[:, 5] / chars, c[:, 6] / chars, c[:, 7] / chars], axis=1))


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, left child, and path length with the leaf's share."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, k, n in zip(self.feature, self.cut, self.child, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := f[node] >= 0).any():
                node = np.where(inner, k[node] + (x[rows, np.maximum(f[node], 0)] >= c[node]), node)
            total += n[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n < 2:
        return 0.0
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, spread: np.ndarray | None = None, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Trees of random splits. Cuts may fall outside the rows of a node, by up to half the spread of each
    feature over a wider sample: what lies out there then falls on an empty side, after a short path."""
    rng = np.random.default_rng(seed)
    size = min(rows, len(x))
    return _grown((x[rng.choice(len(x), size, replace=False)] for _ in range(trees)), size, np.ptp(x, axis=0) if spread is None else spread, rng)


def _grown(drawn: Iterable[np.ndarray], size: int, spread: np.ndarray, rng: np.random.Generator) -> Forest:
    """A tree for each drawn set of rows."""
    deep = int(np.ceil(np.log2(max(size, 2))))
    pad = 0.5 * spread
    found = []
    for rows in drawn:
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0, np.full(rows.shape[1], -np.inf), np.full(rows.shape[1], np.inf))]
        while todo:
            at, own, depth, floor, roof = todo.pop()
            nodes[at][3] = depth + _expected(len(own))
            if depth >= deep or len(own) < 2:
                continue
            low, high = np.maximum(own.min(axis=0) - pad, floor), np.minimum(own.max(axis=0) + pad, roof)
            wide = np.flatnonzero(high > low)
            if not len(wide):
                continue
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            nodes[at][:3] = [f, cut, len(nodes)]
            side = own[:, f] >= cut
            under, over = roof.copy(), floor.copy()
            under[f] = over[f] = cut
            todo += [(len(nodes), own[~side], depth + 1, floor, under), (len(nodes) + 1, own[side], depth + 1, over, roof)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        found.append(nodes)
    full = np.zeros((len(found), max(map(len, found)), 4))
    full[:, :, 0] = -1
    for k, nodes in enumerate(found):
        full[k, : len(nodes)] = nodes
    return Forest(full[:, :, 0].astype(np.int64), full[:, :, 1], full[:, :, 2].astype(np.int64), full[:, :, 3], max(_expected(size), 1.0))


def calibrate(cell: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut that keeps KEEP_GOOD of the good rows at least and tells the labels apart best, from rows of each label by cell."""
    order = np.argsort(cell)
    cell, good, bad = cell[order], good[order], bad[order]
    kept, let = np.cumsum(good), np.cumsum(bad)
    over = (bad.sum() - let) / max(bad.sum(), 1) - (good.sum() - kept) / good.sum()
    least = int(np.searchsorted(kept, KEEP_GOOD * good.sum()))
    return float(cell[least + int(np.argmax(over[least:]))]) / CELLS


def count(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics (COUNTS) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], _listed(statistics(b["text"]))], ["doc_id", "counts"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, tables.with_columns(docs.select("doc_id").schema, [("counts", ArrayType(LongType()))]))


def _listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(COUNTS)), pa.array(rows.ravel()))


def _counts(b: pa.RecordBatch) -> np.ndarray:
    return b["counts"].flatten().to_numpy().reshape(len(b), len(COUNTS))


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            x, good = features(_counts(b)), b["good"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pylist([{"good": int(good.sum()), "bad": int((~good).sum())} | {f"low{k}": v for k, v in enumerate(x.min(axis=0))} | {f"high{k}": v for k, v in enumerate(x.max(axis=0))}])


def _draw(known: DataFrame, n: int) -> list[np.ndarray]:
    """For each tree, the features of the TREE_ROWS of n good rows that have its least hashes."""
    size, share = min(TREE_ROWS, n), (TREE_ROWS + 12 * TREE_ROWS**0.5) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, TREES + 1, dtype=U) + (U(SEED) << U(32)))
        most = U(min(int(share * 2**64), 2**64 - 1))
        for b in batches:
            key, x = b["key"].to_numpy().view(U), features(_counts(b))
            for i in range(0, len(key), 2048):
                h = mix(key[i : i + 2048, None] ^ salt)
                row, tree = np.nonzero(h <= most)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(h[row, tree].view(np.int64)), *(pa.array(x[i + row, k]) for k in range(x.shape[1]))], ["tree", "hash", *(f"x{k}" for k in range(x.shape[1]))])

    while True:
        got = known.where("good").mapInArrow(run, "tree long, hash long, " + ", ".join(f"x{k} double" for k in range(WIDTH))).toArrow()
        tree, h = got["tree"].to_numpy(), got["hash"].to_numpy().view(U)
        if np.bincount(tree, minlength=TREES).min() >= size:
            break
        share *= 2  # so few hashes below the share are next to impossible
    x = np.stack([got[f"x{k}"].to_numpy() for k in range(WIDTH)], axis=1)
    order = np.lexsort((h, tree))
    first = np.searchsorted(tree[order], np.arange(TREES))
    return [x[order[a : a + size]] for a in first]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Forest | None:
    """None without good rows. All labelled rows count, repeated ones once."""
    return fit_counted(count(tables.texts(docs)), labels)


def fit_counted(counted: DataFrame, labels: DataFrame) -> Forest | None:
    """As fit, from rows (doc_id, counts)."""
    own = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(F.col("quality").cast("int")) == 1).alias("good"))
    passed = counted.select(F.col("doc_id").cast("long").alias("doc_id"), "counts").where("counts[0] >= 50 and 100 * counts[4] <= 50 * counts[0]")
    known = tables.keep(passed.join(own, "doc_id").distinct().select(F.xxhash64("doc_id", "counts").alias("key"), "good", "counts"))
    edges = [f"{e}{k}" for e in ("low", "high") for k in range(WIDTH)]
    extent = known.mapInArrow(_extent, "good long, bad long, " + ", ".join(f"{e} double" for e in edges)).agg(F.sum("good").alias("good"), *(F.min(e) if e[0] == "l" else F.max(e) for e in edges)).first()
    if not extent["good"]:
        return None
    low, high = np.array(extent[1:]).reshape(2, WIDTH)
    forest = _grown(_draw(known, extent["good"]), min(TREE_ROWS, extent["good"]), high - low, np.random.default_rng(SEED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.ceil(forest.score(features(_counts(b))) * CELLS).astype(np.int64)), b["good"]], ["cell", "good"])

    cells = known.mapInArrow(run, "cell long, good boolean").groupBy("cell").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toArrow()
    forest.threshold = calibrate(*(cells[c].to_numpy() for c in ("cell", "good", "bad")))
    return forest


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """All columns of docs, with the statistics, the forest's score, base_failed and kept behind them.

    A null or empty text has no words and fails. Without a forest, kept is what the base
    rules keep. Equal texts get equal verdicts. Columns of docs with one of the names made here are replaced.
    """
    docs = docs.drop(*[n for n, _ in MADE])
    text = docs.columns.index("text")
    return _judged(docs, forest, lambda b: statistics(b.column(text)))


def _judged(rows: DataFrame, forest: Forest | None, counts_of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = counts_of(b)
            failed = base_failed(counts)
            score = forest.score(features(counts)) if forest else np.zeros(len(counts))
            kept = ~failed & (score <= (forest.threshold if forest else np.inf))
            new = [pa.array(counts[:, k]) for k in range(5)] + [pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *[n for n, _ in MADE]])

    return rows.mapInArrow(run, tables.with_columns(rows.schema, MADE))


def op7_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tables.keep(count(tables.table(spark, sf_dir, "documents")))  # texts are read once
    found = _judged(counted, fit_counted(counted, tables.table(spark, sf_dir, "labels")), _counts)
    return found.select("doc_id", *[n for n, _ in MADE])
