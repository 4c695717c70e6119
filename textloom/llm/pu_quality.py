"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good; the unlabelled set is a sample of all
documents that grows with their number. The class prior p is estimated from the unlabelled
ones: a first fit on half of the positives tells how many of them, and of the other half,
lie beyond a cut, and where no negatives are left the ratio of these shares is the prior.
With logistic loss l and a linear model g, training
minimises p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]); while the second
term is negative a step goes the other way, so that the fit cannot push it below zero.
Features are rates of pairs of byte classes (small and capital letters, digits,
blanks, line feeds, single marks ...) and of repeated words over the whole text; labels, lang,
source and doc_id are no features. The score is the model's probability of label 1,
mapped by a monotone fit on the labelled training rows: the slope is Platt's, and the
shift puts ACCEPT where the labels part best, letting KEEP_GOOD of the good rows in at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .wordscan import buffers, runs, scan

#: Labelled rows used at most. Unlabelled rows used: so many up to GROWS_FROM documents, then more with the cube root of their number.
SAMPLE, UNLABELLED, GROWS_FROM = 4_000, 8_000, 250_000
FOLDS, HELD_OUT, ACCEPT, KEEP_GOOD = 4, 2, 0.7, 0.99
EPOCHS, RATE, DECAY, BATCH, SEED = 40, 0.005, 1e-2, 512, 5
_MARKS = b".,;:!?'\"-()[]{}/\\|#*$%&<>@=_+~^`"


def _classes() -> np.ndarray:
    k = np.zeros(256, np.int64)
    k[128:] = 1
    k[97:123], k[65:91], k[48:58] = 2, 3, 4
    k[[32, 9, 11, 12, 13]], k[10] = 5, 6
    for i, c in enumerate(_MARKS):
        k[c] = 7 + i
    return k


CLASS = _classes()
CLASSES = int(CLASS.max()) + 1
WIDTH = CLASSES * CLASSES + CLASSES + 4


def features(arr: pa.Array) -> np.ndarray:
    """Square roots of rates of class pairs, of classes, and of words equal to the one or two before; mean word length; whether there is a word."""
    data, bounds = buffers(arr)
    out = np.zeros((len(bounds) - 1, WIDTH), np.float32)
    for i, j in runs(bounds, 1 << 20):
        own, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        n = j - i
        k = CLASS[own]
        owner = np.repeat(np.arange(n), np.diff(at))
        one = np.bincount(owner * CLASSES + k, minlength=n * CLASSES).reshape(n, CLASSES)
        pair = owner[:-1] * CLASSES**2 + k[:-1] * CLASSES + k[1:]
        two = np.bincount(pair[owner[:-1] == owner[1:]], minlength=n * CLASSES**2).reshape(n, -1)
        size = np.maximum(np.diff(at), 1)[:, None]
        w = scan(own, at)
        chars = np.bincount(w.doc, weights=w.end - w.start, minlength=n)
        mean = chars / np.maximum(w.counts, 1)
        h = w.hashes()
        near = [np.bincount(w.doc[k:][(h[k:] == h[:-k]) & (w.doc[k:] == w.doc[:-k])], minlength=n) / np.maximum(w.counts, 1) for k in (1, 2)]
        out[i:j] = np.concatenate([np.sqrt(two / size), np.sqrt(one / size), np.log1p(mean)[:, None], np.sqrt(near).T, (w.counts > 0)[:, None]], axis=1)
    return out


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * self.margin(x) + self.shift, -60, 60)
        return 1 / (1 + np.exp(-z))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Non-negative unbiased risk, by Adam over paired batches. Constant features keep weight zero."""
    pos, unl = (x.astype(np.float32, copy=False) for x in (pos, unl))
    both = np.concatenate([pos, unl])
    mean, sd = both.mean(axis=0, dtype=np.float64), both.std(axis=0, dtype=np.float64)
    unit = np.where(sd > 1e-4, 1 / np.maximum(sd, 1e-4), 0.0)
    live = np.flatnonzero(unit)
    p, u = (np.clip((x[:, live] - mean[live].astype(np.float32)) * unit[live].astype(np.float32), -8, 8) for x in (pos, unl))
    rng = np.random.default_rng(seed)
    w = np.zeros(p.shape[1] + 1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    p, u = (np.c_[x, np.ones(len(x), np.float32)] for x in (p, u))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for i in range(0, len(u), BATCH):
            xu, xp = u[order[i : i + BATCH]], p[rng.integers(0, len(p), BATCH)]
            zu, zp = xu @ w, xp @ w
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            of_rest = xu.T @ sig(zu) / len(zu) - prior * (xp.T @ sig(zp)) / len(zp)
            if rest < 0:
                g = -of_rest
            else:
                g = of_rest - prior * (xp.T @ sig(-zp)) / len(zp)
            g = g + DECAY * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weight = np.zeros(len(mean))
    weight[live] = w[:-1] * unit[live]
    return Model(weight, float(w[-1] - mean @ weight))


def class_prior(pos: np.ndarray, unl: np.ndarray, first: float = 0.5) -> float:
    """The least ratio of the shares of unlabelled rows and of fresh positives beyond a cut that at least half of these pass."""
    half = np.arange(len(pos)) % 2 == 0
    if half.all() or not half.any():
        return first
    model = train(pos[half], unl, first)
    known, free = np.sort(model.margin(pos[~half])), np.sort(model.margin(unl))
    cut = np.unique(np.quantile(known, np.linspace(0.01, 0.5, 50)))
    share = [1 - np.searchsorted(x, cut) / len(x) for x in (free, known)]
    return float(min(max((share[0] / np.maximum(share[1], 1e-9)).min(), 0.05), 0.98))


def platt(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Slope (kept positive) by logistic fit to the labels, shift by the good rows; unchanged without both labels."""
    if len(np.unique(y)) < 2:
        return model
    z = model.margin(x)
    scale = max(float(np.std(z)), 1e-9)
    z = z / scale
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        d, h = q - y, np.maximum(q * (1 - q), 1e-6)
        grad = np.array([(d * z).mean() + 1e-3 * (a - 1), d.mean()])
        hess = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(a - step[0], 1e-3), b - step[1]
    # the accepted side starts where the labels part best, with KEEP_GOOD of the good rows let in at least
    good, bad = np.sort(z[y == 1]), np.sort(z[y == 0])
    tried = np.unique(z[z <= np.quantile(good, 1 - KEEP_GOOD)])
    lost, let_in = np.searchsorted(good, tried) / len(good), 1 - np.searchsorted(bad, tried) / len(bad)
    least = float(tried[len(tried) - 1 - np.argmin((lost + let_in)[::-1])])
    return Model(model.weight, model.bias, a / scale, float(np.log(ACCEPT / (1 - ACCEPT))) - a * least)


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features packed: which are not zero, and their values."""
    for b in batches:
        for i in range(0, len(b), 500):
            part = b.slice(i, 500)
            found = [np.packbits(x != 0).tobytes() + x[x != 0].tobytes() for x in features(part["text"])]
            yield pa.RecordBatch.from_arrays([part["quality"], pa.array(found, pa.binary())], ["quality", "x"])


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out, head = np.zeros((len(rows), WIDTH), np.float32), -(-WIDTH // 8)
    for i, data in enumerate(rows):
        out[i, np.unpackbits(np.frombuffer(data, np.uint8, head), count=WIDTH).astype(bool)] = np.frombuffer(data[head:], np.float32)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model | None:
    """None without a trusted positive. Rows of the held-out fold are left out on both sides.

    The labelled sample has the rows with the least hash of doc_id, the unlabelled one those whose
    hash lies below a bound, both in the order of a hash, so a rerun gives the same model.
    """
    rows = tables.texts(docs).where("doc_id is not null").where(~held_out())
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    own = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    marked = rows.join(F.broadcast(own.orderBy(*order).limit(sample)), "doc_id")  # at most the sample, two numbers a row
    n = rows.select("doc_id").count()
    share = min(1.0, unlabelled * max(1.0, (n / GROWS_FROM) ** (1 / 3)) / max(n, 1))
    free = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("quality", F.lit(-1))
    chosen = marked.unionByName(free).orderBy(*order, "quality", "text")
    got = chosen.select("quality", "text").mapInArrow(_vectors, "quality int, x binary").toArrow()
    x, y = _unpacked(got["x"].to_pylist()), got["quality"].to_numpy()
    pos, unl, known = x[y == 1], x[y == -1], y >= 0
    if not len(pos) or not len(unl):
        return None
    return platt(train(pos, unl, class_prior(pos, unl)), x[known], (y[known] == 1).astype(float))


def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * self.margin(x) + self.shift, -60, 60)
        return 1 / (1 + np.exp(-z))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Non-negative unbiased risk, by Adam over paired batches. Constant features keep weight zero."""
    pos, unl = (x.astype(np.float32, copy=False) for x in (pos, unl))
    both = np.concatenate([pos, unl])
    mean, sd = both.mean(axis=0, dtype=np.float64), both.std(axis=0, dtype=np.float64)
    unit = np.where(sd > 1e-4, 1 / np.maximum(sd, 1e-4), 0.0)
    live = np.flatnonzero(unit)
    p, u = (np.clip((x[:, live] - mean[live].astype(np.float32)) * unit[live].astype(np.float32), -8, 8) for x in (pos, unl))
    rng = np.random.default_rng(seed)
    w = np.zeros(p.shape[1] + 1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    p, u = (np.c_[x, np.ones(len(x), np.float32)] for x in (p, u))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for i in range(0, len(u), BATCH):
            xu, xp = u[order[i : i + BATCH]], p[rng.integers(0, len(p), BATCH)]
            zu, zp = xu @ w, xp @ w
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            of_rest = xu.T @ sig(zu) / len(zu) - prior * (xp.T @ sig(zp)) / len(zp)
            if rest < 0:
                g = -of_rest
            else:
                g = of_rest - prior * (xp.T @ sig(-zp)) / len(zp)
            g = g + DECAY * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weight = np.zeros(len(mean))
    weight[live] = w[:-1] * unit[live]
    return Model(weight, float(w[-1] - mean @ weight))


def class_prior(pos: np.ndarray, unl: np.ndarray, first: float = 0.5) -> float:
    """The least ratio of the shares of unlabelled rows and of fresh positives beyond a cut that at least half of these pass."""
    half = np.arange(len(pos)) % 2 == 0
    if half.all() or not half.any():
        return first
    model = train(pos[half], unl, first)
    known, free = np.sort(model.margin(pos[~half])), np.sort(model.margin(unl))
    cut = np.unique(np.quantile(known, np.linspace(0.01, 0.5, 50)))
    share = [1 - np.searchsorted(x, cut) / len(x) for x in (free, known)]
    return float(min(max((share[0] / np.maximum(share[1], 1e-9)).min(), 0.05), 0.98))


def platt(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Slope (kept positive) by logistic fit to the labels, shift by the good rows; unchanged without both labels."""
    if len(np.unique(y)) < 2:
        return model
    z = model.margin(x)
    scale = max(float(np.std(z)), 1e-9)
    z = z / scale
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        d, h = q - y, np.maximum(q * (1 - q), 1e-6)
        grad = np.array([(d * z).mean() + 1e-3 * (a - 1), d.mean()])
        hess = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-9]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(a - step[0], 1e-3), b - step[1]
    # the accepted side starts where the labels part best, with KEEP_GOOD of the good rows let in at least
    good, bad = np.sort(z[y == 1]), np.sort(z[y == 0])
    tried = np.unique(z[z <= np.quantile(good, 1 - KEEP_GOOD)])
    lost, let_in = np.searchsorted(good, tried) / len(good), 1 - np.searchsorted(bad, tried) / len(bad)
    least = float(tried[len(tried) - 1 - np.argmin((lost + let_in)[::-1])])
    return Model(model.weight, model.bias, a / scale, float(np.log(ACCEPT / (1 - ACCEPT))) - a * least)


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), 500):
            part = b.slice(i, 500)
            yield pa.RecordBatch.from_arrays([part["quality"], pa.array([x.tobytes() for x in features(part["text"])], pa.binary())], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """None without a trusted positive. Rows of the held-out fold are left out on both sides.

    Each sample has the rows with the least hash of doc_id, in that order, so a rerun gives
    the same model. The class prior is the share of good rows among the labelled ones.
    """
    rows = tables.texts(docs).where("doc_id is not null").where(~held_out())
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    own = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    marked = own.orderBy(*order).limit(sample)
    free = rows.select("doc_id").orderBy(*order).limit(sample).distinct().withColumn("quality", F.lit(-1))
    # at most twice the sample, two numbers a row
    chosen = rows.join(F.broadcast(marked.unionByName(free)), "doc_id").orderBy(*order, "quality", "text")
    got = chosen.select("quality", "text").mapInArrow(_vectors, "quality int, x binary").collect()
    x = np.empty((len(got), WIDTH), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r["x"], np.float32)
    y = np.array([r["quality"] for r in got])
    del got
    pos, unl, known = x[y == 1], x[y == -1], y >= 0
    if not len(pos) or not len(unl):
        return None
    prior = min(max(float((y[known] == 1).mean()), 0.05), 0.98)
    return platt(train(pos, unl, prior), x[known], (y[known] == 1).astype(float))


def score(docs: DataFrame, model: Model | None, accept: float = ACCEPT) -> DataFrame:
    """All columns of docs with score and predicted behind them (columns of docs so named are replaced).

    A null text is empty; an empty text is scored by its features, which are all zero.
    Without a model every score is 0.5. Equal texts get equal scores.
    """
    docs = docs.drop("score", "predicted")
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.slice(i, 2000)
                x = features(part.column(text))
                s = model.score(x.astype(np.float64)) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= accept).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, tables.with_columns(docs.schema, [("score", "double"), ("predicted", "integer")]))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, tables.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
