"""SimHash near-duplicate groups with a Gray-order hierarchical index.

Fingerprints: 64 bits over runs of three words. Distinct fingerprints that differ in
at most two bits are linked: of four blocks of 16 bits at least two are equal, so
candidates meet under one of six keys. A key with more than MOST_IN_GROUP
fingerprints is split by thirds of its free bits, one of which must be equal as
well, at most twice; that leaves at most 2^15 in a group. Another limit of bits takes two
blocks more than the limit, and parts one more than it. Each group is sorted by Gray
rank and searched through a tree whose upper nodes hold the bits that all below
share; differences add up on the way down, and a node over the limit is left out
with all below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from .components import components, local_forest
from .wordscan import U, buffers, runs, scan

SHINGLE, SEED, MOST_BITS, MOST_IN_GROUP, FAN = 3, 42, 2, 4096, 8
FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(mask: int, n: int) -> list[int]:
    """The mask with one of n parts of its free bits added, in n ways."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [len(free) * i // n for i in range(n + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def levels(most: int = MOST_BITS) -> list[list[int]]:
    """Masks under which fingerprints of at most so many differing bits meet, and those that split crowded keys."""
    first = [x | y for x, y in combinations(_parts(0, most + 2), 2)]
    return [first, [m for x in first for m in _parts(x, most + 1)]]


def vote(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fingerprints (unsigned) of runs of hashes that begin at places: a bit is 1 if set in over half of them."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
    total = np.diff(np.r_[start, len(h)])
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(U)


def simhash(arr: pa.Array, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (unsigned) of whole texts."""
    data, bounds = buffers(arr)
    out = np.zeros(len(bounds) - 1, U)
    one = xxhash.xxh64_intdigest
    for i, j in runs(bounds):
        w = scan(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower=True)
        count = len(w.start)
        if not count:
            continue
        # one space behind each word, so that a run of words is a slice
        size = w.end - w.start
        to = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(to[-1], 32, np.uint8)
        inside = np.ones(to[-1], bool)
        inside[to[1:] - 1] = False
        word = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(word, w.start, 1)
        np.add.at(word, w.end, -1)
        joined[inside] = w.data[np.cumsum(word[:-1]).astype(bool)]
        last = w.first[1:][w.doc]
        first = np.flatnonzero((np.arange(count) + n <= last) | ((np.arange(count) == w.first[:-1][w.doc]) & (w.counts[w.doc] < n)))
        end = np.minimum(first + n, last[first])
        raw = joined.tobytes()
        h = np.array([one(raw[a:b], seed) for a, b in zip(to[first].tolist(), (to[end] - 1).tolist(), strict=True)], U)
        owner = w.doc[first]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[i + owner[start]] = vote(h, start)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(simhash(b["text"]).view(np.int64))], ["doc_id", "fp"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(s)
    return x


class GrayIndex:
    """A tree over fingerprints in Gray order; each node holds the bits its parent does not fix."""

    def __init__(self, prints: np.ndarray, fan: int = FAN):
        self.prints, self.fan = prints[np.argsort(gray_rank(prints), kind="stable")], fan
        pattern, shared = self.prints, np.full(len(prints), FULL, U)
        tree = [(pattern, shared)]
        while len(pattern) > fan:
            first = np.arange(0, len(pattern), fan)
            low = np.bitwise_and.reduceat(pattern & shared, first)
            high = np.bitwise_or.reduceat(pattern | ~shared, first)
            shared = ~(low ^ high)  # one in all, or zero in all
            pattern = low & shared
            tree.append((pattern, shared))
        self.levels = []
        for k, (pattern, shared) in enumerate(tree):
            above = tree[k + 1][1][np.arange(len(shared)) // fan] if k + 1 < len(tree) else np.zeros(len(shared), U)
            self.levels.append((pattern, shared & ~above))

    def search(self, queries: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of fingerprints within the limit."""
        pattern, own = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        far = np.zeros(len(q), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            pattern, own = self.levels[k]
            far = far + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            near = far <= most
            q, node, far = q[near], node[near], far[near]
            if k:
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                real = child < len(self.levels[k - 1][0])
                q, far, node = np.repeat(q, self.fan)[real], np.repeat(far, self.fan)[real], child[real]
        return q, node


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups: mask, value and fingerprint. A forest over the links between them."""
    got = [[b[c].to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp")] for b in batches]
    if not got:
        return
    mask, value, fp = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((gray_rank(fp.view(U)), value, mask))
    mask, value, fp = mask[order], value[order], fp[order].view(U)
    new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
    size = np.diff(np.r_[new, len(fp)])
    a, b = [np.zeros(0, U)], [np.zeros(0, U)]
    group = np.repeat(np.arange(len(new)), size)
    few = np.flatnonzero(size[group] <= FAN)  # such a group is one node
    for step in range(1, FAN):
        i = few[few + step < len(fp)]
        i = i[group[i] == group[i + step]]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= most]
        a.append(fp[i])
        b.append(fp[i + step])
    for g in np.flatnonzero(size > FAN):
        own = fp[new[g] : new[g] + size[g]]
        tree = GrayIndex(own)
        for k in range(0, len(own), 512):
            q, node = tree.search(own[k : k + 512], most)
            x, y = own[k + q], tree.prints[node]
            a.append(x[x > y])
            b.append(y[x > y])
            if sum(map(len, a)) > 1 << 20:
                x, y = local_forest(np.concatenate(a), np.concatenate(b))
                a, b = [x], [y]
    x, y = local_forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def _masks(column, masks: list[int]):
    return F.explode(F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.col(column).bitwiseAND(F.lit(_signed(m)).cast("long")).alias("value")) for m in masks]))


def links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Forest links (a, b) of distinct fingerprints in column fp: same components as all links of at most so many bits."""
    masks = levels(most)
    rows = prints.select("fp", _masks("fp", masks[0]).alias("k")).select("k.mask", "k.value", "fp")
    for level in masks:
        crowd = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > MOST_IN_GROUP).drop("n").withColumn("crowded", F.lit(True))
        next_masks = F.create_map(*[x for m in level for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(t)).cast("long") for t in _parts(m, most + 1)]))])
        marked = rows.join(crowd, ["mask", "value"], "left")
        to = F.when(F.col("crowded") & next_masks[F.col("mask")].isNotNull(), next_masks[F.col("mask")]).otherwise(F.array("mask"))
        rows = marked.select("fp", F.explode(to).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    return rows.repartition("mask", "value").mapInArrow(lambda batches: _links(batches, most), "a long, b long")


def _components(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of rows (doc_id, fp)."""
    nodes = tables.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id (least doc_id reachable) of each row.

    A null text is empty; texts without words have fingerprint zero, linked like any
    other. Repeated rows stay repeated. A null doc_id counts only where a component has
    no other. An empty table gives no rows; other columns are ignored.
    """
    rows = tables.keep(tables.texts(docs).mapInArrow(_fingerprints, "doc_id long, fp long"))
    return rows.join(_components(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, all columns: that of the least doc_id (null last; of its rows the least fingerprint and text).

    A group without any doc_id keeps one row for each fingerprint. Input as for group_documents; columns may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(simhash(b.column(1)).view(np.int64))], [*b.schema.names, "fp"])

    own = tables.apart(docs)
    marked = tables.keep(own.mapInArrow(run, tables.with_columns(own.schema, [("fp", "long")])))  # fingerprints are found once
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("place")
    rows = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "fp")
    named = rows.groupBy("fp").agg(F.min(place).alias("place")).join(_components(rows), "fp")
    heads = named.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(F.min(F.struct("place", "fp")).alias("head")).select("head.*")
    found = marked.withColumn("place", place).join(heads, ["place", "fp"], "left_semi")
    first = F.row_number().over(Window.partitionBy("place", "fp").orderBy("text"))
    return tables.together(found.withColumn("n", first).where("n = 1"), docs.columns)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(tables.table(spark, sf_dir, "documents"))
