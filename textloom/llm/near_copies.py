"""Near copies: texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash operator of `simhash_groups`, here over the sets and with
a limit of NEAR_BITS. At 0.8 fingerprints differ in 7 of 64 bits on average, and in more
for many pairs, too far to search without comparing most pairs. So that none of these is
lost, candidates also meet by MinHash: BANDS keys of ROWS minima each. A pair at 0.8 shares
no key with probability (1 - 0.8^5)^40 = 1.3e-7, a closer pair with less. Texts joined by
either form a cluster; in each, all pairs that can matter are compared by their exact sets.
A cluster of over BLOCK sets is worked on in blocks, so no task holds more than two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables
from .components import components, local_forest
from .simhash_groups import links, vote
from .wordscan import U, buffers, grams, mix, runs, scan

SHINGLE, BANDS, ROWS, BLOCK, NEAR_BITS = 5, 40, 5, 4096, 3
#: Similarity wanted, as a fraction.
OVER, UNDER = 4, 5
_FACTOR = mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)
_SHIFT = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) + U(1 << 32))


def shingles(arr: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts i to j: the text's place and the hash of each different run of n words, by place and hash.

    Letters of ASCII count as small ones. A text of fewer words has its whole sequence.
    """
    data, bounds = buffers(arr)
    for i, j in runs(bounds):
        w = scan(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower=True)
        h, at = grams(w.hashes(), w, n, short=True)
        owner = w.doc[at]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield i, j, i + owner[new], h[new]


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


def _name(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(h ^ U(0x5E7)), at) + np.diff(np.r_[at, len(h)]).astype(U))


def set_names(arr: pa.Array) -> np.ndarray:
    """A hash of each text's set; zero for texts without words."""
    out = np.zeros(len(arr), U)
    for _, _, owner, h in shingles(arr):
        if len(h):
            at = _starts(owner)
            out[owner[at]] = _name(h, at)
    return out


def _bands(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts with words, and a row of keys for each."""
    at = _starts(owner)
    keys = np.empty((len(at), BANDS), U)
    for b in range(BANDS):
        key = np.full(len(at), b + 1, U)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key + np.minimum.reduceat(h * _FACTOR[k] + _SHIFT[k], at))
        keys[:, b] = key
    return owner[at], keys


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b["text"]
        name, fp, size = np.zeros(len(text), U), np.zeros(len(text), U), np.zeros(len(text), np.int64)
        flat = []
        for _, _, owner, h in shingles(text):
            if len(h):
                at = _starts(owner)
                place, keys = _bands(owner, h)
                name[place], fp[place], size[place] = _name(h, at), vote(h, at), BANDS
                flat.append(keys.ravel())
        values = np.concatenate([np.zeros(0, U), *flat]).view(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays([b["place"], pa.array(name.view(np.int64)), pa.array(fp.view(np.int64)), keys], ["place", "name", "fp", "keys"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole keys: a forest over the sets that share one."""
    got = [[b[c].to_numpy() for c in ("key", "name")] for b in batches]
    if not got:
        return
    key, name = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(key, kind="stable")
    key, name = key[order], name[order]
    at = _starts(key)
    head = np.repeat(name[at], np.diff(np.r_[at, len(key)]))
    far = head != name
    x, y = local_forest(head[far], name[far])
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all members of some ranges."""
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def exact_groups(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For sets by owner (0, 1, ...; none empty): the first member of the component, of links at the similarity or over.

    A group grows from its first member. What is too far from that one to be near another
    member, by the triangle inequality of 1 - Jaccard, isn't compared with the other.
    """
    ids = np.unique(h, return_inverse=True)[1]
    first = _starts(owner)
    size = np.diff(np.r_[first, len(owner)])
    label = np.full(len(first), -1)
    mark = np.zeros(len(ids) and ids.max() + 1, bool)
    most = 1 - OVER / UNDER + 1e-9

    def shared(one: int, others: np.ndarray) -> np.ndarray:
        own = ids[first[one] : first[one] + size[one]]
        mark[own] = True
        n = np.add.reduceat(mark[ids[_ranges(first[others], size[others])]], np.r_[0, np.cumsum(size[others])[:-1]], dtype=np.int64)
        mark[own] = False
        return n

    left = np.arange(len(first))
    while len(left):
        root, left = left[0], left[1:]
        label[root] = root
        todo, apart = [(root, 0.0)], None
        while todo and len(left):
            one, at = todo.pop()
            look = np.arange(len(left)) if apart is None else np.flatnonzero(apart <= at + most)
            if not len(look):
                continue
            others = left[look]
            n = shared(one, others)
            if apart is None:
                apart = 1 - n / (size[one] + size[others] - n)
            near = n * (OVER + UNDER) >= OVER * (size[one] + size[others])
            label[others[near]] = root
            todo += zip(others[near].tolist(), apart[look[near]].tolist(), strict=True)
            stay = np.ones(len(left), bool)
            stay[look[near]] = False
            left, apart = left[stay], apart[stay]
    return label


def _held(batches: Iterator[pa.RecordBatch], by: list[str]) -> tuple[pa.Table, np.ndarray] | None:
    """Rows of whole groups in the order of some columns, and where each group begins; one past the last row, too."""
    got = list(batches)
    if not got:
        return None
    rows = pa.Table.from_batches(got).sort_by([(c, "ascending") for c in [*by, "name"]])
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in by:
        x = rows[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return rows, np.r_[np.flatnonzero(new), len(rows)]


def _sets(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    parts = list(shingles(text.cast(pa.large_string())))
    return np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole clusters: each set, and the first of its group."""
    held = _held(batches, ["root"])
    if held:
        rows, at = held
        for a, b in zip(at, at[1:], strict=False):
            name = rows["name"].slice(a, b - a).to_numpy()
            new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            own = exact_groups(*_sets(pc.take(rows["text"].slice(a, b - a), pa.array(new))))
            name = name[new]
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(name[own])], ["name", "chief"])


def _shared_with(one: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many members of a sorted set each of some sets has."""
    at = np.minimum(np.searchsorted(one, h), len(one) - 1)
    return np.add.reduceat(one[at] == h, first, dtype=np.int64)


def _from_middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks, each with the middle of its cluster: how far each set is from that one, and whether they are near."""
    held = _held(batches, ["root", "block", "member"])  # the middle stands before the members
    if held:
        rows, at = held
        member = rows["member"].to_numpy()
        for a, b in zip(at, at[1:], strict=False):
            if not member[a]:
                one = _sets(rows["text"].slice(a, 1))[1]
                continue
            owner, h = _sets(rows["text"].slice(a, b - a))
            first = _starts(owner)
            size = np.diff(np.r_[first, len(h)])
            n = _shared_with(one, first, h)
            near = n * (OVER + UNDER) >= OVER * (size + len(one))
            yield pa.RecordBatch.from_arrays([pa.array(rows["root"].slice(a, b - a).to_numpy()), pa.array(rows["name"].slice(a, b - a).to_numpy()), pa.array(1 - n / (size + len(one) - n)), pa.array(near)], ["root", "name", "far", "near"])


def _between_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole pairs of blocks: a forest over the links between one block's sets and those of both."""
    held = _held(batches, ["root", "x", "y"])
    if held:
        rows, at = held
        for a, b in zip(at, at[1:], strict=False):
            part = rows.slice(a, b - a)
            asks, far, name = part["asks"].to_numpy(), part["far"].to_numpy(), part["name"].to_numpy()
            owner, h = _sets(part["text"])
            first = _starts(owner)
            size = np.diff(np.r_[first, len(h)])
            u, v = [], []
            for k in np.flatnonzero(asks).tolist():
                look = np.flatnonzero(np.abs(far - far[k]) <= 1 - OVER / UNDER + 1e-9)
                n = _shared_with(h[first[k] : first[k] + size[k]], np.r_[0, np.cumsum(size[look])[:-1]], h[_ranges(first[look], size[look])])
                near = look[n * (OVER + UNDER) >= OVER * (size[look] + size[k])]
                near = near[name[near] != name[k]]
                u.append(np.full(len(near), name[k]))
                v.append(name[near])
                if sum(map(len, u)) > 1 << 20:
                    u, v = ([z] for z in local_forest(np.concatenate(u), np.concatenate(v)))
            x, y = local_forest(np.concatenate([np.zeros(0, np.int64), *u]), np.concatenate([np.zeros(0, np.int64), *v]))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def _block(of: str):
    return F.pmod(F.xxhash64("name"), F.col(of)).cast("int")


def _large(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, chief) for the sets of clusters that are too large for a task: rows root, name, text, blocks.

    Block by block, all are compared with the middle, a set with the cluster's commonest
    key. What is near it is one group. The rest is compared, one block with another, with
    itself and with those of the group that its distances from the middle leave possible.
    """
    keyed = members.select("root", "name").join(nodes.select("name", F.get("keys", F.lit(0)).alias("key")), "name")
    middle = keyed.groupBy("root", "key").agg(F.count("*").alias("n"), F.min("name").alias("name")).groupBy("root").agg(F.max_by("name", F.struct("n", "key")).alias("name"))
    copies = members.join(middle, ["root", "name"], "left_semi").groupBy("root", "name", "blocks").agg(F.any_value("text").alias("text")).select("root", "name", "text", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), F.lit(0).alias("member"))
    both = members.select("root", "name", "text", _block("blocks").alias("block"), F.lit(1).alias("member")).unionByName(copies)
    stars = tables.keep(both.repartition("root", "block").mapInArrow(_from_middle, "root long, name long, far double, near boolean"))
    rest = stars.where("not near").groupBy("root").agg(F.min("far").alias("low"), F.ceil(F.count("*") / BLOCK).alias("asking"))
    due = stars.join(rest, "root").where(F.expr("not near") | (F.col("far") >= F.col("low") - (1 - OVER / UNDER) - 1e-9))
    blocks = due.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("asked"))
    due = due.join(blocks, "root").join(members.select("name", "text"), "name").select("root", "name", "text", "far", "near", "asking", "asked")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    ask = due.where("not near").select("root", "name", "text", "far", F.lit(True).alias("asks"), _block("asking").alias("x"), every("asked").alias("y"))
    told = due.select("root", "name", "text", "far", F.lit(False).alias("asks"), _block("asked").alias("y"), every("asking").alias("x"))
    found = ask.unionByName(told).repartition("root", "x", "y").mapInArrow(_between_blocks, "a long, b long")
    near = stars.where("near").join(middle.select("root", F.col("name").alias("b")), "root").select(F.col("name").alias("a"), "b")
    return components(found.unionByName(near)).select(F.col("node").alias("name"), F.col("root").alias("chief"))


def by_prints(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between sets (name, fp) whose SimHash fingerprints differ in NEAR_BITS at most: same components as all of these."""
    heads = tables.keep(nodes.groupBy("fp").agg(F.min("name").alias("head")))
    equal = nodes.join(heads, "fp").where("name != head").select(F.col("head").alias("a"), F.col("name").alias("b"))
    near = links(heads.select("fp"), NEAR_BITS).withColumnsRenamed({"a": "fp", "b": "other"})
    near = near.join(heads, "fp").select(F.col("other").alias("fp"), F.col("head").alias("a")).join(heads, "fp").select("a", F.col("head").alias("b"))
    return equal.unionByName(near)


def groups(rows: DataFrame) -> DataFrame:
    """(name, least, chief) of each different set of rows (place, text): least place, and a set that stands for the group."""
    nodes = tables.keep(rows.mapInArrow(_marked, "place long, name long, fp long, keys array<long>").groupBy("name").agg(F.min("place").alias("least"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")))
    met = nodes.select("name", F.explode("keys").alias("key")).repartition("key").mapInArrow(_met, "a long, b long")
    clusters = tables.keep(nodes.select("name", F.col("least").alias("place")).join(components(met.unionByName(by_prints(nodes.where("size(keys) > 0").select("name", "fp")))).withColumnRenamed("node", "name"), "name"))
    crowds = tables.keep(clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    named = rows.mapInArrow(_named(rows.columns.index("text")), tables.with_columns(rows.schema, [("name", "long")]))
    members = named.join(clusters, ["place", "name"]).select("root", "name", "text")
    if crowds.isEmpty():
        found = tables.keep(members.repartition("root").mapInArrow(_compared, "name long, chief long"))
    else:
        members = tables.keep(members.join(crowds, "root", "left"))
        few = members.where("blocks is null").select("root", "name", "text").repartition("root").mapInArrow(_compared, "name long, chief long")
        found = tables.keep(few.unionByName(_large(members.where("blocks > 1"), nodes)))
    return nodes.join(found, "name", "left").select("name", "least", F.coalesce("chief", "name").alias("chief"))


def _named(text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(set_names(b.column(text)).view(np.int64))], [*b.schema.names, "name"])

    return run


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns: that of the least doc_id (null last; of its rows the least set and text).

    A null text is empty; texts without words are copies of each other. Columns may have any names.
    """
    own = tables.apart(docs).withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)))
    heads = groups(own.select("place", F.coalesce("text", F.lit("")).alias("text"))).groupBy("chief").agg(F.min(F.struct(F.col("least").alias("place"), "name")).alias("head")).select("head.*")
    marked = own.mapInArrow(_named(1), tables.with_columns(own.schema, [("name", "long")]))
    found = marked.join(heads, ["place", "name"], "left_semi")
    first = F.row_number().over(Window.partitionBy("place", "name").orderBy("text"))
    return tables.together(found.withColumn("n", first).where("n = 1"), docs.columns)
