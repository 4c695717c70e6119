"""Connected components of a graph given as links, by contraction on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links of one task: each linked number with the least of its component, but for that one itself."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that is linked to another; links has long columns a and b.

    Each round, a node hooks to its least smaller neighbour, the chains are shortened
    to their ends, and the links are carried over to those ends. Rounds end when no
    link between different ends is left; each round's tables are written.
    """
    edges = tables.keep(_between(links.select("a", "b")))
    found = tables.keep(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        hooks = tables.keep(edges.groupBy("a").agg(F.min("b").alias("b")))
        while True:
            above = hooks.select(F.col("a").alias("b"), F.col("b").alias("up"))
            step = tables.keep(hooks.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved")))
            hooks = step.select("a", "b")
            if step.where("moved").isEmpty():
                break
        found = tables.keep(found.join(hooks.withColumnsRenamed({"a": "root", "b": "up"}), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left = edges.join(hooks.select("a", F.col("b").alias("x")), "a", "left").select(F.coalesce("x", "a").alias("a"), "b")
        right = left.join(hooks.select(F.col("a").alias("b"), F.col("b").alias("x")), "b", "left").select("a", F.coalesce("x", "b").alias("b"))
        edges = tables.keep(_between(right))
    return found


def _between(links: DataFrame) -> DataFrame:
    """Each link between different nodes once, from the larger to the smaller."""
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
