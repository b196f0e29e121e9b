"""Connected components: by numpy within a task, by Spark over all tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import materialize


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest id of its component) for every linked id that is not
    itself the smallest: the shortest list of links with the same components."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        for end in (root[u], root[v], u, v):
            np.minimum.at(root, end, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        if (root == before).all():
            break
    member = np.flatnonzero(root != np.arange(len(ids)))
    return ids[member], ids[root[member]]


class Links:
    """Collects links of one task and keeps only their stars."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held = most, 0
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > self.most:
            self.pack()

    def pack(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        a, b = stars(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.held = [a], [b], len(a)
        self.most = max(self.most, 2 * len(a))
        return a, b


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each linked node.

    ``links`` has long columns a and b.  Alternating large-star and small-star
    steps: each is one aggregate (smallest neighbour, combined before the
    shuffle) and one join on the node, whose frequent nodes adaptive execution
    splits.  Every round is written to the shared folder; rounds grow with the
    logarithm of the longest path.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    size = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = materialize(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        size, before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), size
        if size == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
