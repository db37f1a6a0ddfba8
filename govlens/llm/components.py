"""Connected components of an edge table by alternating stars, in a few rounds of shuffles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import stored

MAX_ROUNDS = 60


class Forest:
    """Components of up to a few thousand members within one task; root is each one's smallest fellow."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """Join members a[i] and b[j] wherever linked[i, j]."""
        apart = linked & (self.root[a][:, None] != self.root[b][None, :])
        for i in np.flatnonzero(apart.any(axis=1)):
            found = np.unique(self.root[np.append(b[linked[i]], a[i])])
            if len(found) > 1:
                self.root[np.isin(self.root, found)] = found[0]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node. Nulls are not nodes."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        # each larger end of an edge moves to the smallest neighbour of the smaller end; that is a table of its own, so
        # that the join of a hot node can be split
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")).select("b", F.least("b", "m").alias("m")))
        small = now.join(least, "b").select("a", F.col("m").alias("b")).unionByName(now)
        # then all smaller neighbours of a node, and itself, move to the smallest of them
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        star = small.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(star.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        # done when every node has one edge at most and no edge ends in a node that has one
        roles = after.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(after.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        roles = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not roles.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count():
            break
        now = after
    else:
        raise RuntimeError("components did not settle")
    ends = after.select("b").distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends.select(F.col("b").alias("node"), F.col("b").alias("component")))
