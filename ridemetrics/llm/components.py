"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemetrics.llm.common import materialise


class Forest:
    """Union-find over integer keys; the smallest key of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = self.find(a), self.find(b)
            if a < b:
                self.parent[b] = a
            elif b < a:
                self.parent[a] = b

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each key that is no root, and its root."""
        keys = list(self.parent)
        roots = [self.find(k) for k in keys]
        keep = [(k, r) for k, r in zip(keys, roots) if k != r]
        table = np.array(keep, np.int64).reshape(-1, 2)
        return table[:, 0].copy(), table[:, 1].copy()


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        forest.join(batch.column("src").to_numpy(), batch.column("dst").to_numpy())
    src, dst = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


def _largest_first(edges: DataFrame) -> DataFrame:
    return (
        edges.filter("src != dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _star(links: DataFrame) -> DataFrame:
    """Every neighbour of a node, and the node, to the node's smallest neighbour.

    `links` has (node, other). One row per node holds its minimum, so a node with
    very many neighbours is combined before the shuffle and its rows can be split
    in the join.
    """
    least = links.groupBy("node").agg(F.min("other").alias("least"))
    least = least.withColumn("least", F.least("node", "least"))
    return links.join(least, "node")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component of edges (src, dst) of longs; component is the smallest node.

    Nodes without an edge to another node are left out. Every task first reduces
    its edges to a forest. Rounds stop when no edge changes, which takes about
    the logarithm of the longest path; RuntimeError after `rounds` of them.
    """
    now = materialise(
        _largest_first(edges.select("src", "dst").mapInArrow(_local_stars, "src long, dst long")),
        "components",
    )
    mark = None
    for _ in range(rounds):
        both = now.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionAll(
            now.select(F.col("dst").alias("node"), F.col("src").alias("other"))
        )
        large = _largest_first(
            _star(both)
            .filter(F.col("other") > F.col("node"))
            .select(F.col("other").alias("src"), F.col("least").alias("dst"))
        )
        down = large.select(F.col("src").alias("node"), F.col("dst").alias("other"))
        starred = _star(down)
        small = _largest_first(
            starred.select(F.col("other").alias("src"), F.col("least").alias("dst")).unionAll(
                starred.select(F.col("node").alias("src"), F.col("least").alias("dst"))
            )
        )
        now = materialise(small, "components")
        seen = now.agg(
            F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == mark:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(
                now.select("dst", "dst").distinct().toDF("node", "component")
            )
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
