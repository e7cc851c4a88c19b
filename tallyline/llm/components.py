"""Connected components of links between numbered nodes.

Each task first runs union-find over the links it holds and passes on a forest. The forests are joined by alternating
large-star and small-star steps: every node hangs its larger neighbours, then its smaller ones, under its smallest
neighbour, until each component is a star around its smallest node. Links are kept once, from the larger node to the
smaller. In the large step each of them only has to learn the smallest neighbour of its smaller end: the nodes that very many
links end at are looked up from a broadcast of at most HOT_KEYS of them, so their links never meet in one task. The number of
steps grows with the logarithm of the longest path. Every step is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import lookup, stored

LINKS_PER_FOREST = 100_000


def roots(hits: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes a (rows) and b (columns) with links where `hits`, the smallest node each reaches."""
    none = np.iinfo(np.int64).max
    low_a, low_b = a.copy(), b.copy()
    while True:
        new_b = np.minimum(low_b, np.where(hits, low_a[:, None], none).min(0, initial=none))
        new_a = np.minimum(low_a, np.where(hits, new_b[None, :], none).min(1, initial=none))
        if (new_a == low_a).all() and (new_b == low_b).all():
            return low_a, low_b
        low_a, low_b = new_a, new_b


def forest(hits: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node of a block's links to the smallest node it reaches, in place of all pairs."""
    low_a, low_b = roots(hits, a, b)
    node, low = np.append(a, b), np.append(low_a, low_b)
    return node[node != low], low[node != low]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def out() -> pa.RecordBatch:
        nodes = [x for x in list(parent) if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())],
                                          ["a", "b"])

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        seen += len(batch)
        if seen > LINKS_PER_FOREST:
            yield out()
            parent.clear()
            seen = 0
    if parent:
        yield out()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and root (its component's smallest node) of every node of links (a, b) that is not itself a root."""
    below = stored(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a bigint, b bigint"), name)
    while not _is_star(below):
        lows = below.groupBy("a").agg(F.min("b").alias("m"))
        ends = below.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(lows.withColumnRenamed("a", "b"), "b", "left")
        large = stored(lookup(below, ends.select("b", "n", F.coalesce("m", "b").alias("m")), "b").select(
            "a", F.col("m").alias("b")).distinct(), f"{name}_large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        below = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
    return below.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _is_star(below: DataFrame) -> bool:
    """Whether no root hangs under another node and every node hangs under one root, once."""
    tops = below.select(F.col("b").alias("a")).distinct()
    doubled = below.groupBy("a").count().where("count > 1").select("a")
    return tops.join(below, "a", "left_semi").unionByName(doubled).isEmpty()
