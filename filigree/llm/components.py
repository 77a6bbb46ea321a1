"""Connected components of a link table, by star contraction.

Links are first reduced to spanning forests of bounded parts; then every node is hooked to its
smallest neighbour until nothing changes. All state is in written tables, so a lost executor costs
a task, not the run. No list of neighbours is ever built: each step is a mergeable minimum and a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.sources.staging import stage

#: Links that one task joins in memory before the rounds over tables.
FOREST = 1 << 19


class Forest:
    """Union-find over arbitrary int64 ids; the root of a set is its smallest member."""

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

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of a task's links, about ``FOREST`` at a time."""
    held: list[np.ndarray] = []

    def spanning() -> pa.RecordBatch:
        names, index = np.unique(np.concatenate(held), return_inverse=True)
        label = unite(np.arange(len(names)), *index.reshape(-1, 2).T)
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_pydict({"a": pa.array(names[moved]), "b": pa.array(names[label[moved]])})

    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1))
        if sum(map(len, held)) >= 2 * FOREST:
            yield spanning()
            held = []
    if held:
        yield spanning()


def _state(edges: DataFrame) -> tuple:
    """The number of links and the sum of their hashes: equal for equal tables."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (int64 columns ``a``, ``b``).

    ``component`` is the smallest id reachable, the node itself included. Empty links give an empty
    table; NULL ends, self-links and repeats are allowed and add nothing.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    # Tasks that looked at different parts of the same sets report the same links: each goes on once, and what they say is joined in forests of bounded size.
    edges = stage(edges.distinct())
    edges = stage(edges.coalesce(-(-edges.count() // FOREST) or 1).mapInArrow(_forests, "a long, b long"))
    state = _state(edges)
    while state[0]:
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stage(small.where("a <> b").distinct())
        state = _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (``label[i] <= i`` points to a member of i's set) after linking a[k] with b[k]; whole arrays at a time."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la[apart], lb[apart]), np.minimum(la[apart], lb[apart]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
