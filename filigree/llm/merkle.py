"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf: a digest of its fields. The leaves of one group (``tree``) ascend by an id and are folded two by two into a subroot; the
subroots, in order of their group, are folded alike into the root. A lone last node of a level is hashed alone.

1. *Places.* Leaves are range-partitioned and sorted; each task counts its own, and the counts before a task (one row for each task and tree) turn
   local places into places in the tree. No window ever runs over a tree, which may hold a third of all rows or more.
2. *Up.* ``2 ** height`` neighbours are a superblock; each superblock is folded to one node, and those are the nodes of the next round, until
   every tree has one. The subroots then are the leaves of one more tree.
3. *Down.* A superblock needs from outside only the siblings on the way from its own top to the root. Nodes and these outer siblings are cogrouped by
   superblock, round by round from the root, in ``applyInPandas``; the last round finishes the leaves: it folds the superblock again, joins inner
   and outer siblings into each leaf's proof, and folds the claimed leaf along it.

Texts are read once, for their digests. Superblocks have a bounded number of rows whatever the size of a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from filigree.sources.staging import stage

#: Levels that a superblock folds: it holds 1,024 nodes.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_SIBLING, LEFT, RIGHT = "", "l", "r"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field's share of a leaf: ``-`` for NULL, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def levels(nodes: int) -> int:
    """How often a level of so many nodes is halved until one is left."""
    return max(nodes - 1, 0).bit_length()


def climb(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of a superblock, its nodes first."""
    rows = [nodes]
    for _ in range(height):
        below = rows[-1]
        rows.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return rows


def siblings(rows: list[list[str]], at: int) -> list[str]:
    """The way from node ``at`` of the lowest level to the top: each level's sibling behind the side it stands on."""
    out = []
    for row in rows[:-1]:
        other = at ^ 1
        out.append((LEFT if other < at else RIGHT) + row[other] if other < len(row) else NO_SIBLING)
        at >>= 1
    return out


def fold(node: str, proof: Sequence[str]) -> str:
    """The root that a node and its proof lead to."""
    for step in proof:
        side, other = step[:1], step[1:]
        node = digest(other, node) if side == LEFT else digest(node, other)
    return node


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place among the task's rows of its tree; the rows come sorted by tree."""
    part = TaskContext.get().partitionId()
    tree, seen = None, 0
    for batch in batches:
        places = []
        for of in batch.column("tree").to_pylist():
            seen = seen + 1 if of == tree else 0
            tree = of
            places.append(seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "local"])


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place in its ``tree`` by ``order``, and ``total``, the nodes of the tree. ``tree`` is not NULL."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    counted = stage(nodes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_count, f"{schema}, part int, local long"))
    here = counted.groupBy("tree", "part").agg((F.max("local") + 1).alias("here"))
    tree = Window.partitionBy("tree")  # as many rows as tasks that hold the tree
    before = F.coalesce(F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = here.select("tree", "part", before.alias("before"), F.sum("here").over(tree).alias("total"))
    return counted.join(starts, ["tree", "part"]).select(*nodes.columns, (F.col("before") + F.col("local")).alias("pos"), "total")


def _tops(height: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A superblock's top node, a node of the next round."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        first = block.iloc[0]
        total = int(first["total"])
        top = climb(block["node"].tolist(), min(height, levels(total)))[-1][0]
        return pd.DataFrame({"tree": [first["tree"]], "pos": [int(first["pos"]) >> height], "total": [((total - 1) >> height) + 1], "node": [top]})

    return run


def _ways(nodes: pd.DataFrame, outer: pd.DataFrame, height: int) -> list[list[str]]:
    """For each node of a superblock, in order, the siblings up to the root."""
    rows = climb(nodes["node"].tolist(), min(height, levels(int(nodes["total"].iloc[0]))))
    beyond = list(outer["way"].iloc[0])
    return [siblings(rows, k) + beyond for k in range(len(nodes))]


def _joined(height: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Ways of an inner superblock's nodes."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "way": _ways(nodes, outer, height), "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0]})

    return run


def _finished(height: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A superblock of leaves: proofs, and the claimed leaves folded along them."""

    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        root = outer["root"].iloc[0]
        proofs = _ways(leaves, outer, height)
        folded = [fold(c if isinstance(c, str) else own, way) for c, own, way in zip(leaves["claimed"], leaves["node"], proofs, strict=True)]
        out = {"id": leaves["id"], "group": leaves["group"], "leaf": leaves["node"], "subroot": outer["subroot"].iloc[0], "root": root}
        return pd.DataFrame(out | {"proof": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    return run


class Forest:
    """Trees over placed nodes (``tree, pos, total, node``), in rounds of superblocks of ``2 ** height`` nodes."""

    def __init__(self, nodes: DataFrame, height: int) -> None:
        self.height = height
        self.rounds = [nodes.select("tree", "pos", "total", "node")]
        while (self.rounds[-1].agg(F.max("total")).first()[0] or 0) > 1:
            self.rounds.append(stage(self._blocks(self.rounds[-1]).applyInPandas(_tops(height), "tree string, pos long, total long, node string")))

    def _blocks(self, nodes: DataFrame) -> GroupedData:
        return nodes.withColumn("block", F.shiftright("pos", self.height)).groupBy("tree", "block")

    def tops(self) -> DataFrame:
        """``tree, node``: what remains of each tree."""
        return self.rounds[-1].select("tree", "node")

    def exchange(self, nodes: DataFrame, outer: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """Nodes of a round and the outer siblings of their superblocks (``tree, block, way, subroot, root``), cogrouped."""
        return self._blocks(nodes).cogroup(outer.groupBy("tree", "block")).applyInPandas(run, schema)

    def outer(self, trees: DataFrame) -> DataFrame:
        """The outer siblings of each superblock of the first round, from those of the trees (``tree, way, subroot, root``)."""
        out = trees.withColumn("block", F.lit(0).cast("long"))
        for nodes in reversed(self.rounds[1:]):
            out = stage(self.exchange(nodes, out, _joined(self.height), _WAY).withColumnRenamed("pos", "block"))
        return out


_WAY = "tree string, pos long, way array<string>, subroot string, root string"


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "lang", doc_id: str = "doc_id", claimed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """``id, group, leaf, subroot, root, proof, folded_root, verified`` for every row of ``docs``.

    ``proof`` lists the way to the root from below: for each level the sibling's digest behind ``l`` or ``r`` for its side, or an empty string where
    there is none. ``claimed`` is the leaf that somebody presents for a row (NULL: the row's own); it is folded along the proof of the original, and
    ``verified`` says whether that gives the root.

    Leaves of a group ascend by id, NULL first, rows that repeat an id by their leaf; equal rows are leaves of their own. Groups ascend by their UTF-8 bytes,
    NULL first; NULL and an empty string are two groups. An empty text counts as a value of no bytes. Columns outside ``fields`` are not looked at.
    An empty table gives no rows.
    """
    name = lambda c: F.col(f"`{c}`")
    tree = F.when(name(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name(group).cast("string")))
    own = leaf([name(c) for c in fields])
    given = (F.lit(None) if claimed is None else claimed).cast("string")
    read = stage(docs.select(tree.alias("tree"), name(doc_id).cast("long").alias("id"), name(group).cast("string").alias("group"), own.alias("node"), given.alias("claimed"), F.monotonically_increasing_id().alias("row")))
    # The row number ends ties, so that a row repeated very often spreads over tasks as well. Ids travel as text: a column with NULLs would lose digits in pandas.
    leaves = stage(placed(read, ["id", "node", "row"]).drop("row").withColumn("id", F.col("id").cast("string")))

    lower = Forest(leaves, height)
    subroots = stage(placed(lower.tops().select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), ["of"]))
    upper = Forest(subroots, height)
    root = upper.tops().select("tree", F.array().cast("array<string>").alias("way"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    ways = upper.exchange(subroots.select("tree", "pos", "total", "node"), upper.outer(root), _joined(height), _WAY)
    trees = subroots.join(ways.select("pos", "way", "root"), "pos").select(F.col("of").alias("tree"), "way", F.col("node").alias("subroot"), "root")
    done = lower.exchange(leaves, lower.outer(stage(trees)), _finished(height), "id string, group string, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")
    return done.withColumn("id", F.col("id").cast("long"))
