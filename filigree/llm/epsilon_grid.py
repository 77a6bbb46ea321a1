"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c) of each other, and so do their projections on any orthonormal
directions. Vectors are sorted by the epsilon grid cells of their leading principal components, cut into
intervals of that order, and interval pairs whose bounding boxes are not provably farther apart than epsilon are joined. Within a pair,
the sequences are halved recursively, boxes that are too far apart are skipped, and what is left is multiplied out in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.components import components, unite
from filigree.sources.staging import stage

#: Leading principal components that make up the grid order, and those that the boxes look at.
GRID, BOX = 4, 16
INTERVAL, BLOCK = 2048, 256
#: Each interval may meet all others, so a vector is sent once for each: as many intervals at most, unless one would hold more than ``MOST`` bytes.
INTERVALS, MOST = 12, 32 << 20


def intervals(vectors: int, size: int) -> int:
    """How many intervals so many vectors of so many bytes each are cut into."""
    return max(1, min(-(-vectors // INTERVAL), INTERVALS), -(-vectors * size // MOST))


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Valid vectors as normalised doubles; a row for every valid vector."""
    for batch in batches:
        rows = []
        for vec_id, values in zip(batch["id"], batch["v"], strict=True):
            if values is None or not len(values):
                continue
            x = np.array([np.nan if v is None else v for v in values], np.float64)
            norm = np.linalg.norm(x / m) * m if (m := np.abs(x).max()) > 0 and np.isfinite(x).all() else 0.0
            if norm > 0:
                rows.append((vec_id, len(x), (x / norm).tobytes()))
        yield pd.DataFrame(rows, columns=["id", "d", "x"])


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of outer products of one task's vectors, one row per dimension of the vectors and matrix row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, part in batch.groupby("d"):
            x = np.frombuffer(b"".join(part["x"]), np.float64).reshape(-1, d)
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, s in sums.items():
        yield pd.DataFrame({"d": d, "i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "s": s.ravel()})


def _projected(axes: dict[int, np.ndarray], epsilon: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby("d"):
                y = np.frombuffer(b"".join(part["x"]), np.float64).reshape(-1, d) @ axes[d]
                out = part.assign(y=[row.tobytes() for row in y])
                for k in range(GRID):
                    out[f"c{k}"] = np.floor(y[:, k] / epsilon).astype(np.int64) if k < y.shape[1] else 0
                yield out

    return run


class Sequence:
    """An interval of the grid order with the bounding boxes of its blocks."""

    def __init__(self, part: pd.DataFrame, d: int) -> None:
        part = part.sort_values([f"c{k}" for k in range(GRID)] + ["id"], kind="stable")
        self.id, self.m = part["id"].to_numpy(np.int64), part["m"].to_numpy(np.int64)
        self.x = np.frombuffer(b"".join(part["x"]), np.float64).reshape(-1, d)
        self.y = np.frombuffer(b"".join(part["y"]), np.float64).reshape(len(part), -1)


def _gap(a: np.ndarray, b: np.ndarray) -> float:
    """Squared distance of the bounding boxes of two sets of points."""
    between = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float((between**2).sum())


def join_sequences(p: Sequence, q: Sequence | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two sequences, or within one (``q`` None): number of partners of each vector, copies counted, and a label per vector.

    Vectors of p, then of q, are numbered from 0.
    """
    n = len(p.id)
    other = q or p
    shift = n if q else 0
    count = np.zeros(n + (len(q.id) if q else 0), np.int64)
    label = np.arange(len(count))
    reach = 2 - 2 * cosine + 1e-9
    pending = [(0, n, 0, len(other.id))]
    while pending:
        a, b, c, d = pending.pop()
        if a >= b or c >= d or (q is None and c < a) or _gap(p.y[a:b], other.y[c:d]) > reach:
            continue
        if max(b - a, d - c) > BLOCK:
            if q is None and (a, b) == (c, d):
                h = (a + b) // 2
                pending += [(a, h, a, h), (a, h, h, b), (h, b, h, b)]
            elif b - a >= d - c:
                pending += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
            else:
                pending += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
            continue
        near = p.x[a:b] @ other.x[c:d].T >= cosine
        if q is None and a == c:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = i + a, j + c
        np.add.at(count, i, other.m[j])
        np.add.at(count, j + shift, p.m[i])
        label = unite(label, i, j + shift)
    return count, label, np.concatenate([p.id, q.id]) if q else p.id


def _pairs(cosine: float) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        if not len(left):
            return out
        d = int(left["d"].iloc[0])
        same = bool(left["same"].iloc[0])
        if not same and not len(right):
            return out
        count, label, ids = join_sequences(Sequence(left, d), None if same else Sequence(right, d), cosine)
        some = count > 0
        return pd.DataFrame({"a": ids[some], "b": ids[label[some]], "n": count[some]})

    return run


def near_copies(vectors: DataFrame, *, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Cosines are dot products of vectors normalised in double precision. Vectors that are NULL, empty, zero, or hold NULL or non-finite
    components are linked with nothing, and vectors of different lengths are not compared. Vectors with the same values are one leaf with a
    multiplicity. ``n_links`` counts other ids linked directly; rows with the same id and values are one vector. A row whose id is NULL is linked with nothing.
    An empty table gives no rows. Tasks report a count and a spanning link for each vector, never pairs.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine))
    kind = dict(vectors.dtypes)[vec_id]
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    clean = stage(rows.where("id IS NOT NULL").mapInPandas(_clean, "id long, d int, x binary"))
    keyed = clean.withColumn("key", F.sha2("x", 256))
    # One row for each distinct vector; m: its ids.
    heads = stage(keyed.groupBy("d", "key").agg(F.min("id").alias("head"), F.count_distinct("id").alias("m"), F.first("x").alias("x")))
    sums = heads.select("d", "x").mapInPandas(_moments, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()  # d x d numbers
    axes = {}
    for d, part in sums.groupby("d"):
        moment = np.zeros((d, d))
        moment[part["i"], part["j"]] = part["s"]
        axes[int(d)] = np.ascontiguousarray(np.linalg.eigh(moment)[1][:, ::-1][:, :BOX])
    cells = [f"c{k}" for k in range(GRID)]
    schema = "d int, key string, id long, m long, x binary, y binary, " + ", ".join(f"{c} long" for c in cells)
    placed = heads.select("d", "key", F.col("head").alias("id"), "m", "x").mapInPandas(_projected(axes, epsilon), schema)
    total = heads.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).first()
    dealt = placed.repartitionByRange(intervals(total["n"], 8 * (total["d"] or 0)), "d", *cells, "id").withColumn("part", F.spark_partition_id())
    dealt = stage(dealt.drop("key"))

    # Bounding boxes of the intervals in grid cells: a few numbers per interval. Only intervals whose first cells are neighbours can meet.
    boxes = dealt.groupBy("d", "part").agg(*(f(c).alias(f"{n}_{c}") for c in cells for n, f in (("lo", F.min), ("hi", F.max))))
    reach = boxes.withColumn("at", F.explode(F.sequence(F.col("lo_c0") - 1, F.col("hi_c0") + 1)))
    spots = boxes.withColumn("at", F.explode(F.sequence(F.col("lo_c0"), F.col("hi_c0")))).withColumnsRenamed({"part": "other"} | {f"{n}_{c}": f"{n}2_{c}" for c in cells for n in ("lo", "hi")})
    near = F.expr(" AND ".join(f"lo_{c} <= hi2_{c} + 1 AND lo2_{c} <= hi_{c} + 1" for c in cells))
    pairs = stage(reach.join(spots, ["d", "at"]).where(near & (F.col("part") <= F.col("other"))).select("d", "part", "other").distinct())
    left = dealt.join(pairs, ["d", "part"]).withColumn("same", F.col("part") == F.col("other"))
    copy = dealt.select(*(F.col(c).alias("other" if c == "part" else c) for c in dealt.columns))
    right = copy.join(pairs.where("part < other").select(F.col("d").alias("d"), F.col("part").alias("part"), F.col("other").alias("other")), ["d", "other"])
    keys = ["d", "part", "other"]
    found = stage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_pairs(cosine), "a long, b long, n long"))

    # The least id stands for a vector; if it stands for several (an id with two values), they count as one node.
    classes = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    labels = heads.select("d", "key", F.col("head").alias("a"), "m").join(links, "a", "left").join(classes.withColumnsRenamed({"node": "a", "component": "c"}), "a", "left")
    labels = stage(labels.select("d", "key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("c", "a").alias("component_id")))
    every = rows.select("id").where("id IS NOT NULL").distinct()
    answer = keyed.select("id", "d", "key").distinct().join(labels, ["d", "key"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    answer = stage(every.join(answer, "id", "left"))
    named = vectors.select(F.col(vec_id).cast("long").alias("id")).join(answer, "id", "left")
    component = F.coalesce("component_id", "id")
    return named.select(F.col("id").cast(kind).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
