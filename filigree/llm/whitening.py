"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become integers (``floor(scale * c) + offset``), so sums and deviations are exact. The fit list holds each distinct vector once. Its sums
and its scatter, centred before multiplying, are added up in the tasks and met in Spark dimension by dimension: what travels is one row of the scatter
for each task and dimension, and what reaches the driver is one d x d matrix, whose size depends on the vectors' length and not on their number.

There the scatter A becomes L L' by Cholesky with diagonal pivoting, which ends where the rank does, and rotations of pairs of columns
make the columns of L orthogonal: L J = U S. As A = U S S U', the squared norms of the rotated columns are the eigenvalues and the normalised columns
are the components; A is never multiplied again, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.sources.staging import stage

SCALE, OFFSET = 64, 1_000_000
#: Longest vectors whose scatter is held as one matrix: 4,096 entries are 134 MB.
MOST_DIMENSIONS = 4096
_SWEEPS = 60


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', rows in the order of ``a``, one column for each pivot; lower triangular in the order of the pivots."""
    rest = a.astype(np.float64, copy=True)
    d = len(rest)
    columns = np.zeros((d, d))
    open_ = np.ones(d, bool)
    least = np.finfo(np.float64).eps * d * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        diagonal = np.where(open_, rest.diagonal(), -np.inf)
        p = int(diagonal.argmax())
        if not diagonal[p] > least:
            return columns[:, :k]
        column = np.where(open_, rest[:, p], 0.0) / np.sqrt(diagonal[p])
        columns[:, k] = column
        rest -= np.outer(column, column)
        open_[p] = False
    return columns


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of ``n`` columns once, in rounds of pairs without a common column."""
    seats = np.arange(n + n % 2)
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        i, j = seats[:half], seats[half:][::-1]
        real = (i < n) & (j < n)
        yield i[real], j[real]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until they are orthogonal, by falling norm."""
    columns = factor.T.copy()  # a column of the factor is a row here
    n, tolerance = len(columns), np.finfo(np.float64).eps * max(len(factor), 1) ** 0.5
    for _ in range(_SWEEPS):
        turned = False
        for i, j in _rounds(n):
            x, y = columns[i], columns[j]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            far = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if not far.any():
                continue
            turned = True
            i, j, x, y, xx, yy, xy = (v[far] for v in (i, j, x, y, xx, yy, xy))
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            columns[i], columns[j] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
        if not turned:
            break
    else:
        raise ArithmeticError(f"columns are not orthogonal after {_SWEEPS} sweeps")
    return columns[np.argsort(-(columns * columns).sum(1), kind="stable")].T


@dataclass
class Model:
    """A fit: number and sums of the distinct vectors, components as columns, eigenvalues of the covariance and its trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; the mean's whole part is taken off in integers."""
        whole = self.sums // self.n
        return (x - whole).astype(np.float64) - (self.sums - self.n * whole) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - sum) ** 2, exact; an error where that exceeds 64 bits."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + int(np.abs(self.sums).max(initial=0))
        if most < 1 << 62:
            off = self.n * x - self.sums
            if (off.astype(np.float64) ** 2).sum(1).max(initial=0.0) < 2.0**62:
                return (off * off).sum(1)
        exact = [sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        if max(exact, default=0) >= 1 << 63:
            raise OverflowError("a deviation does not fit 64 bits")
        return np.array(exact, np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> tuple[int, np.ndarray]:
    """How many vectors there are, and the sum of each entry of ``of`` them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                got = of(_matrix(batch.column(0)))
                n, total = n + len(got), got.sum(0) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(total), dtype=np.int32)), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array(total)})

    got = rows.mapInArrow(run, f"k int, n long, s {kind}").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").collect()
    return (got[0]["n"] if got else 0), np.array([r["s"] for r in got], np.int64 if kind == "long" else np.float64)


def _scatter(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of outer products of ``of`` the vectors, which gives them centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                c = of(_matrix(batch.column(0)))
                total += c.T @ c
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(size, dtype=np.int32)), "s": pa.array(list(total), pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)), strict=True):
                sums[k] = sums.get(k, 0) + s
        if sums:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()), "s": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    out = np.zeros((size, size))
    for r in rows.mapInArrow(run, "k int, s array<double>").repartition("k").mapInArrow(add, "k int, s array<double>").collect():
        out[r["k"]] = r["s"]
    return (out + out.T) / 2


def quantised(vector: Column) -> Column:
    """The entries as integers; NULL where the vector is NULL or empty or has an entry that is NULL or not finite."""
    usable = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))) + F.lit(OFFSET).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, usable), entries)


def fit(listed: DataFrame, most: int) -> Model | None:
    """The model of the vectors in column ``x``, distinct and of one length, with at most so many components; None without vectors."""
    n, sums = _sums(listed, lambda x: x, "long")
    if not n:
        return None
    if len(sums) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {len(sums)} entries; at most {MOST_DIMENSIONS} are held as one matrix")
    model = Model(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    covariance = _scatter(listed, model.centred, len(sums)) / n
    turned = one_sided_jacobi(pivoted_cholesky(covariance))
    values = (turned * turned).sum(0)
    turned, values = turned[:, :most], values[:most]
    return Model(n, sums, turned / np.sqrt(values), values, float(covariance.trace()))


def identity_error(model: Model, listed: DataFrame) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, measured over the list."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    n, sums = _sums(listed, model.whitened, "double")
    covariance = _scatter(listed, lambda x: model.whitened(x) - sums / n, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, *, components: int = 16, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component.

    Rows whose vector is NULL, empty or holds a NULL or non-finite entry are dropped; so are rows whose vector has another length than most (of equally frequent
    lengths, the longer). Components are numbered from 1 by falling eigenvalue; there are as many as the rank allows, so none where all vectors are alike. Equal
    eigenvalues leave their components free to turn. Each row stands for itself, repeated and NULL ids too; the fit takes equal vectors once. Other columns
    are not looked at. An empty table gives no rows.
    """
    column = lambda c: F.col(f"`{c}`")
    rows = vectors.select(column(vec_id).cast("long").alias("vec_id"), quantised(column(vector)).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (lengths["d"] if lengths else 0))
    listed = stage(rows.select("x").distinct())
    model = fit(listed, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], f"{schema}, identity_error double")
    error = identity_error(model, listed)
    k = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n)), "deviation": pa.array(np.repeat(model.deviation(x), k)), "whitened": pa.array(model.whitened(x).ravel()),
                "explained": pa.array(np.tile(explained, m)),
            })

    return rows.mapInArrow(run, schema).withColumn("identity_error", F.lit(error))
