"""Whitening against numpy's eigenvectors; ties, NULLs, copies, rank loss and empty tables."""

import numpy as np
import pytest

from filigree.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, k int, component string"


def _frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "x", 1, "c") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def _quantised(vectors):
    return np.floor(np.array(vectors, np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000


def _check(got, vectors, kept, most=16):
    x = _quantised([vectors[k] for k in kept])
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(0)
    centred = listed - listed.mean(0)
    cov = centred.T @ centred / n
    values, components = np.linalg.eigh(cov)
    values, components = values[::-1], components[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    white = (x - sums / n) @ components[:, :k] / np.sqrt(values[:k])
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(rows) == len(kept) * k
    for at, i in enumerate(kept):
        for c in range(k):
            r = rows[i, c + 1]
            assert r["n"] == n
            assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], sums, strict=True))
            assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
            assert abs(r["identity_error"]) < 1e-9
    for c in range(k):
        mine = np.array([rows[i, c + 1]["whitened"] for i in kept])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(sign * mine - white[:, c]).max() < 1e-6


def test_equals_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 24)) * np.linspace(9, 0.5, 24)
    vectors = [*base.tolist(), *([base[7].tolist()] * 40), *(base[:20] + 1e-5).tolist()]
    kept = list(range(len(vectors)))
    bad = [None, [None] + [0.0] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [], [1.0, 2.0]]
    got = whitening.whiten(_frame(spark, vectors + bad)).collect()
    _check(got, vectors, kept)


def test_rank_loss_and_few_components(spark):
    rng = np.random.default_rng(6)
    low = rng.integers(-4, 5, size=(60, 3)) @ rng.integers(-2, 3, size=(3, 10))
    _check(whitening.whiten(_frame(spark, (low / 1.0).tolist())).collect(), low.tolist(), list(range(60)))
    got = whitening.whiten(_frame(spark, (low / 1.0).tolist()), components=2).collect()
    assert {r["component"] for r in got} == {1, 2}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_tell_apart(spark, vectors):
    got = whitening.whiten(_frame(spark, vectors))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


def test_repeated_and_null_ids(spark):
    got = whitening.whiten(_frame(spark, [[0.0, 1.0], [1.0, 5.0], [3.0, 3.0], [3.0, 3.0]], [None, 1, 1, 1 << 60])).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted((str(i), c, 3) for i in (None, 1, 1, 1 << 60) for c in (1, 2))


@pytest.mark.parametrize("size, rank", [(1, 1), (7, 7), (40, 40), (40, 12)])
def test_factors(size, rank):
    rng = np.random.default_rng(size)
    b = rng.normal(size=(size, rank)) * 10.0 ** rng.uniform(-5, 0, rank)
    a = b @ b.T
    factor = whitening.pivoted_cholesky(a)
    assert np.abs(factor @ factor.T - a).max() <= 1e-12 * np.abs(a).max()
    pivots = factor[np.abs(factor).argmax(0), np.arange(factor.shape[1])]
    assert (pivots > 0).all()
    turned = whitening.one_sided_jacobi(factor)
    gram = turned.T @ turned
    norms = np.sqrt(np.diag(gram))
    assert (np.abs(gram - np.diag(np.diag(gram))) <= 1e-13 * np.outer(norms, norms)).all()
    assert (np.diff(norms) <= 0).all()
    assert np.allclose(np.diag(gram), np.linalg.eigvalsh(a)[::-1][: len(norms)], rtol=1e-6, atol=1e-13 * np.abs(a).max())


def test_deviation_beyond_64_bits_is_refused():
    model = whitening.Model(1 << 40, np.zeros(2, np.int64), np.zeros((2, 0)), np.zeros(0), 1.0)
    with pytest.raises(OverflowError):
        model.deviation(np.array([[1, 1]]))
    big = whitening.Model(3, np.array([1 << 61], np.int64), np.zeros((1, 0)), np.zeros(0), 1.0)
    assert big.deviation(np.array([[(1 << 61) // 3]])).tolist() == [(3 * ((1 << 61) // 3) - (1 << 61)) ** 2]


def test_every_pair_of_columns_meets_once():
    for n in (2, 3, 8, 9):
        pairs = [tuple(sorted(p)) for i, j in whitening._rounds(n) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]
