"""Whitening against numpy's singular values and exact sums in Python, and hard rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenspan.llm import whitening


def graded(rng, n, low):
    u, _ = np.linalg.qr(rng.normal(size=(n, n)))
    v, _ = np.linalg.qr(rng.normal(size=(n, n)))
    return u * np.geomspace(1, low, n) @ v


MATRICES = {
    "random": lambda rng: rng.normal(size=(64, 64)),
    "triangle": lambda rng: np.linalg.qr(rng.normal(size=(500, 30)), mode="r"),
    "identity": lambda rng: np.eye(17),
    "equal_pairs": lambda rng: np.diag(np.repeat([3.0, 3.0, 1.0], 5)),
    "two_equal_blocks": lambda rng: np.kron(np.eye(2), np.linalg.qr(rng.normal(size=(40, 9)), mode="r")),
    "orthogonal": lambda rng: np.linalg.qr(rng.normal(size=(24, 24)))[0] * 5,
    "graded": lambda rng: graded(rng, 20, 1e-9),
    "tridiagonal_twins": lambda rng: np.linalg.cholesky(np.diag(np.abs(np.arange(21) - 10.0) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T,
    "low_rank": lambda rng: rng.normal(size=(16, 3)) @ rng.normal(size=(3, 16)),
    "zero_column": lambda rng: rng.normal(size=(12, 12)) * (np.arange(12) != 4),
    "one": lambda rng: np.array([[-2.0]]),
    "zero": lambda rng: np.zeros((6, 6)),
    "huge": lambda rng: rng.normal(size=(10, 10)) * 1e150,
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_directions(name):
    a = MATRICES[name](np.random.default_rng(len(name)))
    values, z = whitening.factor(a, 99)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(np.sqrt(values), s, rtol=1e-11, atol=1e-13 * (s[0] if len(s) else 1))
    rank = int((s > 1e-12 * max(s[0], 1e-300)).sum())
    assert z.shape[1] == rank
    assert np.abs(z.T @ z - np.eye(rank)).max(initial=0) < 1e-12
    residual = a.T @ (a / max(s[0], 1) @ z) - z * (values[:rank] / max(s[0], 1))
    assert np.abs(residual).max(initial=0) < 1e-12 * max(s[0], 1e-300)


def test_small_values_are_accurate():
    # of a bidiagonal matrix even the smallest values are exact to rounding, whatever the largest
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9, 1e-12]), np.array([1.0, 1e-3, 1e-6, 1e-9])
    from fractions import Fraction

    values = whitening.dqds(a, b)
    det = math.prod(Fraction(x) ** 2 for x in a)
    got = math.prod(Fraction(float(v)) for v in values)
    assert abs(float(got / det) - 1) < 1e-13


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([1.0, 0.1, 1e-5, 0.0]))
def test_bidiagonal_matrices(n, seed, small):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=max(n - 1, 0)) * rng.choice([1.0, small], max(n - 1, 0))
    m = np.diag(a) + np.diag(b, 1)
    values = whitening.dqds(a, b)
    s = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(np.sqrt(values), s, rtol=1e-9, atol=1e-14 * s[0])
    z = whitening.directions(a, b, values)
    assert np.abs(z.T @ z - np.eye(n)).max() < 1e-10
    assert np.abs(m.T @ m @ z - z * values).max() < 1e-12 * s[0] ** 2


def by_hand(rows):
    rows = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    z = n * x - sums
    deviation = (z * z).sum(1)
    y = z.astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return rows, n, deviation, y, e[::-1], v[:, ::-1]


def test_whitening_of_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(9, 9))
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(size=9) @ mix + 5]) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    odd = [(500, None), (501, [nan] * 9), (502, [None] * 9), (503, [inf] + [0.0] * 8), (504, []), (505, [1.0]), (506, [1e300] * 9), (None, rows[0][1]), (3, rows[5][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("component", F.lit("mine")).repartition(7)
    got = whitening.whiten(df, 4).orderBy("vec_id", "deviation", "component").toPandas()
    taken, n, deviation, y, e, v = by_hand(rows + odd[-2:])
    assert len(got) == 4 * n and set(got.n) == {n} and got.vec_id.isna().sum() == 4
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    order = sorted(range(n), key=lambda i: (taken[i][0] is not None, taken[i][0] or 0, int(deviation[i])))
    assert got.deviation.astype(int).tolist() == [int(deviation[i]) for i in order for _ in range(4)]
    want = (y @ v[:, :4] / np.sqrt(e[:4]))[order]
    mine = got.whitened.to_numpy().reshape(n, 4)
    mine = mine * np.sign((mine * want).sum(0))
    assert np.abs(mine - want).max() < 1e-9
    assert np.allclose(got.explained.to_numpy()[:4], e[:4] / e.sum(), rtol=1e-10)


def test_rows_without_directions(spark):
    rows = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>")
    assert whitening.whiten(rows([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(rows([(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whiten(rows([(1, None)])).count() == 0
    assert whitening.whiten(rows([(1, [1.0, 2.0])]).limit(0)).count() == 0
    # two rows differ in one direction
    got = whitening.whiten(rows([(1, [1.0, 2.0]), (2, [1.5, 2.0]), (3, [7.0])])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened)) for r in got] == [(1, 1, 2, 32**2, 1.0), (2, 1, 2, 32**2, 1.0)]
    assert got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-12


def test_large_numbers():
    m = whitening.Whitening(3, [3 * 2**50 + 1, 5], np.empty(0), np.empty((2, 0)), 0.0)
    x = np.array([[2**50 + 7, 1], [-(2**59), 0]])
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, m.sums, strict=True)) for row in x]
    assert m.deviations(x).to_pylist() == [want[0], None]


def test_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.op11_whitening(spark, sf).toPandas()
    taken, n, deviation, y, e, v = by_hand([(r.vec_id, list(map(float, r.embedding))) for r in rows.collect()])
    assert len(got) == 32 * n and got.identity_error[0] < 1e-9
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == {t[0]: int(d) for t, d in zip(taken, deviation, strict=True)}
    assert np.allclose(got[got.vec_id == got.vec_id[0]].sort_values("component").explained, e[:32] / e.sum(), rtol=1e-9)
