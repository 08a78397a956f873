"""Whitening of embeddings by singular values of the centred rows, without forming their covariance.

    1. sums       n and exact sums of the integer rows, in two halves of 32 bits
    2. rows       each task reduces its centred rows block by block to one triangle R; triangles meet in a tree
    3. values     Householder reflections make R bidiagonal; dqds finds its singular values to high relative accuracy
    4. directions twisted factorisations of B'B - lambda, which begin and end elimination at the row where the
                  eigenvector is largest; directions whose values nearly agree are made orthogonal to each other
    5. output     centred rows on the directions, over the root of the eigenvalue; their covariance is measured on the
                  rows themselves in a pass of its own

Steps 3 and 4 see one matrix of dims x dims (MOST_DIMS at most); all else is done by row in tasks.

Defined results: vectors that are null or empty, or hold null or non-finite entries or entries too large for a long,
take no part; of vectors of different lengths the most frequent length takes part (of equal ones the longest); rows of
a null or repeated vec_id are rows of their own; other columns are not looked at; directions in which the rows don't
vary, up to rounding, can't be whitened and have no rows, so equal vectors, a single row and an empty table give none;
a deviation that doesn't fit a long is null (n^2 times a squared distance reaches 2^63 at some 10^7 rows).
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, column, table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Entries of a vector at most; rows of a block; triangles that one task of the tree takes.
MOST_DIMS, BLOCK, FAN = 4_096, 2_048, 16
_EPS = np.finfo(float).eps
#: Squares below this share of the largest count as this share, so that no quotient is 0 / 0.
_TINY = 1e-280


# -- singular values and directions of one triangle -------------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta of I - beta v v', which sends x to a multiple of the first axis."""
    v = x.astype(float)
    top = np.abs(v).max(initial=0.0)
    if len(v) < 2 or not np.abs(v[1:]).any():
        return v, 0.0
    v = v / top
    v[0] += math.copysign(float(np.sqrt(v @ v)), v[0])
    return v, 2.0 / float(v @ v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal and superdiagonal of B in r = U B W', and the reflections whose product is W."""
    a, d, right = r.astype(float), len(r), []
    for k in range(d):
        v, beta = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        v, beta = _reflector(a[k, k + 1 :])
        if beta:
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, beta * v)
            right.append((k + 1, v, beta))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _newton(q: list[float], e: list[float]) -> float:
    """A lower bound of the smallest eigenvalue: 1 over the trace of the inverse, whose diagonal an unshifted sweep gives."""
    d, total = q[0], 0.0
    for k in range(len(e)):
        total += 1 / d if d > _TINY else math.inf
        d *= q[k + 1] / max(d + e[k], _TINY)
    total += 1 / d if d > _TINY else math.inf
    return 1 / total


def _sweep(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None if tau was beyond the smallest eigenvalue."""
    d, new_q, new_e = q[0] - tau, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        x = max(d + e[k], _TINY)
        t = q[k + 1] / x
        new_q.append(x)
        new_e.append(e[k] * t)
        d = d * t - tau
    return None if d < 0 else ([*new_q, d], new_e)


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix (a, b), in falling order."""
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if top == 0:
        return np.zeros(len(a))
    tol = (10 * _EPS) ** 2
    found: list[float] = []
    work = [([max(float(x / top) ** 2, _TINY) for x in a], [float(x / top) ** 2 for x in b], 0.0)]
    while work:
        q, e, shift = work.pop()
        while q:
            if len(q) == 1 or e[-1] <= tol * (shift + q[-1]):
                found.append(shift + q.pop())
                if e:
                    e.pop()
                continue
            cut = next((k for k in range(len(e) - 1) if e[k] <= tol * q[k]), None)
            if cut is not None:  # two matrices of their own
                work.append((q[: cut + 1], e[:cut], shift))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1] / 1.5:  # the small end comes last
                q.reverse()
                e.reverse()
            tau = _newton(q, e) * (1 - 1e-12)
            while (out := _sweep(q, e, tau)) is None:
                tau = tau / 2 if tau > _TINY else 0.0
            q, e = out
            shift += tau
    return np.sort(np.array(found))[::-1] * top * top


def _twisted(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all values: multipliers of B'B - value from the top and from the bottom, and gamma of each row where both may meet."""
    n, m = len(a), len(values)
    with np.errstate(all="ignore"):
        diag, low = a * a, np.append(b, 0.0) / a
        down, up = np.zeros((n, m)), np.zeros((n, m))
        s, p = np.empty((n, m)), np.empty((n, m))
        small = _EPS * _EPS * max(float(values.max(initial=0.0)), float(diag.max(initial=0.0)))
        safe = lambda x: np.where(np.abs(x) < small, np.copysign(small, x), x)
        s[0], p[-1] = -values, diag[-1] - values
        for k in range(n - 1):
            down[k] = diag[k] * low[k] / safe(s[k] + diag[k])
            s[k + 1] = down[k] * low[k] * s[k] - values
        for k in range(n - 2, -1, -1):
            p[k + 1] = safe(p[k + 1])
            t = diag[k] / safe(diag[k] * low[k] ** 2 + p[k + 1])
            up[k] = low[k] * t
            p[k] = p[k + 1] * t - values
    return down, up, s + p + values


def _vector(down: np.ndarray, up: np.ndarray, at: int) -> np.ndarray:
    """The unit vector that solves a twisted factorisation whose middle is row `at`."""
    z = np.zeros(len(down))
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, len(z) - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors of B'B, a column for each value (squares of singular values, in falling order)."""
    top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) or 1.0
    a, b, values = np.where(np.abs(a) < 1e-140 * top, 1e-140 * top, a) / top, b / top, values / top**2
    down, up, gamma = _twisted(a, b, values)
    gamma = np.where(np.isfinite(gamma), np.abs(gamma), np.inf)
    out, first = np.empty((len(a), len(values))), 0
    for j in range(len(values)):
        if j and values[j - 1] - values[j] > 1e-2 * values[j - 1]:
            first = j
        own = out[:, first:j]
        # where values agree, another row's twist gives another direction of their common space
        best, most = None, 0.0
        for at in np.argsort(gamma[:, j], kind="stable"):
            z = _vector(down[:, j], up[:, j], int(at))
            if not np.isfinite(z).all():
                continue
            left = z - own @ (own.T @ z)
            size = float(np.linalg.norm(left))
            if size > most:
                best, most = left / size, size
            if most > 0.5:
                break
        best = np.eye(len(a))[j] if best is None else best
        best = best - own @ (own.T @ best)
        out[:, j] = best / np.linalg.norm(best)
    return out


def factor(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a triangle: its singular values' squares (all of them), and the right singular vectors of the first `most` that aren't 0 up to rounding."""
    a, b, right = bidiagonalise(r)
    values = dqds(a, b)
    rank = int((np.sqrt(values) > 8 * len(r) * _EPS * math.sqrt(values[0])).sum()) if len(values) and values[0] > 0 else 0
    z = directions(a, b, values[: min(rank, most)])
    for first, v, beta in reversed(right):
        z[first:] -= np.outer(beta * v, v @ z[first:])
    return values, z


# -- passes over the rows ----------------------------------------------------------------------------------------------


@dataclasses.dataclass
class Whitening:
    """n rows, exact sums of their entries, eigenvalues and directions (columns) of their covariance, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is taken off in whole numbers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(float) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        most = int(np.abs(x - whole).max(initial=0)) + 1
        if (most * self.n) ** 2 * x.shape[1] < 2**63:
            z = self.n * (x - whole) - rest
            return pa.array((z * z).sum(1))
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def valid_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, e: doubles) of the vectors that take part, and their length."""
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**60 // SCALE)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("e").isNotNull() & (F.size("e") > 0) & good)
    first = rows.groupBy(F.size("e").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = first[0]["dims"] if first else 0
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries; {MOST_DIMS} at most")
    return rows.where(F.size("e") == dims), dims


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows, BLOCK at a time."""
    for b in batches:
        for start in range(0, len(b), BLOCK):
            part = b.slice(start, BLOCK)
            e = column(part, "e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield column(part, "vec_id"), np.floor(SCALE * e).astype(np.int64) + SHIFT


def _reduced(rows: DataFrame, dims: int, start: Callable[[Iterator], np.ndarray | None], meet: Callable[[list[np.ndarray]], np.ndarray], parts: int) -> np.ndarray | None:
    """One array from all rows: each task has one from its blocks, FAN of them meet in a task, and so on."""

    def run(batches):
        from pyspark import TaskContext

        got = start(_blocks(batches, dims))
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([got.tobytes()], pa.binary())], ["slot", "data"])

    def together(t: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(x, float) for x in t.sort_by("slot").column("data").to_pylist()]
        return pa.table({"slot": pa.array([t.column("slot")[0].as_py() // FAN], pa.int64()), "data": pa.array([meet(arrays).tobytes()], pa.binary())})

    out = rows.mapInArrow(run, "slot long, data binary")
    while parts > FAN:
        out = out.groupBy(F.floor(F.col("slot") / FAN)).applyInArrow(together, "slot long, data binary")
        parts = -(-parts // FAN)
    arrays = [np.frombuffer(r["data"], float) for r in out.orderBy("slot").collect()]
    return meet(arrays) if arrays else None


def fit(rows: DataFrame, dims: int, most: int = COMPONENTS) -> tuple[Whitening | None, int]:
    """The whitening of all rows (None if there are none), and how many partitions they have."""

    def sums(batches):
        from pyspark import TaskContext

        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for _, x in _blocks(batches, dims):
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        at = np.arange(dims)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(dims, TaskContext.get().partitionId())), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], ["dim", "part", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = rows.mapInArrow(sums, "dim long, part long, n long, high long, low long").groupBy("dim").agg(F.max("part").alias("part"), F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("dim").collect() if dims else []
    if not got or not got[0]["n"]:
        return None, 0
    n, parts = got[0]["n"], got[0]["part"] + 1
    model = Whitening(n, [(int(r["high"]) << 32) + int(r["low"]) for r in got], np.empty(0), np.empty((dims, 0)), 0.0)

    def triangle(blocks):
        r = None
        for _, x in blocks:
            y = model.centred(x)
            r = np.linalg.qr(y if r is None else np.vstack([r, y]), mode="r")
        return r

    r = _reduced(rows, dims, triangle, lambda some: np.linalg.qr(np.vstack([x.reshape(-1, dims) for x in some]), mode="r"), parts)
    square = np.zeros((dims, dims))
    square[: len(r)] = r
    values, vectors = factor(square, most)
    return dataclasses.replace(model, values=values[: vectors.shape[1]] / n, vectors=vectors, trace=float((square**2).sum()) / n), parts


def identity_error(rows: DataFrame, dims: int, model: Whitening, parts: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity: means and centred products of blocks, which meet."""
    k = len(model.values)
    pack = lambda n, mean, m2: np.concatenate([[n], mean, m2.ravel()])

    def meet(some):
        n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
        for x in some:
            d = x[1 : k + 1] - mean
            both = n + x[0]
            m2 = m2 + x[k + 1 :].reshape(k, k) + np.outer(d, d) * (n * x[0] / both)
            n, mean = both, mean + d * (x[0] / both)
        return pack(n, mean, m2)

    def moments(blocks):
        out = None
        for _, x in blocks:
            w = model.whitened(x)
            c = w - w.mean(0)
            one = pack(len(w), w.mean(0), c.T @ c)
            out = one if out is None else meet([out, one])
        return out

    got = _reduced(rows, dims, moments, meet, parts)
    return float(np.abs(got[k + 1 :].reshape(k, k) / got[0] - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    bounded_batches(embeddings.sparkSession)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = valid_vectors(embeddings)
    model, parts = fit(rows, dims, components)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, dims, model, parts)
    k = len(model.values)

    def run(batches):
        number, explained = np.arange(1, k + 1, dtype=np.int32), model.values / model.trace
        for ids, x in _blocks(batches, dims):
            each = pa.array(np.repeat(np.arange(len(x)), k))
            values = [ids.take(each), np.tile(number, len(x)), np.full(len(x) * k, model.n), model.deviations(x).take(each), model.whitened(x).ravel(), np.tile(explained, len(x)), np.full(len(x) * k, error)]
            yield pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in values], [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings` on their first 32 whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))
