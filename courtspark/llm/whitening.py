"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds and twisted factorisations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

COMPONENTS = 8
#: Triangles that one task of the reduction stacks.
FAN_IN = 8
#: Whole numbers stand for entries: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
_EPS = np.finfo(np.float64).eps


class Whitening(NamedTuple):
    """A fitted whitening: rows, sums per dimension, component directions (one a row), their eigenvalues, the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections from either side: diagonal, superdiagonal and V with r = U B V'."""
    m, d = np.array(r, np.float64), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        u, norm = x.copy(), np.linalg.norm(x)
        if norm == 0:
            return u, 0.0
        u[0] += norm if u[0] >= 0 else -norm
        return u, 2.0 / (u @ u)

    for k in range(d):
        u, beta = reflector(m[k:, k])
        m[k:, k:] -= np.outer(beta * u, u @ m[k:, k:])
        if k + 2 < d:
            u, beta = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ u, beta * u)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ u, beta * u)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _sweep(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step with shift ``tau`` and its least pivot; None where a pivot turned negative."""
    d, least, qs, es = q[0] - tau, q[0] - tau, [], []
    for i, x in enumerate(e):
        if d < 0:
            return None
        qs.append(d + x)
        t = q[i + 1] / qs[i] if qs[i] else 0.0
        es.append(x * t)
        d = d * t - tau
        least = min(least, d)
    return None if d < 0 else ([*qs, d], es, least)


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal (a, b) by dqds, largest first.

    Shifts are subtracted for good and added up; a shift that drives a pivot below zero is cut to a quarter and then
    to none, which never fails. An off-diagonal that is negligible beside its neighbours splits the array.
    """
    found: list[float] = []
    todo = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)] if len(a) else []
    while todo:
        q, e, shift = todo.pop()
        if len(q) > 1 and 1.5 * q[0] < q[-1]:
            q, e = q[::-1], e[::-1]
        least = 0.0
        for _ in range(200 * len(q) + 200):
            while len(q) > 1 and e[-1] <= _EPS**2 * (shift + q[-1]):
                found.append(shift + q.pop())
                e.pop()
                least = 0.0
            if len(q) == 1:
                found.append(shift + q[0])
                break
            if cut := next((i + 1 for i, x in enumerate(e) if x <= _EPS**2 * (shift + min(q[i], q[i + 1]))), 0):
                todo += [(q[:cut], e[: cut - 1], shift), (q[cut:], e[cut:], shift)]
                break
            for tau in (0.98 * least, 0.25 * least, 0.0):
                if (swept := _sweep(q, e, tau)) is not None:
                    q, e, least = swept
                    shift += tau
                    break
        else:
            raise ArithmeticError("dqds did not settle")
    return np.sort(np.array(found))[::-1]


def _factors(a: np.ndarray, b: np.ndarray, lam: float):
    """Stationary and progressive qd of B'B - lam: L+, D+, U-, and gamma, the pivot left by a twist at each place."""
    d, n = a * a, len(a)
    low, dplus, s = np.zeros(n), np.zeros(n), np.zeros(n)
    up, p = np.zeros(n), np.zeros(n)
    tiny = _EPS**2 * max(float(d.max()), 1e-300)
    guard = lambda x: x if abs(x) > tiny else tiny
    ell = b / a[:-1]
    for i in range(n):
        dplus[i] = guard(d[i] + s[i] - lam)
        if i + 1 < n:
            low[i] = d[i] * ell[i] / dplus[i]
            s[i + 1] = low[i] * ell[i] * (s[i] - lam)
    p[n - 1] = d[n - 1] - lam
    for i in range(n - 2, -1, -1):
        t = d[i] / guard(d[i] * ell[i] ** 2 + p[i + 1])
        up[i] = ell[i] * t
        p[i] = p[i + 1] * t - lam
    return low, dplus, up, s + p


def _twisted(low: np.ndarray, up: np.ndarray, k: int) -> np.ndarray:
    z = np.zeros(len(low))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(k, len(low) - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _solved(low: np.ndarray, dplus: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(L+ D+ L+') x = z."""
    x = z.copy()
    for i in range(1, len(x)):
        x[i] -= low[i - 1] * x[i - 1]
    x /= dplus
    for i in range(len(x) - 2, -1, -1):
        x[i] -= low[i] * x[i + 1]
    return x


def _apart(z: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """What of ``z`` is orthogonal to ``near``; taken off twice, so that rounding leaves nothing."""
    for w in near + near:
        z = z - (w @ z) * w
    return z


def right_vectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of the bidiagonal for its leading ``squares``, one a row.

    Each comes from the twisted factorisation of B'B - lambda with the least twist pivot. Values that agree to three
    digits share their vectors' plane: those are made orthogonal, with inverse iteration where that leaves too little.
    """
    a = np.where(np.abs(a) > _EPS * np.abs(a).max() * 1e-3, a, _EPS * np.abs(a).max() * 1e-3)
    out: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    for j, lam in enumerate(squares):
        low, dplus, up, gamma = _factors(a, b, float(lam))
        z = _twisted(low, up, int(np.argmin(np.abs(gamma))))
        near = [out[i] for i in range(j) if squares[i] - lam <= 1e-3 * squares[i]]
        for _ in range(6 if near else 0):
            size = np.linalg.norm(z := _apart(z, near))
            if size > 0.5:
                break
            start = z / size if size > 1e-3 else _apart(rng.standard_normal(len(a)), near)
            z = _solved(low, dplus, start)
            z /= np.linalg.norm(z)
        z = _apart(z, near)
        z /= np.linalg.norm(z)
        out.append(z)
    return np.array(out).reshape(len(out), len(a))


def decompose(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (one a row, largest entry positive) of a triangle and their squared values;
    as many as ``components`` or the numerical rank, if that is less."""
    a, b, v = bidiagonal(r)
    squares = squared_singular_values(a, b)
    rank = int((squares > (len(a) * _EPS) ** 2 * squares[0]).sum()) if len(squares) else 0
    squares = squares[: min(components, rank)]
    z = right_vectors(a, b, squares) @ v.T if len(squares) else np.empty((0, len(r)))
    for row in z:
        row *= np.sign(row[np.argmax(np.abs(row))])
    return z, squares


def whole_numbers(vector: str | Column) -> Column:
    """The entries as longs, null where the vector is null, empty, or holds a null or non-finite entry."""
    c = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return F.when((F.size(c) > 0) & finite, F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _sums(x: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension: added up batch by batch as longs, over batches as decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(range(m.shape[1]), pa.int32()), pa.array([len(m)] * m.shape[1], pa.int64()), pa.array(m.sum(axis=0), pa.int64())], ["k", "n", "s"])

    parts = x.mapInArrow(add, "k int, n long, s long")
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).orderBy("k").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _centred(m: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S exactly, and x - S / n as doubles; whole numbers of any size where longs would not hold them."""
    wide = float(np.abs(m).max(initial=0)) * n >= 2.0**62
    apart = (m.astype(object) if wide else m) * n - (sums.astype(object) if wide else sums)
    return apart, (apart / n).astype(np.float64)


def _triangle(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: each task folds its batches into one triangle; tasks' triangles are stacked ``FAN_IN``
    at a time until one is left."""
    d = len(sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, s = np.empty((0, d)), np.array(sums, np.int64)
        for b in batches:
            if b.num_rows:
                r = np.linalg.qr(np.vstack([r, _centred(_matrix(b.column(1)), n, s)[1]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["id", "r"])

    def stack(key: tuple, rows: pa.Table) -> pa.Table:
        of = [np.frombuffer(v.as_py()).reshape(-1, d) for v in rows.sort_by("id").column("r")]
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([np.linalg.qr(np.vstack(of), mode="r").tobytes()], pa.binary())})

    parts = table(x.mapInArrow(fold, "id long, r binary"), "triangles")
    while parts.count() > 1:
        keyed = parts.withColumn("g", F.floor(F.col("id") / FAN_IN))
        parts = table(keyed.groupBy("g").applyInArrow(stack, "id long, r binary"), "triangles")
    r = np.frombuffer(parts.first()["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): the rows that can be whitened. Lengths must agree; rows of another length than most are left out."""
    x = rows.select(F.col(key).cast("long").alias("key"), whole_numbers(vector).alias("x")).where("x is not null")
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()
    return x if len(lengths) < 2 else x.where(F.size("x") == lengths[0]["d"])


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on all rows of ``usable``. The driver holds sums and one triangle: d and d * d numbers for d dimensions."""
    n, sums = _sums(x)
    if not n:
        return Whitening(0, [], np.empty((0, 0)), np.empty(0), 0.0)
    r = _triangle(x, n, sums)
    directions, squares = decompose(r, components)
    return Whitening(n, sums, directions, squares / n, float((r * r).sum() / n))


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """(key, deviation, whitened): the exact sum of (n x - S)^2 and one number for each component of ``model``."""
    n, sums, w = model.n, model.sums, model.directions.T / np.sqrt(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            apart, centred = _centred(_matrix(b.column(1)), n, s)
            if float(np.abs(apart).max(initial=0)) ** 2 * len(s) >= 2.0**62:
                apart = apart.astype(object)
            flat = pa.array((centred @ w).ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((apart * apart).sum(axis=1), pa.int64()), lists], ["key", "deviation", "whitened"])

    return x.mapInArrow(project, "key long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity. Rows are centred before they
    are projected; the mean that rounding leaves is taken off."""
    k = len(model.eigenvalues)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                total += np.vstack([m.T @ m, m.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "s"])

    sums = whitened.select("whitened").mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").toArrow()
    m = sums.column("s").to_numpy().reshape(k + 1, k) / model.n
    return float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())


def whitening(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """For each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries give nothing, nor do rows of another length
    than most. Entries become whole numbers; the covariance of these (divisor n) has ``components`` leading unit
    eigenvectors, fewer where its rank is less: equal vectors throughout have no direction and give no rows.
    Directions of equal eigenvalues are any orthonormal ones of their plane. Repeated rows and null keys are kept as
    rows of their own; an empty table gives no rows; other columns play no part. A deviation beyond a long is an error.
    """
    x = usable(rows, vector, key)
    model = fit(x, components)
    out = whiten(x, model) if len(model.eigenvalues) else x.sparkSession.createDataFrame([], "key long, deviation long, whitened array<double>")
    error = identity_error(out, model) if len(model.eigenvalues) else 0.0
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    at = out.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return at.select(
        F.col("key").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all embeddings."""
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
SQL: dict[str, str] = {}
