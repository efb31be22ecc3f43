"""Whitening of embeddings by their leading principal components, found by slicing the spectrum.

The number of eigenvalues of a symmetric matrix above a shift is the number of positive pivots of the factorisation L D L' of the shifted
matrix (Sylvester's law of inertia). Bisection on these counts isolates each leading eigenvalue; Rayleigh quotient iteration then
converges to it cubically, and counts on both sides of the result certify that it has the number it claims. Equal eigenvalues, which no shift
separates, are found as one cluster with an orthonormal basis.

Only sums over the vectors are distributed work. What comes back to the driver has the size of the covariance, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.llm.common import durable

COMPONENTS = 8


def inertia(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of symmetric ``a`` above ``shift``, by L D L' with symmetric pivoting (blocks of one or two rows)."""
    m = a - shift * np.eye(len(a))
    tiny, above = np.finfo(float).eps * max(1e-300, np.abs(a).max()), 0
    bound = (1 + math.sqrt(17)) / 8
    while len(m):
        diagonal = np.abs(np.diag(m))
        p = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        i, j = divmod(int(off.argmax()), len(m))
        if diagonal[p] >= bound * off[i, j]:
            d = m[p, p]
            above += d > 0
            rest = np.delete(np.arange(len(m)), p)
            if abs(d) <= tiny:  # what is left is zero up to rounding: eigenvalues at the shift, counted as not above it
                return above
            m = m[np.ix_(rest, rest)] - np.outer(m[rest, p], m[p, rest]) / d
        else:  # a block of two rows with a negative determinant: one eigenvalue on either side
            above += 1
            rest = np.delete(np.arange(len(m)), [i, j])
            m = m[np.ix_(rest, rest)] - m[np.ix_(rest, [i, j])] @ np.linalg.solve(m[np.ix_([i, j], [i, j])], m[np.ix_([i, j], rest)])
        m = (m + m.T) / 2
    return above


def _isolate(a: np.ndarray, k: int, low: float, high: float, width: float) -> tuple[float, float]:
    """Interval around the ``k``-th largest eigenvalue that holds no other, or is narrower than ``width``."""
    above_low, above_high = inertia(a, low), inertia(a, high)
    while high - low > width and not (above_low == k and above_high == k - 1):
        middle = (low + high) / 2
        if (n := inertia(a, middle)) >= k:
            low, above_low = middle, n
        else:
            high, above_high = middle, n
    return low, high


def _solved(m: np.ndarray, v: np.ndarray, nudge: float) -> np.ndarray:
    """Unit solution of ``m x = v``; a shift that is an eigenvalue to the last digit is nudged first."""
    try:
        x = np.linalg.solve(m, v)
        if np.isfinite(x).all():
            x /= np.abs(x).max()
            return x / np.linalg.norm(x)
    except np.linalg.LinAlgError:
        pass
    return _solved(m - nudge * np.eye(len(m)), v, 2 * nudge)


def _refine(a: np.ndarray, low: float, high: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of the interval; None if it leaves the interval for a neighbour."""
    d, norm = len(a), float(np.abs(a).sum(axis=1).max())
    slack = 8 * d * np.finfo(float).eps * norm
    v, shift, best = np.random.default_rng(seed).standard_normal(d), (low + high) / 2, math.inf
    value, kept = shift, v
    for step in range(60):
        v = _solved(a - shift * np.eye(d), v, 4 * np.finfo(float).eps * norm)
        for f in [*found, *found]:
            v = v - (f @ v) * f
        v /= np.linalg.norm(v)
        quotient = float(v @ a @ v)
        residual = float(np.linalg.norm(a @ v - quotient * v))
        if low - slack <= quotient <= high + slack and residual < best:
            best, value, kept = residual, quotient, v
        elif step > 6 and best < 1e-10 * norm:
            break
        # The first two steps stay in the middle of the interval.
        if step and low <= quotient <= high:
            shift = quotient
    return (value, kept) if best < 1e-10 * norm else None


def leading(a: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues of a covariance (falling) and their unit eigenvectors (rows); those that are zero up to rounding are left out.

    Each number is certified: as many eigenvalues lie above it as its place says, up to the rounding of the matrix.
    """
    d = len(a)
    if not d or not np.abs(a).max() > 0:
        return np.zeros(0), np.zeros((0, d))
    scale = float(np.abs(a).sum(axis=1).max())
    a, norm = a / scale, 1.0
    eps = d * np.finfo(float).eps
    values: list[float] = []
    vectors: list[np.ndarray] = []
    top = norm * (1 + 1e-12) + eps
    for k in range(1, min(most, inertia(a, eps)) + 1):
        low, high = _isolate(a, k, 0.0, top, 4 * eps)
        while True:
            value, v = _refine(a, low, high, vectors, k) or (None, None)
            if v is not None and inertia(a, value + 8 * eps) <= k - 1 and inertia(a, value - 8 * eps) >= k:
                break
            if high - low <= 4 * eps:
                raise ArithmeticError(f"the counts do not certify eigenvalue {k}")
            for _ in range(3):  # a neighbour is nearer to the middle: narrow the interval
                middle = (low + high) / 2
                low, high = (middle, high) if inertia(a, middle) >= k else (low, middle)
        values.append(value)
        vectors.append(v if v[np.abs(v).argmax()] > 0 else -v)
    return scale * np.array(values), np.array(vectors).reshape(-1, d)


def clean_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite entries and full length, with ``x`` = floor(1024 c) + 100000 as longs in place of the vector.

    A vector shorter than the longest one lacks entries, which count as null; so do entries too large for a long. Empty vectors go.
    """
    c = F.col(vector).cast("array<double>")
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0**52)))
    x = F.transform(c, lambda v: F.floor(v * 1024).cast("long") + 100000)
    rows = df.where(F.col(vector).isNotNull() & whole & (F.size(vector) > 0))
    longest = df.agg(F.max(F.size(vector))).head()[0] or 0
    return rows.where(F.size(vector) == longest).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.names.index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(rows: DataFrame, of) -> np.ndarray:
    """Sum over all rows of the outer products of ``of(x)``: one small matrix per task, added up entry by entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                if part.num_rows:
                    y = of(_matrix(part))
                    total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    entries = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max((r["j"] for r in entries), default=-1)
    out = np.zeros((d, d))
    for r in entries:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def whiten(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``df`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit covers all remaining vectors: exact sums, then products of centred vectors. Null and repeated vec_ids are rows like others, other columns
    are ignored. Without a remaining vector, or where all are equal, there is no component and no row. Components with eigenvalue zero are left out.
    ``deviation`` is exact; null if it exceeds a long.
    """
    rows = durable(clean_vectors(df, vector))
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    n = sums[0]["n"] if sums else 0
    exact = [int(r["s"]) for r in sums]
    mean = np.array([s / n for s in exact])
    covariance = _products(rows, lambda x: x - mean) / max(1, n)
    values, vectors = leading(covariance, most)
    project = (vectors / np.sqrt(values)[:, None]).T
    # The covariance of the whitened vectors, as measured on them; their mean is taken out with an extra column of ones.
    second = _products(rows, lambda x: np.hstack([(x - mean) @ project, np.ones((len(x), 1))])) / max(1, n)
    if len(values):
        inner, middle = second[:-1, :-1], second[:-1, -1]
        error = float(np.abs(inner - np.outer(middle, middle) - np.eye(len(values))).max())
        explained = values / np.trace(covariance)
    # y = x - round(S / n) is small, so (n x - S) = n y - r is exact in longs and its squares in Python's integers.
    centre = [round(s / n) for s in exact] if n else []
    left = [s - n * c for s, c in zip(exact, centre)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for b in batches:
            for at in range(0, b.num_rows if k else 0, 4096):
                part = b.slice(at, 4096)
                x = _matrix(part)
                m = len(x)
                if not m:
                    continue
                y = x - np.array(centre)
                # sum (n y - r)^2 = n^2 sum y^2 - 2 n sum r y + sum r^2
                wide = np.int64 if max(n, 2 * int(np.abs(y).max())) * int(np.abs(y).max()) * len(centre) < 1 << 62 else object
                y = y.astype(wide)
                squares, cross = (y * y).sum(axis=1), (y * np.array(left, dtype=wide)).sum(axis=1)
                spread = [n * n * int(a) - 2 * n * int(c) + sum(v * v for v in left) for a, c in zip(squares, cross)]
                z = (x - mean) @ project
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array([v if v < 1 << 63 else None for v in spread for _ in range(k)], pa.int64()), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
