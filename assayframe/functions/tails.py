"""Tail probabilities Spark has no native form for, as Arrow functions over whole batches.

Regularised incomplete beta by its continued fraction (modified Lentz), normal tail by ``erfc``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from assayframe.session import ship

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(np.asarray(x, dtype=float)).astype(float)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    live = np.ones(x.shape, dtype=bool)
    for m in range(1, 200_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = step * d * c
        h = np.where(live, h * step, h)
        live &= np.abs(step - 1.0) > 1e-15
        if not live.any():
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), accurate relative to its own size in the lower tail."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    inner = ok & (x > 0) & (x < 1)
    if inner.any():
        ai, bi, xi = a[inner], b[inner], x[inner]
        swap = xi > (ai + 1) / (ai + bi + 2)
        p, q, z = np.where(swap, bi, ai), np.where(swap, ai, bi), np.where(swap, 1 - xi, xi)
        front = np.exp(
            log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)
        ) / p
        tail = front * _beta_fraction(p, q, z)
        out[inner] = np.where(swap, 1 - tail, tail)
    return out


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_lower(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_inc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2))


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d1 * f + d2))


def f_quantile(prob: float, d1: float, d2: float) -> float:
    """Value below which an F variable falls with probability ``prob`` (bisection)."""
    lo, hi = 0.0, 1.0
    while float(f_lower(np.array([hi]), d1, d2)[0]) < prob:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if float(f_lower(np.array([mid]), d1, d2)[0]) < prob:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def f_quantiles(prob, d1, d2) -> np.ndarray:
    """``f_quantile`` row by row, by bisection on the logarithm of F; each row's tail is taken on its smaller side."""
    prob, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (prob, d1, d2)))
    ok = (prob > 0) & (prob < 1) & (d1 > 0) & (d2 > 0)
    p, a, b = (np.where(ok, v, w) for v, w in ((prob, 0.5), (d1, 1.0), (d2, 1.0)))
    below = lambda x: np.where(p < 0.5, f_lower(np.exp(x), a, b) < p, f_upper(np.exp(x), a, b) > 1 - p)
    lo, hi = np.full(p.shape, -1.0), np.full(p.shape, 1.0)
    for _ in range(60):
        short, far = below(hi), ~below(lo)
        if not (short.any() or far.any()):
            break
        lo, hi = np.where(far, lo * 2, lo), np.where(short, hi * 2, hi)
    for _ in range(80):
        mid = (lo + hi) / 2
        right = below(mid)
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    return np.where(ok, np.exp((lo + hi) / 2), np.nan)


def t_quantile(prob, df) -> np.ndarray:
    """Upper-half quantile of Student's t (``prob`` >= 0.5), bisected on the two-sided tail."""
    prob, df = np.broadcast_arrays(np.asarray(prob, dtype=float), np.asarray(df, dtype=float))
    target = 2 * (1 - prob)
    ok = np.isfinite(df) & (df > 0)
    safe = np.where(ok, df, 1.0)
    lo, hi = np.zeros(safe.shape), np.ones(safe.shape)
    for _ in range(1100):
        grow = t_two_sided(hi, safe) > target
        if not grow.any():
            break
        hi = np.where(grow, hi * 2, hi)
    for _ in range(120):
        mid = (lo + hi) / 2
        right = t_two_sided(mid, safe) > target
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    return np.where(ok, (lo + hi) / 2, np.nan)


def normal_two_sided(z) -> np.ndarray:
    z = np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0)
    return _erfc(z).astype(float)


def _as_series(values: np.ndarray, valid: np.ndarray) -> pd.Series:
    return pd.Series(np.where(valid, values, np.nan)).astype(object).where(valid, None)


def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = (t.notna() & df.notna()).to_numpy()
    return _as_series(t_two_sided(t.fillna(0.0), df.fillna(1.0)), ok)


def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ok = (f.notna() & d1.notna() & d2.notna()).to_numpy()
    f, d1, d2 = f.fillna(1.0), d1.fillna(1.0), d2.fillna(1.0)
    both = 2 * np.minimum(f_lower(f, d1, d2), f_upper(f, d1, d2))
    return _as_series(np.minimum(both, 1.0), ok)


def _normal_p(z: pd.Series) -> pd.Series:
    ok = z.notna().to_numpy()
    return _as_series(normal_two_sided(z.fillna(0.0)), ok)


def _t_q(prob: pd.Series, df: pd.Series) -> pd.Series:
    ok = (prob.notna() & df.notna()).to_numpy()
    return _as_series(t_quantile(prob.fillna(0.5), df.fillna(1.0)), ok)


def _f_q(prob: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ok = (prob.notna() & d1.notna() & d2.notna()).to_numpy()
    return _as_series(f_quantiles(prob.fillna(0.5), d1.fillna(1.0), d2.fillna(1.0)), ok)


def _vectorised(fn):
    """Arrow function for the running session (made per use, so that it never outlives its context)."""
    ship()
    return F.pandas_udf(fn, T.DoubleType())


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return _vectorised(_t_p)(t.cast("double"), df.cast("double"))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    """Two-sided p of a variance ratio: twice the smaller tail."""
    return _vectorised(_f_p)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def normal_p_value(z: Column) -> Column:
    """Two-sided p of a standard normal statistic."""
    return _vectorised(_normal_p)(z.cast("double"))


def t_critical(prob: Column, df: Column) -> Column:
    return _vectorised(_t_q)(prob.cast("double"), df.cast("double"))


def f_critical(prob: Column, d1: Column, d2: Column) -> Column:
    return _vectorised(_f_q)(prob.cast("double"), d1.cast("double"), d2.cast("double"))
