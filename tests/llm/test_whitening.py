import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from assayframe.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, x long, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "c") for i, v in rows], SCHEMA)


def brute(rows, most=8):
    """Plain covariance and a dense eigensolver; deviations in fractions."""
    d = max((len(v) for _, v in rows if v is not None), default=0)
    kept = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    mean = np.array([float(Fraction(int(s), n)) for s in sums])
    y = x.astype(float) - mean
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > d * 1e-13 * max(e)).sum()))
    return [i for i, _ in kept], deviation, y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), n


def test_against_dense_solver(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(12, 12)) * np.linspace(2, 0.1, 12)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 12)) @ mix)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] * 12), (904, []), (905, [1.0] * 5)]
    got = wh.whiten(frame(spark, rows)).collect()
    ids, deviation, z, share, n = brute(rows)
    assert len(got) == len(ids) * 8 and {r.n for r in got} == {n} and all(0 <= r.identity_error <= 1e-9 for r in got)
    first = {i: k for k, i in enumerate(ids)}
    signs = {}
    for r in got:
        k, c = first[r.vec_id], r.component - 1
        assert r.deviation == deviation[k] and abs(r.explained - share[c]) <= 1e-12
        if abs(z[k, c]) > 1e-3:
            signs.setdefault(c, round(r.whitened / z[k, c]))
            assert abs(r.whitened - signs[c] * z[k, c]) < 1e-8
    assert set(signs) == set(range(8)) and set(signs.values()) <= {1, -1}


def test_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = wh.op12_whitening(spark, folder).collect()
    ids, deviation, z, share, _ = brute(rows)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == 8 * len(ids)
    for c in range(8):
        column = np.array([by[i, c + 1].whitened for i in ids])
        assert min(np.abs(column - z[:, c]).max(), np.abs(column + z[:, c]).max()) < 1e-8
        assert all(by[i, c + 1].deviation == d for i, d in zip(ids, deviation)) and abs(by[ids[0], c + 1].explained - share[c]) < 1e-12


def test_few_and_equal_vectors(spark):
    assert wh.whiten(frame(spark, [])).collect() == []
    assert wh.whiten(frame(spark, [(1, None), (2, [float("nan")])])).collect() == []
    assert wh.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []
    got = wh.whiten(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 12)), round(r.explained, 12)) for r in got) == [(1, 1, 2, 1024**2, 1.0, 1.0), (2, 1, 2, 1024**2, 1.0, 1.0)]
    huge = wh.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [1e15, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {r.vec_id for r in huge} == {2, 3} and {r.deviation for r in huge} == {None}


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 9), st.integers(0, 10**6), st.sampled_from(["random", "ties", "low"]))
def test_counts_and_pairs(d, seed, kind):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = np.sort(rng.uniform(0.1, 5, d))[::-1]
    if kind == "ties":
        e = np.sort(rng.choice([1.0, 2.0, 3.0], d))[::-1]
    if kind == "low":
        e[d // 2 + 1:] = 0
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    for shift in (0.05, 0.77, 1.5, 2.5, 4.9):
        if np.abs(e - shift).min() > 1e-9:
            assert wh.inertia(a, shift) == (e > shift).sum()
            assert wh.inertia(a - 3 * np.eye(d), shift - 3) == (e > shift).sum()
    values, vectors = wh.leading(a, 8)
    k = min(8, int((e > 0).sum()))
    assert len(values) == k and np.allclose(values, e[:k], atol=1e-12 * 5 * d)
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-10 and np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11


def test_block_pivots():
    a = np.array([[0.0, 2.0, 0.0], [2.0, 0.0, 1.0], [0.0, 1.0, 0.0]])
    for shift in (-1.0, 0.5, 1.0, 3.0):
        assert wh.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
