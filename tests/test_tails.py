import math

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assayframe.functions import tails
from assayframe.operators import nbfit


def test_known_tails():
    # Student's t with two degrees of freedom and F with (2, 2) have closed forms.
    t = np.array([0.1, 1.0, 4.0, 50.0])
    closed = 1 - t / np.sqrt(2 + t * t)
    np.testing.assert_allclose(tails.t_two_sided(t, 2), closed, rtol=1e-10)
    f = np.array([0.01, 1.0, 9.0])
    np.testing.assert_allclose(tails.f_lower(f, 2, 2), f / (1 + f), rtol=1e-13)
    np.testing.assert_allclose(tails.f_quantile(0.99, 2, 4), 18.0, rtol=1e-9)
    np.testing.assert_allclose(tails.t_quantile([0.975], [4]), [2.7764451051977987], rtol=1e-10)


def test_far_tails_keep_relative_accuracy():
    np.testing.assert_allclose(tails.normal_two_sided([20.0]), [5.507248237212467e-89], rtol=1e-10)
    t = 1e6
    # leading term of the tail with one degree of freedom: 2 / (pi t)
    np.testing.assert_allclose(tails.t_two_sided([t], 1), [2 / (math.pi * t)], rtol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.5, 500), st.floats(0.5, 500), st.floats(0.001, 0.999))
def test_beta_symmetry(a, b, x):
    left, right = float(tails.beta_inc(a, b, x)), float(tails.beta_inc(b, a, 1 - x))
    assert 0 <= left <= 1
    assert abs(left + right - 1) < 1e-9


def test_large_degrees_of_freedom_approach_normal():
    np.testing.assert_allclose(tails.t_two_sided([1.96], 1e7), tails.normal_two_sided([1.96]), rtol=1e-5)


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(2.0, 4.0), (None, 4.0), (2.0, None)], "t double, df double")
    got = [r[0] for r in df.select(tails.t_p_value(F.col("t"), F.col("df"))).collect()]
    assert got[1] is None and got[2] is None and abs(got[0] - 0.1161165235) < 1e-9


def test_gamma_functions():
    x = np.array([0.3, 1.0, 2.5, 9.9, 123.4, 1e8])
    lg, dg = nbfit.lgamma_digamma(x)
    np.testing.assert_allclose(lg, [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(dg[1], -0.5772156649015329, rtol=1e-12)
    np.testing.assert_allclose(nbfit.trigamma(2.0), math.pi**2 / 6 - 1, rtol=1e-12)


def test_f_quantiles_invert_the_tail_row_by_row():
    rng = np.random.default_rng(3)
    p, d1, d2 = np.r_[rng.uniform(0.001, 0.999, 60), 0.025, 0.975, 1e-9], np.r_[rng.integers(1, 400, 60), 1, 1, 3], np.r_[rng.integers(1, 400, 60), 1, 2, 900]
    q = tails.f_quantiles(p, d1, d2)
    np.testing.assert_allclose(tails.f_lower(q, d1, d2), p, rtol=1e-9)
    np.testing.assert_allclose(q[:5], [tails.f_quantile(*map(float, v)) for v in zip(p[:5], d1[:5], d2[:5])], rtol=1e-9)
    assert np.isnan(tails.f_quantiles([0.0, 1.0, 0.5], [1, 1, 0], [1, 1, 1])).all()
