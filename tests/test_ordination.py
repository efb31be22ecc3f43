import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.operators.ordination import _pool, best_scaling, monotone_fit, nonmetric_scaling, procrustes
from assayframe.session import durable


def brute_monotone(y):
    """Max-min formula of isotonic regression."""
    n = len(y)
    c = np.r_[0, np.cumsum(y)]
    return np.array([max(min((c[j] - c[i]) / (j - i) for j in range(k + 1, n + 1)) for i in range(k + 1)) for k in range(n)])


def test_pooling_is_isotonic_regression():
    rng = np.random.default_rng(0)
    for _ in range(20):
        y = rng.normal(size=30) + np.linspace(0, 1, 30)
        g = _pool(y, np.ones(30))
        fit = (np.bincount(g, y) / np.bincount(g))[g]
        np.testing.assert_allclose(fit, brute_monotone(y), atol=1e-12)


@pytest.mark.parametrize("falling", [False, True])
def test_bucketed_fit_equals_one_task_fit(spark, falling):
    rng = np.random.default_rng(1)
    dist = np.sort(rng.random(90))
    d = (-dist if falling else dist) + rng.normal(0, 0.3, 90) + 2
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(dist, d)], "strata string, dist double, d double")
    got = sorted((r.dist, r.fit) for r in monotone_fit(df, buckets=10, task_rows=12).collect())
    np.testing.assert_allclose([f for _, f in got], brute_monotone(d), atol=1e-12)


def test_tied_distances_are_spread_over_ranges(spark):
    rng = np.random.default_rng(3)
    dist, d = np.where(rng.random(100) < 0.9, 1.0, rng.random(100)), rng.random(100) + 1
    df = spark.createDataFrame([(s, float(a), float(b), i) for s in ("s", "t") for i, (a, b) in enumerate(zip(dist, d))], "strata string, dist double, d double, i int")
    dealt = df.repartitionByRange(8, "strata", "dist", "d", "i").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).head()[0] <= 60
    many = {(r.strata, r.i): r.fit for r in monotone_fit(df, buckets=8, task_rows=100).collect()}
    one = {(r.strata, r.i): r.fit for r in monotone_fit(df, buckets=1).collect()}
    order = np.lexsort((d, dist))
    for s in ("s", "t"):
        np.testing.assert_allclose([one[s, i] for i in order], brute_monotone(d[order]), atol=1e-12)
        np.testing.assert_allclose([many[s, i] for i in order], brute_monotone(d[order]), atol=1e-12)


def test_scaling_recovers_a_plane(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((14, 2))
    rows = [(f"s{i:02d}", f"s{j:02d}", float(np.hypot(*(pts[i] - pts[j]))) ** 2) for i in range(14) for j in range(i + 1, 14)]
    pairs = durable(spark.createDataFrame(rows, "sample_a string, sample_b string, dist double"))
    early = nonmetric_scaling(pairs, steps=6, tolerance=1.0)[1]
    assert early.count() == 2
    points, trace = nonmetric_scaling(pairs, steps=6, tolerance=0)
    stress = [r.stress for r in trace.orderBy("step").collect()]
    assert len(stress) == 7 and all(b <= a + 1e-12 for a, b in zip(stress, stress[1:])) and stress[-1] < 0.12
    xy = np.array([(r.axis1, r.axis2) for r in points.orderBy("sample").collect()])
    np.testing.assert_allclose(xy.mean(axis=0), 0, atol=1e-12)
    assert abs(np.cov(xy.T)[0, 1]) < 1e-12 and xy[:, 0].var() >= xy[:, 1].var()
    far = np.array([np.hypot(*(pts[i] - pts[j])) for i in range(14) for j in range(i + 1, 14)])
    near = np.array([np.hypot(*(xy[i] - xy[j])) for i in range(14) for j in range(i + 1, 14)])
    assert np.corrcoef(far, near)[0, 1] > 0.97


def _plane(seed, n=14, power=2, noise=0.0):
    rng = np.random.default_rng(seed)
    pts = rng.random((n, 2))
    return [(f"s{i:02d}", f"s{j:02d}", float(np.hypot(*(pts[i] - pts[j])) ** power * np.exp(noise * rng.normal()))) for i in range(n) for j in range(i + 1, n)]


@pytest.mark.parametrize("extrapolate", [False, True])
def test_steps_over_tables_equal_steps_in_a_task(spark, extrapolate):
    rows = [("p", *r) for r in _plane(3, 9, noise=0.2)] + [("q", *r) for r in _plane(4, 7, noise=0.4)]
    pairs = durable(spark.createDataFrame(rows, "g string, sample_a string, sample_b string, dist double"))
    one, many = (nonmetric_scaling(pairs, 4 if extrapolate else 2, ["g"], task_rows=t, tolerance=0, extrapolate=extrapolate) for t in (10**6, 20))
    for a, b, key in zip(one, many, (["g", "sample"], ["g", "step"])):
        a, b = a.orderBy(*key).toPandas(), b.orderBy(*key).toPandas()
        assert a[key].equals(b[key])
        np.testing.assert_allclose(a.drop(columns=key).to_numpy(float), b.drop(columns=key).to_numpy(float), atol=1e-9)


def test_longer_steps_never_raise_the_stress_and_settle_lower(spark):
    pairs = durable(spark.createDataFrame(_plane(5, 16, noise=0.5), "sample_a string, sample_b string, dist double"))
    plain, longer = ([r.stress for r in nonmetric_scaling(pairs, 1500, tolerance=1e-7, extrapolate=e)[1].orderBy("step").collect()] for e in (False, True))
    assert all(b <= a + 1e-12 for a, b in zip(longer, longer[1:])) and len(longer) < 1500 and longer[-1] <= plain[-1] + 1e-6
    # As far as the plain steps get, in fewer steps.
    assert next(i for i, v in enumerate(longer) if v <= plain[-1] + 1e-6) < len(plain)


def test_procrustes_undoes_turn_mirror_and_scale(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 2))
    t = 0.7
    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    maps = {1: 3 * x @ turn + 5, 2: 0.5 * (x * [1, -1]) @ turn - 2, 3: rng.normal(size=(30, 2)), 4: np.ones((30, 2))}
    rows = [(k, i, *map(float, v)) for k, m in maps.items() for i, v in enumerate(m)]
    target = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, x double, y double")
    got = {r.k: r for r in procrustes(spark.createDataFrame(rows, "k int, i int, x double, y double"), "k", target, ["i"]).collect()}
    assert got[1].rmse < 1e-7 and not got[1].mirrored and abs(got[1].scale - 1 / 3) < 1e-12
    assert got[2].rmse < 1e-7 and got[2].mirrored and abs(got[2].scale - 2) < 1e-12
    for k in (1, 2, 3):  # the closed form is the singular value solution
        a, b = (m - m.mean(axis=0) for m in (maps[k], x))
        u, sv, vt = np.linalg.svd(a.T @ b)
        assert abs(got[k].rmse ** 2 * 30 - max(0, 1 - sv.sum() ** 2 / ((a**2).sum() * (b**2).sum()))) < 1e-12
        q = np.array([[np.cos(got[k].turn), np.sin(got[k].turn)], [-np.sin(got[k].turn), np.cos(got[k].turn)]])
        best = a @ (np.diag([1, -1]) @ q if got[k].mirrored else q) * got[k].scale
        np.testing.assert_allclose(best, a @ (u @ vt) * sv.sum() / (a**2).sum(), atol=1e-9)
    assert got[4].rmse == pytest.approx(1 / np.sqrt(30)) and got[4].n == 30


def test_best_of_many_starts(spark):
    rows = [("p", *r) for r in _plane(7, 12, noise=0.6)] + [("q", *r) for r in _plane(8, 10)]
    pairs = durable(spark.createDataFrame(rows, "g string, sample_a string, sample_b string, dist double"))
    points, starts = best_scaling(pairs, ["g"], batch=4, most=12)
    starts = starts.toPandas()
    one = nonmetric_scaling(pairs, 20, ["g"], tolerance=0)[1].groupBy("g").agg(F.min("stress").alias("s")).toPandas().set_index("g")["s"]
    for g, part in starts.groupby("g"):
        best = part[part["best"]]
        assert len(best) == 1 and best["stress"].iloc[0] == part["stress"].min() <= one[g] and best["rmse"].iloc[0] < 1e-6 and part["settled"].all()
        others = part[~part["best"]]
        assert part["agreed"].nunique() == 1 and part["agreed"].iloc[0] == (others["rmse"] <= 0.01).any()
        assert part["agreed"].iloc[0] or len(part) == 12
    assert points.count() == 22 and points.groupBy("g").agg(F.abs(F.avg("axis1")).alias("m")).agg(F.max("m")).head()[0] < 1e-9
