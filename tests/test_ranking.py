import numpy as np
import pandas as pd
import pytest

from assayframe.operators.ranking import average_rank, bh_adjust, exact_median, exact_quantiles


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    rows = [(s, float(v)) for s in ("A", "B", None) for v in rng.integers(0, 40, 120)]
    rows += [("A", 7.0)] * 200 + [("C", None), ("A", None)]  # one hot value, and NULLs
    return rows


def _key(s):
    return "none" if s is None or s != s else s


@pytest.mark.parametrize("bucket_rows", [10**6, 9])
def test_average_rank(spark, values, bucket_rows):
    got = average_rank(spark.createDataFrame(values, "s string, v double"), "v", ["s"], bucket_rows=bucket_rows).toPandas()
    want = pd.DataFrame(values, columns=["s", "v"])
    want["s"] = want["s"].map(_key)
    want["r"] = want.groupby("s")["v"].rank()
    got["s"] = got["s"].map(_key)
    a = got.sort_values(["s", "v", "avg_rank"])["avg_rank"].to_numpy(dtype=float)
    b = want.sort_values(["s", "v", "r"])["r"].to_numpy(dtype=float)
    np.testing.assert_array_equal(a, b)


@pytest.mark.parametrize("bucket_rows", [10**6, 9])
def test_quantiles(spark, values, bucket_rows):
    df = spark.createDataFrame(values, "s string, v double")
    probs = [0.0, 0.13, 0.5, 0.77, 1.0]
    got = {_key(r.s): list(r.quantiles) for r in exact_quantiles(df, "v", probs, ["s"], bucket_rows).collect()}
    for s in ("A", "B", "none"):
        col = [v for k, v in values if _key(k) == s and v is not None]
        np.testing.assert_allclose(got[s], np.quantile(col, probs), rtol=1e-14)
    med = {_key(r.s): r.median for r in exact_median(df, "v", ["s"], bucket_rows=bucket_rows).collect()}
    assert med["A"] == got["A"][2]


@pytest.mark.parametrize("bucket_rows", [10**6, 11])
def test_bh(spark, bucket_rows):
    rng = np.random.default_rng(2)
    rows = [(f, i, None if rng.random() < 0.1 else float(np.round(rng.random() ** 3, 3))) for f in "XY" for i in range(150)]
    got = bh_adjust(spark.createDataFrame(rows, "f string, i int, p double"), "p", ["f"], bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    for f in "XY":
        p = np.array([r.p for r in got if r.f == f and r.p is not None])
        q = np.array([r.padj for r in got if r.f == f and r.p is not None])
        for pi, qi in zip(p, q):  # straight from the definition
            want = min(1.0, min(pj * len(p) / (p <= pj).sum() for pj in p if pj >= pi))
            assert abs(want - qi) < 1e-15
        assert (q >= p).all() and (np.diff(q[np.argsort(p, kind="stable")]) >= 0).all()
        assert all(r.padj is None for r in got if r.f == f and r.p is None)


def test_ranks_do_not_use_one_partition(spark, values):
    df = spark.createDataFrame(values, "s string, v double")
    ranked = average_rank(df, "v", [], bucket_rows=5)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # The only single-partition exchanges allowed are those of one-row totals and of one row per bucket.
    assert "Window" not in plan.split("SinglePartition")[0].splitlines()[-1]
    assert ranked.count() == len(values)
