import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayframe.operators import diffabund as da, nbfit

ARGS = dict(sample="sample", feature="feature", count="n", arm="arm", control="c", treated="t", strata=["st"])


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(8)
    rows, samples = [], []
    for st in ("P", "Q"):
        depth = rng.uniform(0.5, 2, 8)
        for s in range(8):
            samples.append((st, f"{st}{s}", "c" if s < 4 else "t"))
        for f in range(60):
            mean, alpha = rng.uniform(1, 300), rng.uniform(0.05, 0.6)
            lift = np.where(np.arange(8) >= 4, 2.0 ** rng.normal(0, 1), 1.0)
            n = rng.poisson(rng.gamma(1 / alpha, alpha * mean * depth * lift))
            rows += [(f"{st}{s}", f"f{f}", float(v)) for s, v in enumerate(n) if v]
    return spark.createDataFrame(rows, "sample string, feature string, n double"), spark.createDataFrame(samples, "st string, sample string, arm string")


def test_size_factors(spark, counts):
    cells, samples = counts
    wide = cells.join(samples, "sample").toPandas()
    for bucket_rows in (10**6, 13):
        got = {r.sample: r.size_factor for r in da.size_factors(cells, samples, **ARGS, bucket_rows=bucket_rows).collect()}
        for st, g in wide.groupby("st"):
            m = g.pivot(index="feature", columns="sample", values="n").dropna()
            logs = np.log(m)
            want = np.exp(logs.sub(logs.mean(axis=1), axis=0).median())
            for s in m.columns:
                assert abs(got[s] - want[s]) < 1e-12
    scaled = cells.withColumn("n", F.when(F.col("sample") == "P0", F.col("n") * 4).otherwise(F.col("n")))
    again = {r.sample: r.size_factor for r in da.size_factors(scaled, samples, **ARGS).collect()}
    # A sample counted four times as deep has a factor four times as large, relative to the others.
    assert abs(again["P0"] / again["P1"] / (got["P0"] / got["P1"]) - 4) < 1e-9


def test_sample_names_may_repeat_across_strata(spark, counts):
    cells, samples = counts
    named = cells.join(samples.select("st", "sample"), "sample").withColumn("sample", F.substring("sample", 2, 9))
    short = samples.withColumn("sample", F.substring("sample", 2, 9))
    want = {r.sample: r.size_factor for r in da.size_factors(cells, samples, **ARGS).collect()}
    got = da.size_factors(named, short, **ARGS)
    assert {r.st + r.sample: r.size_factor for r in got.collect()} == want
    a = {(r.st, r.feature): r.baseMean for r in da.norm_mean(named, got, "sample", "feature", "n", ["st"]).collect()}
    full = da.norm_mean(cells, da.size_factors(cells, samples, **ARGS), "sample", "feature", "n", ["st"])
    b = {(r.st, r.feature): r.baseMean for r in full.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_no_common_feature_is_an_error(spark):
    cells = spark.createDataFrame([("a", "f", 1.0), ("b", "g", 2.0), ("c", "g", 2.0), ("d", "f", 3.0)], "sample string, feature string, n double")
    samples = spark.createDataFrame([("s", "a", "c"), ("s", "b", "c"), ("s", "c", "t"), ("s", "d", "t")], "st string, sample string, arm string")
    with pytest.raises(ValueError, match="size factors"):
        da.nb_wald(cells, samples, **ARGS)


def test_wald_results_do_not_depend_on_bins(spark, counts, monkeypatch):
    cells, samples = counts
    one = {(r.st, r.feature): r for r in da.nb_wald(cells, samples, **ARGS).collect()}
    monkeypatch.setattr(da, "TASK_CELLS", 40)
    many = {(r.st, r.feature): r for r in da.nb_wald(cells, samples, **ARGS, bucket_rows=17).collect()}
    assert one.keys() == many.keys() and len(one) == cells.join(samples, "sample").select("st", "feature").distinct().count()
    for k in one:
        for c in ("baseMean", "dispersion", "log2FoldChange", "lfcSE", "pvalue"):
            a, b = one[k][c], many[k][c]
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-5), (k, c)
    assert all(r.converged for r in one.values())


def test_fit_is_a_likelihood_maximum():
    rng = np.random.default_rng(4)
    sf, arm = rng.uniform(0.5, 2, 8), np.repeat([0, 1], 4)
    y = rng.poisson(50 * sf * np.where(arm == 1, 3, 1), size=(5, 8)).astype(float)
    disp = np.full(5, 0.1)
    b0, b1, se, settled, mu, _ = nbfit.wald_fit(y, sf, arm, disp)
    assert settled.all() and (np.abs(b1 - math.log(3)) < 0.6).all() and (se > 0).all()

    def score(a, b):
        m = sf * np.exp(a[:, None] + b[:, None] * arm)
        return ((y - m) / (1 + 0.1 * m)).sum(axis=1)

    assert (np.abs(score(b0, b1)) < 1e-3).all()


def test_outlier_flag():
    sf, arm = np.ones(8), np.repeat([0, 1], 4)
    y = np.array([[10, 11, 9, 10, 10, 12, 9, 400.0], [10, 11, 9, 10, 10, 12, 9, 11.0]])
    _, _, _, _, mu, hat = nbfit.wald_fit(y, sf, arm, np.full(2, 0.05))
    top, flag = nbfit.cook_flags(y, sf, arm, mu, hat, 10.0)
    assert flag.tolist() == [True, False] and top[0] > top[1]


def test_trend_recovers_a_known_curve(spark):
    rng = np.random.default_rng(6)
    rows = []
    for st, a0, a1 in (("u", 0.1, 4.0), ("v", 0.5, 1.0)):
        for m in np.exp(rng.uniform(0, 7, 3000)):
            rows.append((st, float(m), float((a0 + a1 / m) * rng.gamma(5, 1 / 5))))
    got = {r.st: r for r in da.dispersion_trend(spark.createDataFrame(rows, "st string, base_mean double, disp_gene double"), ["st"]).collect()}
    assert abs(got["u"].a0 - 0.1) < 0.02 and abs(got["u"].a1 - 4) < 0.4 and abs(got["v"].a0 - 0.5) < 0.05


def _bh(p):
    out = np.full(len(p), np.nan)
    known = np.flatnonzero(~np.isnan(p))
    order = known[np.argsort(p[known])]
    q = p[order] * len(order) / np.arange(1, len(order) + 1)
    out[order] = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
    return out


@pytest.mark.parametrize("bucket_rows", [10**6, 50])
def test_filtering_against_brute_force(spark, bucket_rows):
    rng = np.random.default_rng(12)
    rows = []
    for st in ("a", "b"):
        for i in range(400):
            base = float(np.exp(rng.normal(2, 2)))
            p = float(rng.random() ** (6 if base > 5 and st == "a" else 1))
            rows.append((st, f"f{i}", base, None if i % 37 == 0 else p))
    df = spark.createDataFrame(rows, "st string, feature string, baseMean double, pvalue double")
    curve = da.rejections_by_cutoff(df, "pvalue", "baseMean", 0.05, ["st"], bucket_rows=bucket_rows).toPandas()
    got = {(r.st, r.feature): r.padj for r in da.filtered_bh(df, "pvalue", "baseMean", 0.05, ["st"], bucket_rows=bucket_rows).collect()}
    for st in ("a", "b"):
        base = np.array([r[2] for r in rows if r[0] == st])
        p = np.array([np.nan if r[3] is None else r[3] for r in rows if r[0] == st])
        theta = np.linspace(0, 0.95, 50)
        cut = np.quantile(base, theta)
        n_rej = np.array([np.nansum(_bh(np.where(base >= c, p, np.nan)) < 0.05) for c in cut])
        mine = curve[curve.st == st].sort_values("step")
        np.testing.assert_allclose(mine["cutoff"], cut, rtol=1e-12)
        np.testing.assert_array_equal(mine["n_rej"], n_rej)
        pick = 0
        if n_rej.max() > 10:
            fit = nbfit.smooth(theta, n_rej.astype(float))
            spread = math.sqrt((((n_rej - fit)[n_rej > 0]) ** 2).mean())
            pick = int(np.flatnonzero(n_rej > fit.max() - spread)[0])
        want = _bh(np.where(base >= cut[pick], p, np.nan))
        have = np.array([np.nan if got[st, f"f{i}"] is None else got[st, f"f{i}"] for i in range(400)])
        np.testing.assert_allclose(have, want, rtol=1e-12)


def test_smoother_reproduces_a_line():
    x = np.linspace(0, 1, 50)
    np.testing.assert_allclose(nbfit.smooth(x, 3 * x + 1), 3 * x + 1, atol=1e-12)


def test_stratum_without_trend_keeps_its_features(spark):
    from assayframe.operators.diffabund import differential

    rng = np.random.default_rng(3)
    cells, samples = [], []
    for g in ("P", "Q"):
        for s in range(6):
            samples.append((g, f"{g}{s}", "xy"[s // 3]))
            for f in range(25):
                n = int(rng.negative_binomial(4, 0.05)) + 1 if g == "P" else 40 + f
                cells.append((g, f"{g}{s}", f"f{f}", n))
    df = spark.createDataFrame(cells, "g string, sample string, taxon string, n int").withColumnRenamed("taxon", "feature")
    out = differential(df, spark.createDataFrame(samples, "g string, sample string, arm string"), "sample", "feature", "n", "arm", "x", "y", 0.1, ["g"])
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert counts == {"P": 25, "Q": 25}
    assert out.where("g = 'Q' AND log2FoldChange IS NULL").count() == 0


def test_filtering_needs_no_column_of_a_fixed_name(spark):
    from assayframe.operators.diffabund import filtered_bh

    df = spark.createDataFrame([(f"k{i}", i / 500, float(i)) for i in range(40)], "key string, p double, mean double")
    assert filtered_bh(df, "p", "mean", 0.05).count() == 40


def _brute_peak(y, sf, arm, top):
    """Profile maximum by a dense grid, count by count."""
    mu = np.maximum(nbfit.arm_means(y / sf, arm) * sf, nbfit.MIN_MU)
    xs = np.linspace(math.log(nbfit.MIN_DISP), math.log(top), 6001)

    def value(x, counts, m):
        a = math.exp(x)
        ll = sum(math.lgamma(k + 1 / a) - math.lgamma(1 / a) - (k + 1 / a) * math.log1p(a * u) + k * math.log(a) for k, u in zip(counts, m))
        w = m / (1 + a * m)
        return ll - 0.5 * sum(math.log(w[arm == g].sum()) for g in (0, 1))
    return np.array([xs[int(np.argmax([value(x, c, m) for x in xs]))] for c, m in zip(y, mu)]), mu


def test_grid_finds_the_profile_maximum_where_a_climb_does_not_settle():
    rng = np.random.default_rng(21)
    sf, arm = rng.uniform(0.7, 1.4, 8), np.repeat([0, 1], 4)
    y = rng.negative_binomial(2, 0.03, size=(6, 8)).astype(float) + 1
    want, mu = _brute_peak(y, sf, arm, 10.0)
    far = np.full(6, math.log(9.0))
    gap = (math.log(10.0) - math.log(nbfit.MIN_DISP)) / (nbfit.GRID - 1)
    fine = 2 * gap / (nbfit.GRID - 1)
    assert np.abs(nbfit.grid_peak(y, mu, arm, 10.0) - want).max() <= fine
    assert np.abs(nbfit.climb(far, y, mu, arm, 10.0, max_iter=1) - want).max() <= fine
    assert np.abs(nbfit.climb(far, y, mu, arm, 10.0) - want).max() < 2e-3


def test_refit_of_unsettled_features_ends_at_a_zero_score():
    rng = np.random.default_rng(22)
    sf, arm = rng.uniform(0.5, 2, 8), np.repeat([0, 1], 4)
    y = np.vstack([rng.poisson(40 * sf, size=(4, 8)), [0, 0, 0, 0, 5, 9, 1, 30], [3000, 1, 0, 2, 0, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0, 0]]).astype(float)
    disp = np.array([0.1, 0.01, 1.0, 1e-8, 0.5, 5.0, 0.3])
    b0, b1, se, settled, mu, hat = nbfit.wald_fit(y, sf, arm, disp, max_iter=1)  # nothing settles in one step
    assert settled.all() and np.isfinite(se).all()
    full = sf * np.exp(b0[:, None] + b1[:, None] * arm)
    pull = (y - full) / (1 + disp[:, None] * full)
    assert np.abs(pull.sum(axis=1) - nbfit.RIDGE * b0).max() < 1e-6 and np.abs(pull[:, arm == 1].sum(axis=1) - nbfit.RIDGE * b1).max() < 1e-6
    usual = nbfit.wald_fit(y[:4], sf, arm, disp[:4])
    np.testing.assert_allclose(b1[:4], usual[1], atol=1e-4)


def test_local_trend_where_the_parametric_fit_fails(spark):
    rng = np.random.default_rng(23)
    mean = np.exp(rng.uniform(0, 8, 1500))
    disp = np.exp(-3 + 0.6 * np.log(mean) - 0.03 * np.log(mean) ** 2 + rng.normal(0, 0.4, 1500))  # rises with the mean: no positive a1
    good = [("g", float(m), float((0.1 + 4 / m) * rng.gamma(5, 1 / 5))) for m in mean]
    rows = good + [("l", float(m), float(v)) for m, v in zip(mean, disp)] + [("m", 5.0, 0.2), ("m", 5.0, 0.4)]
    df = spark.createDataFrame(rows, "st string, base_mean double, disp_gene double")
    got = {r.st: r for r in da.dispersion_trend(df, ["st"]).collect()}
    assert got["g"].trend == "parametric" and got["l"].trend == "local" and got["l"].a0 is None
    x, y = np.log(mean), np.log(disp)
    at = got["l"].low + got["l"].step * np.arange(da.TREND_KNOTS)
    want = []
    for t in at[::16]:  # the same regression on the points themselves
        gap = np.abs(x - t)
        w = mean * np.clip(1 - (gap / np.sort(gap)[int(0.7 * 1500)]) ** 3, 0, None) ** 3
        design = np.stack([np.ones(1500), x - t, (x - t) ** 2], axis=1)
        want.append(np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0])
    assert np.abs(np.array(got["l"].curve)[::16] - want).max() < 0.02
    both = df.join(da.dispersion_trend(df, ["st"]), "st").select("st", "base_mean", da._trend_column("base_mean").alias("t")).collect()
    for r in both:
        s = got[r.st]
        assert math.isclose(r.t, float(da._trend_values(np.array([r.base_mean]), s.a0, s.a1, s.low, s.step, s.curve)[0]), rel_tol=1e-9)


def test_outliers_of_large_arms_are_replaced(spark):
    rng = np.random.default_rng(24)
    n = 16
    clean = rng.negative_binomial(10, 0.1, size=(40, n)) + 1
    dirty = clean.copy()
    dirty[3, 2] = dirty[11, 12] = 20_000
    samples = spark.createDataFrame([("s", f"x{i:02d}", "ct"[i // 8]) for i in range(n)], "st string, sample string, arm string")

    def fit(m):
        return {r.feature: r for r in da.nb_wald(spark.createDataFrame([(f"x{i:02d}", f"f{f:02d}", float(m[f, i])) for f in range(40) for i in range(n)], "sample string, feature string, n double"), samples, **ARGS).collect()}
    a, b = fit(clean), fit(dirty)
    assert {k for k, r in b.items() if r.replaced} == {"f03", "f11"} and not any(r.replaced for r in a.values())
    for k in ("f03", "f11"):  # as without the outlier, or nearly so; not flagged
        assert abs(b[k].log2FoldChange - a[k].log2FoldChange) < 0.5 and b[k].pvalue is not None and not b[k].cook_outlier and b[k].max_cook > 10
    small = da.nb_wald(spark.createDataFrame([(f"x{i:02d}", f"f{f:02d}", float(dirty[f, i])) for f in range(40) for i in (0, 1, 2, 3, 8, 9, 10, 12)], "sample string, feature string, n double"), samples.filter("sample IN ('x00','x01','x02','x03','x08','x09','x10','x12')"), **ARGS)
    small = {r.feature: r for r in small.collect()}
    assert small["f03"].cook_outlier and small["f03"].pvalue is None and not small["f03"].replaced


def _weighted_upper(x, w, upper=0.05):
    """The matched quantile, value by value."""
    order = np.argsort(x)
    x, w = x[order], w[order] * len(x) / w.sum()
    cum, spot = np.cumsum(w), 1 + (len(x) - 1) * (1 - upper)
    low = max(math.floor(spot), 1)
    at = lambda v: x[min(int(np.searchsorted(cum, v - 1e-9)), len(x) - 1)]
    return (1 - spot % 1) * at(low) + spot % 1 * at(min(low + 1, len(x)))


@pytest.mark.parametrize("bucket_rows", [10**6, 30])
def test_prior_width(spark, bucket_rows):
    rng = np.random.default_rng(25)
    rows = [(st, float(v), float(w)) for st, n in (("a", 300), ("b", 7), ("c", 1)) for v, w in zip(rng.normal(0, 2, n).round(2), rng.uniform(0.1, 5, n))] + [("a", 40.0, 9.0), ("a", None, 1.0)]
    got = {r.st: r for r in da.fold_change_prior(spark.createDataFrame(rows, "st string, l double, w double"), "l", "w", ["st"], bucket_rows=bucket_rows).collect()}
    for st in "abc":
        x, w = (np.array(v) for v in zip(*[(abs(r[1]), r[2]) for r in rows if r[0] == st and r[1] is not None and abs(r[1]) < 10]))
        assert got[st].n == len(x) and math.isclose(got[st].upper_quantile, _weighted_upper(x, w), rel_tol=1e-9)
        assert math.isclose(got[st].prior_var, (got[st].upper_quantile / 1.959963984540054) ** 2, rel_tol=1e-12)


def test_shrunken_fold_changes_maximise_the_penalised_likelihood(spark, counts):
    cells, samples = counts
    plain = {(r.st, r.feature): r for r in da.nb_wald(cells, samples, **ARGS).collect()}
    got = {(r.st, r.feature): r for r in da.shrunken_wald(cells, samples, **ARGS).collect()}
    factors = {r.sample: r.size_factor for r in da.size_factors(cells, samples, **ARGS).collect()}
    wide = cells.toPandas().pivot(index="feature", columns="sample", values="n").fillna(0)
    assert got.keys() == plain.keys() and all(r.converged for r in got.values())
    for (st, f), r in got.items():
        assert math.isclose(r.plain, plain[st, f].log2FoldChange, rel_tol=1e-9) and math.isclose(r.dispersion, plain[st, f].dispersion, rel_tol=1e-9)
        y, sf, on = wide.loc[f, [f"{st}{s}" for s in range(8)]].to_numpy(), np.array([factors[f"{st}{s}"] for s in range(8)]), np.repeat([0.0, 1.0], 4)
        v = r.log2FoldChange * math.log(2)

        def loss(u, v):
            mu = sf * np.exp(u + v * on)
            a = r.dispersion
            return -(y * np.log(a * mu) - (y + 1 / a) * np.log1p(a * mu)).sum() + v * v / (2 * r.prior_var * math.log(2) ** 2)
        us = np.log((y / sf).mean() + 0.1) + np.linspace(-3, 3, 601)
        best = {d: min(loss(u, v + d) for u in us) for d in (-0.05, 0.0, 0.05)}
        assert best[0.0] <= min(best.values()) + 1e-6
        assert abs(r.log2FoldChange) <= abs(r.plain) + 1e-6
    assert len({(k[0], r.prior_var) for k, r in got.items()}) == 2


def test_prior_of_a_two_against_two_design_matches_a_long_simulation(spark):
    rng = np.random.default_rng(26)
    want = {("a", 2): 1.5, ("b", 2): 0.6, ("c", 1): 3.0, ("d", 3): 1.0}
    parts = [pd.DataFrame({"st": st, "df": df, "res": np.log(rng.chisquare(df, 100_000)) - math.log(df) + rng.normal(0, math.sqrt(var), 100_000)}) for (st, df), var in want.items()]
    df = spark.createDataFrame(pd.concat(parts)).withColumn("df", F.col("df").cast("int"))
    got = {r.st: r.spread for r in da.matched_spread(df, "res", "df", ["st"]).collect()}
    assert got == {r.st: r.spread for r in da.matched_spread(df.repartition(5), "res", "df", ["st"]).collect()}
    for (st, _), var in want.items():
        assert abs(got[st] / var - 1) < 0.05


def test_two_against_two_design_runs(spark, counts):
    cells, samples = counts
    four = samples.filter(F.substring("sample", 2, 1).isin("0", "1", "4", "5"))
    out = da.nb_wald(cells, four, **ARGS).collect()
    assert out and all(r.converged and r.dispersion > 0 for r in out if r.baseMean > 1)
