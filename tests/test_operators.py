import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.functions.columns import nan_to_null, round_half_even, strict
from assayframe.operators.compare import chained_outer, membership_counts, unique_to_one, wide_compare
from assayframe.operators.joins import attach_group_values, full_outer, with_total
from assayframe.operators.ordination import group_ellipse
from assayframe.operators.regress import growth_rate, linear_fit
from assayframe.operators.reshape import drop_all_zero, level_rank, melt, renormalise, share_in_group, spread
from assayframe.operators.rules import rule_window
from assayframe.operators.summarize import endpoint_change, mean_sd, peak, richness, rollup_rare, share_of_total, total
from assayframe.operators.timeaxis import clock, elapsed_days, midpoint
from assayframe.operators.twosample import two_sample


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_mean_sd_of_all_null_and_single(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), ("c", 1.0), ("c", 3.0), ("c", None)], "g string, x double")
    assert rows(mean_sd(df, ["g"], ["x"])) == [("a", None, None), ("b", 2.0, None), ("c", 2.0, math.sqrt(2.0))]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 5.0)], "g string, x double")
    assert rows(peak(df, ["g"], "x", "m")) == [("a", None), ("b", 5.0)]
    assert rows(peak(df, ["g"], "x", "m", skip_null=True)) == [("a", 1.0), ("b", 5.0)]
    assert rows(total(df, ["g"], "x", "s")) == [("a", None), ("b", 7.0)]
    assert df.agg(strict(F.sum, "x")).head()[0] is None


def test_rounding_and_nan(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (1411.333333,)], "x double")
    assert [r[0] for r in df.select(round_half_even("x")).collect()] == [0, 2, 2, 0, 1411]
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(nan_to_null("x")).collect()] == [None, 1.0]


def test_time_axis(spark):
    df = spark.createDataFrame([(0, 0, "7/5/18", "10:12", "11:50"), (0, 6, "7/11/18", "9:50", "11:32"), (1, 0, "x", "9:00", "9:10")],
                               "round int, day int, d string, a string, b string")
    timed = df.withColumn("mid", midpoint(clock("d", "a"), clock("d", "b")))
    got = {(r.round, r.day): r.days_elapsed for r in elapsed_days(timed, "mid", (F.col("round") == 0) & (F.col("day") == 0)).collect()}
    assert got[0, 0] == 0 and abs(got[0, 6] - (6 - 20 / 1440)) < 1e-12 and got[1, 0] is None
    per = elapsed_days(timed.filter("round = 0"), "mid", F.col("day") == 6, per=["round"]).collect()
    assert {r.day: round(r.days_elapsed, 9) for r in per} == {0: round(-(6 - 20 / 1440), 9), 6: 0.0}


def test_elapsed_time_ignores_daylight_saving(spark):
    df = spark.createDataFrame([(0, "3/9/24", "1:30", "1:30"), (1, "3/10/24", "2:30", "2:30")], "day int, d string, a string, b string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        timed = df.withColumn("mid", midpoint(clock("d", "a"), clock("d", "b")))
        got = {r.day: r.days_elapsed for r in elapsed_days(timed, "mid", F.col("day") == 0).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs(got[1] - 25 / 24) < 1e-12


def test_endpoint_change(spark):
    df = spark.createDataFrame(
        [("a", 0, 1.0, 2.0), ("a", 8, 4.0, 3.5), ("b", 0, 1.0, 2.0), ("c", 0, 1.0, 2.0), ("c", 8, 2.0, 2.0)], "g string, day int, x double, y double")
    got = {r.g: (r.change, r.change_ratio) for r in endpoint_change(df, ["g"], F.col("day") == 0, F.col("day") == 8, "x", "y").collect()}
    assert got == {"a": (3.0, 2.0), "b": (None, None), "c": (1.0, None)}


def test_growth_rate_and_terms(spark):
    rng = np.random.default_rng(0)
    x = rng.random(9) * 5
    y = np.exp(0.7 * x - 1 + rng.normal(0, 0.1, 9))
    data = [("g", float(a), float(b)) for a, b in zip(x, y)] + [("g", 1.0, 0.0), ("g", 2.0, -3.0), ("g", None, 4.0), ("one", 1.0, 2.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = {r.g: r for r in linear_fit(df, ["g"], "x", "y", log_y=True).collect()}
    a = np.column_stack([np.ones(9), x])
    beta, rss, *_ = np.linalg.lstsq(a, np.log(y), rcond=None)
    cov = rss[0] / 7 * np.linalg.inv(a.T @ a)
    np.testing.assert_allclose([got["g"].intercept, got["g"].slope], beta, rtol=1e-10)
    np.testing.assert_allclose([got["g"].intercept_se, got["g"].slope_se], np.sqrt(np.diag(cov)), rtol=1e-9)
    assert got["g"].n == 9 and got["one"].slope is None and got["one"].slope_se is None
    moved = growth_rate(df.withColumn("x", F.col("x") + 100), ["g"], "x", "y")
    assert abs({r.g: r.mu for r in moved.collect()}["g"] - beta[1]) < 1e-9


def test_rule_window(spark):
    df = spark.createDataFrame([(k, r, d) for k in ("a", "b", None) for r in (1, 2) for d in range(10)], "k string, r int, d int")
    rules = [("a", None, 0, 3), ("a", 1, 2, 5), ("a", 1, 4, 6), (None, 2, 8, 9), ("b", 1, 7, 3), (None, None, 9, 9)]
    table = spark.createDataFrame(rules, "k string, r int, day_lo int, day_hi int")
    got = rows(rule_window(df, table, ["k", "r"], "d"))
    want = [(k, r, d) for k in ("a", "b", None) for r in (1, 2) for d in range(10)
            if any((rk is None or rk == k) and (rr is None or rr == r) and lo <= d <= hi for rk, rr, lo, hi in rules)]
    assert got == sorted(want, key=repr)
    assert rule_window(df, table.filter("day_lo > 99"), ["k", "r"], "d").count() == 0


def test_attach_group_values_keeps_every_row(spark):
    big = spark.createDataFrame([(None if i % 3 == 0 else "hot", i) for i in range(300)], "k string, i int")
    small = spark.createDataFrame([("hot", 1.0), (None, 2.0), ("other", 3.0)], "k string, v double")
    got = attach_group_values(big, small, ["k"], ["i"], parts=7).groupBy("k", "v").count().collect()
    assert {(r.k, r.v): r["count"] for r in got} == {("hot", 1.0): 200, (None, 2.0): 100}


def test_full_outer_null_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, v int")
    assert rows(full_outer(a, b, ["k"])) == sorted([("x", 1, None), (None, 2, 3), ("y", None, 4)], key=repr)
    assert len(rows(full_outer(a, b, ["k"], null_safe=False))) == 4


def test_wide_forms_agree(spark):
    data = [("A", "p1", 1.0), ("A", None, 2.0), ("B", "p1", 3.0), ("B", None, 4.0), ("C", "p3", 5.0)]
    df = spark.createDataFrame(data, "st string, k string, v double")
    wide = wide_compare(df, ["k"], "st", ["A", "B", "C"], ["v"])
    chained = chained_outer([(s, df.filter(F.col("st") == s)) for s in "ABC"], ["k"], ["v"])
    assert rows(wide) == rows(chained.select(wide.columns))
    assert rows(unique_to_one(df, ["k"], "st")) == [("p3", "C")]
    assert rows(membership_counts(df, ["k"], "st", ["A", "B", "C"])) == [(False, False, True, 1), (True, True, False, 2)]


def test_reshape(spark):
    wide = spark.createDataFrame([("f1", 1.0, 0.0), ("f2", 3.0, 2.0), ("f3", 0.0, 0.0)], "feature string, s1 double, s2 double")
    long = melt(wide, ["feature"])
    assert rows(spread(long, ["feature"], "sample", ["s1", "s2"], "abundance")) == rows(wide)
    assert rows(richness(long, ["sample"], "abundance")) == [("s1", 2), ("s2", 1)]
    assert {r.feature for r in drop_all_zero(long, "feature", "abundance").collect()} == {"f1", "f2"}
    shares = share_in_group(long, ["sample"], "abundance", ["feature"])
    assert {(r.feature, r.sample): r.share for r in shares.collect()}["f1", "s1"] == 0.25
    again = renormalise(long, F.col("feature") != "f2", ["sample"], "abundance", ["feature"])
    assert {(r.feature, r.sample): r.abundance for r in again.collect()}["f1", "s1"] == 1.0
    assert {(r.feature, r.sample): r.abundance for r in again.collect()}["f1", "s2"] is None  # nothing left to share
    ranked = level_rank(wide, "feature", ["f2", "f1"])
    assert {r.feature: r.level_rank for r in ranked.collect()} == {"f2": 1, "f1": 2, "f3": None}


def test_rollup_and_totals(spark):
    df = spark.createDataFrame([("s1", "big", 90.0), ("s1", "r1", 4.0), ("s2", "r2", 5.0), ("s2", "x", 1.0)], "sample string, cat string, v double")
    assert {r.cat: r.share_pct for r in share_of_total(df, ["cat"], "v").collect()} == {"big": 90.0, "r1": 4.0, "r2": 5.0, "x": 1.0}
    got = rows(rollup_rare(df, "sample", "cat", "v", 5.0, {"Pool": ["r1", "r2"]}))
    assert got == [("s1", "Pool", 4.0), ("s1", "big", 90.0), ("s2", "Other", 1.0), ("s2", "Pool", 5.0)]
    assert with_total(df, {"t": F.sum("v")}).select("t").distinct().collect()[0].t == 100.0


def test_two_sample(spark):
    x, y = [1.0, 2.0, 4.0, 4.5], [5.0, 9.0, 2.0]
    df = spark.createDataFrame([("F", v) for v in x] + [("R", v) for v in y] + [("R", None)], "arm string, v double")
    r = two_sample(df, [], "arm", "F", "R", ["v"], conf=0.95).head()
    vx, vy = np.var(x, ddof=1), np.var(y, ddof=1)
    pooled = (3 * vx + 2 * vy) / 5
    assert abs(r.t_pooled - (np.mean(x) - np.mean(y)) / math.sqrt(pooled * (1 / 4 + 1 / 3))) < 1e-12
    assert abs(r.f - vx / vy) < 1e-12 and r.choice == "pooled" and r.df == 5
    assert abs(r.ci_hi - r.ci_lo - 2 * 2.570581835636314 * math.sqrt(pooled * (1 / 4 + 1 / 3))) < 1e-8
    swapped = two_sample(df, [], "arm", "R", "F", ["v"]).head()
    assert abs(swapped.t + r.t) < 1e-12 and abs(swapped.p_t - r.p_t) < 1e-12 and abs(swapped.p_f - r.p_f) < 1e-12


def test_two_sample_zero_variance(spark):
    df = spark.createDataFrame([("F", 1.0), ("F", 1.0), ("R", 1.0), ("R", 1.0)], "arm string, v double")
    r = two_sample(df, [], "arm", "F", "R", ["v"]).head()
    assert r.f is None and r.t is None and r.p_t is None and r.choice is None


def test_ellipse(spark):
    rng = np.random.default_rng(1)
    pts = rng.multivariate_normal([1, 2], [[3, 1], [1, 2]], 50)
    r = group_ellipse(spark.createDataFrame([("g", float(a), float(b)) for a, b in pts], "g string, x double, y double"), ["g"], "x", "y").head()
    vals, vecs = np.linalg.eigh(np.cov(pts.T))
    k = math.sqrt(-2 * math.log(0.05))
    np.testing.assert_allclose([r.half_short, r.half_long], np.sqrt(vals) * k, rtol=1e-10)
    assert abs(abs(np.dot(vecs[:, 1], [math.cos(r.angle), math.sin(r.angle)])) - 1) < 1e-10


@pytest.mark.parametrize("n", [1, 2])
def test_small_groups_have_no_test(spark, n):
    df = spark.createDataFrame([("F", 1.0)] * n + [("R", 2.0)], "arm string, v double")
    assert two_sample(df, [], "arm", "F", "R", ["v"]).head().t is None
