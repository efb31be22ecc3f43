"""Differential abundance between two arms: size factors, dispersions, negative-binomial Wald tests.

All strata go through together. Counts are packed once into one sparse row per (stratum, feature); a feature has
at most one entry per sample. Features are then fitted in hash-assigned bins of bounded size, and all
pooled figures (size factors, trend, prior, filtering) are ordinary aggregations.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from assayframe.functions.columns import round_half_even
from assayframe.functions.tails import f_quantile, normal_p_value
from assayframe.operators import nbfit
from assayframe.operators.distance import _flat
from assayframe.operators.joins import _bare, _on, attach_group_values
from assayframe.operators.ranking import (
    BUCKET_ROWS, bh_adjust, exact_median, exact_quantiles, running_counts, value_table,
)
from assayframe.session import durable, ship, small_table

#: Dense cells (features x samples) one fitting task may hold.
TASK_CELLS = 2_000_000
LN2 = math.log(2.0)


def design(samples: DataFrame, sample: str, arm: str, control, treated, strata: Sequence[str]) -> DataFrame:
    """``(strata, sample, idx, arm 0/1, n_samples)`` for the samples of the two arms."""
    order = Window.partitionBy(*strata).orderBy(sample)
    both = samples.filter(F.col(arm).isin(control, treated)).select(
        *strata, F.col(sample).alias("sample"), F.when(F.col(arm) == F.lit(treated), 1).otherwise(0).alias("arm")
    ).distinct()
    return both.withColumns({
        "idx": (F.row_number().over(order.orderBy("sample")) - 1).cast("int"),
        "n_samples": F.count(F.lit(1)).over(Window.partitionBy(*strata)),
    })


def pack_counts(df: DataFrame, plan: DataFrame, sample: str, feature: str, count: str, strata: Sequence[str]) -> DataFrame:
    """One row per (stratum, feature) with its non-zero rounded counts; all-zero features do not appear.

    ``df`` has one row per (sample, feature); absent rows are zero counts. It may carry the strata; if it does not,
    sample names must be unique across them.
    """
    own = [k for k in strata if k in df.columns]
    cells = (
        df.select(*own, F.col(sample).alias("sample"), F.col(feature).alias("feature"), round_half_even(count).cast("double").alias("count"))
        .filter("count != 0")
    )
    placed = attach_group_values(cells, plan.drop("arm"), [*own, "sample"], ["feature"]).filter("idx IS NOT NULL")
    entries = F.sort_array(F.collect_list(F.struct("idx", "count")))
    return (
        placed.groupBy(*strata, "feature")
        .agg(entries.alias("e"), F.max("n_samples").alias("n_samples"))
        .select(*strata, "feature", "n_samples", F.col("e.idx").alias("idx"), F.col("e.count").alias("counts"))
    )


def _packed_size_factors(packed: DataFrame, plan: DataFrame, strata: Sequence[str], bucket_rows: int) -> DataFrame:
    logs = F.transform("counts", lambda c: F.ln(c))
    full = packed.filter(F.size("idx") == F.col("n_samples")).withColumn("__ln", logs)
    mean = F.aggregate("__ln", F.lit(0.0), lambda a, v: a + v) / F.col("n_samples")
    ratios = (
        full.withColumn("__mean", mean)
        .select(*strata, "__mean", F.inline(F.arrays_zip("idx", "__ln")))
        .select(*strata, "idx", (F.col("__ln") - F.col("__mean")).alias("lr"))
    )
    medians = exact_median(ratios, "lr", [*strata, "idx"], bucket_rows=bucket_rows)
    keys = [*strata, "idx"]
    return plan.join(_bare(medians, keys, "m"), _on(keys, "m"), "left").select(
        *plan.columns, F.exp("median").alias("size_factor"))


def size_factors(
    df: DataFrame, samples: DataFrame, sample: str, feature: str, count: str, arm: str, control, treated,
    strata: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Median-of-ratios size factor per sample, over features counted in every sample of the stratum."""
    plan = design(samples, sample, arm, control, treated, strata)
    packed = pack_counts(df, plan, sample, feature, count, strata)
    return _packed_size_factors(packed, plan, strata, bucket_rows).select(*strata, "sample", "size_factor")


def norm_mean(df: DataFrame, factors: DataFrame, sample: str, feature: str, count: str, strata: Sequence[str] = ()) -> DataFrame:
    """``baseMean``: mean normalised count over all samples of the stratum, zeros included.

    The sum runs over stored cells only; the number of samples comes from ``factors``.
    """
    sized = factors.withColumn("n_samples", F.count(F.lit(1)).over(Window.partitionBy(*strata)))
    own = [k for k in strata if k in df.columns]
    cells = df.select(*own, F.col(sample).alias("sample"), feature, round_half_even(count).alias("__c")).filter("__c != 0")
    joined = attach_group_values(cells, sized, [*own, "sample"], [feature]).filter("size_factor IS NOT NULL")
    return joined.groupBy(*strata, feature).agg(
        (F.sum(F.col("__c") / F.col("size_factor")) / F.max("n_samples")).alias("baseMean"))


def _dense(table: pa.Table, n: int) -> np.ndarray:
    rows, idx = _flat(table["idx"])
    _, val = _flat(table["counts"])
    y = np.zeros((len(table), n))
    np.add.at(y, (rows, idx), val)
    return y


def _plan_arrays(plan: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(plan["idx"].to_numpy())
    return plan["size_factor"].to_numpy()[order], plan["arm"].to_numpy()[order]


def _gene_task(names: list[str], schema: pa.Schema):
    def run(key: tuple, feats: pa.Table, plan: pa.Table) -> pa.Table:
        if not len(feats) or not len(plan):
            return schema.empty_table()
        sf, arm = _plan_arrays(plan)
        mean, disp = nbfit.gene_wise(_dense(feats, len(sf)), sf, arm)
        out = feats.select(names)
        return out.append_column("base_mean", pa.array(mean)).append_column("disp_gene", pa.array(disp))

    return run


def _fitted_rows(feats: pa.Table, strata: list[str], mean, disp, b1, se, settled) -> dict:
    out = {c: feats[c] for c in [*strata, "feature"]}
    return out | {"baseMean": pa.array(mean), "dispersion": pa.array(disp), "log2FoldChange": pa.array(b1 / LN2), "lfcSE": pa.array(se / LN2), "converged": pa.array(settled)}


def _wald_task(strata: list[str], schema: pa.Schema):
    def run(key: tuple, feats: pa.Table, plan: pa.Table) -> pa.Table:
        if not len(feats) or not len(plan):
            return schema.empty_table()
        sf, arm = _plan_arrays(plan)
        prior, resid, limit, kind = (plan[c][0].as_py() for c in ("prior_var", "resid_var", "cook_limit", "trend"))
        limit = np.inf if limit is None else limit
        curve = [plan[c][0].as_py() for c in ("a0", "a1", "low", "step", "curve")]

        def fit(y, gene, mean):
            # A stratum without a trend has nothing to draw its dispersions towards: they are final as they are.
            trend = None if kind is None else _trend_values(mean, *curve)
            disp = gene if trend is None or prior is None else nbfit.final_dispersion(y, sf, arm, gene, trend, prior, resid)
            return disp, np.full(len(y), np.nan) if trend is None else trend, *nbfit.wald_fit(y, sf, arm, disp)[1:]

        y, mean, gene = _dense(feats, len(sf)), feats["base_mean"].to_numpy().copy(), feats["disp_gene"].to_numpy().copy()
        disp, trend, b1, se, settled, mu, hat = fit(y, gene, mean)
        cook, flag = nbfit.cook_flags(y, sf, arm, mu, hat, limit)
        clean = nbfit.without_outliers(y, sf, arm, nbfit.cook_distances(y, sf, arm, mu, hat), limit)
        replaced = (clean != y).any(axis=1)
        if replaced.any():  # these features only are fitted again
            some = np.flatnonzero(replaced & (clean.sum(axis=1) > 0))
            mean[some], gene[some] = nbfit.gene_wise(clean[some], sf, arm)
            again = fit(clean[some], gene[some], mean[some])
            for whole, part in zip((disp, trend, b1, se, settled), again):
                whole[some] = part
        large = nbfit.many_replicates(arm)
        if large.any():  # outliers of large arms have been dealt with; those of small arms still flag a feature
            flag = nbfit.cook_flags(y, sf, arm, mu, hat, limit, skip=large)[1]
        out = _fitted_rows(feats, strata, mean, disp, b1, se, settled) | {
            "max_cook": pa.array(cook, mask=~np.isfinite(cook)), "cook_outlier": pa.array(flag), "replaced": pa.array(replaced),
            "trend": pa.array([kind] * len(feats), pa.string()), "trend_value": pa.array(trend, mask=np.isnan(trend)),
        }
        return pa.table(out).select(schema.names)

    return run


def _trend_values(mean: np.ndarray, a0, a1, low, step, curve) -> np.ndarray:
    """The trend at ``mean``: a0 + a1 / mean, or a curve over the log mean."""
    if curve is None:
        return a0 + a1 / mean
    return np.exp(np.interp(np.log(mean), low + step * np.arange(len(curve)), curve))


def _trend_column(mean: str) -> Column:
    """``_trend_values`` as an expression over the columns of a trend table."""
    last = F.size("curve") - 1
    at = F.greatest(F.least(F.try_divide(F.ln(F.col(mean)) - F.col("low"), F.col("step")), last.cast("double")), F.lit(0.0))
    i = F.least(F.floor(at), last - 1).cast("int")
    below, above = F.get("curve", i), F.get("curve", i + 1)
    return F.when(F.col("curve").isNull(), F.col("a0") + F.col("a1") / F.col(mean)).otherwise(F.exp(below + (at - i) * (above - below)))


def _fit_bins(packed: DataFrame, strata: Sequence[str]) -> int:
    """Bins per stratum: enough for the largest stratum to keep a task within ``TASK_CELLS``."""
    sizes = packed.groupBy(*strata).agg(F.count(F.lit(1)).alias("f"), F.max("n_samples").alias("n"))
    most, cells, count = sizes.agg(F.max("f"), F.max(F.col("f") * F.col("n")), F.count(F.lit(1))).head()
    spare = packed.sparkSession.sparkContext.defaultParallelism // max(count, 1)
    return max(1, math.ceil((cells or 1) / TASK_CELLS), min((most or 0) // 64, spare))


def _binned(packed: DataFrame, plan: DataFrame, bins: int, strata: Sequence[str]):
    left = packed.withColumn("bin", F.pmod(F.xxhash64("feature"), F.lit(bins)).cast("int"))
    right = plan.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return left.groupBy(*strata, "bin").cogroup(right.groupBy(*strata, "bin"))


def _trend_step(old: tuple, curve: Sequence[float], pull: tuple) -> tuple | None:
    """Solve the two-by-two step; None unless the curvature is positive and both coefficients stay positive."""
    det = curve[0] * curve[2] - curve[1] ** 2
    if det <= 0 or curve[0] <= 0:
        return None
    new = (old[0] + (curve[2] * pull[0] - curve[1] * pull[1]) / det, old[1] + (curve[0] * pull[1] - curve[1] * pull[0]) / det)
    return new if min(new) > 0 else None


#: Bins of the log mean that a local trend is computed from, and knots of its curve.
TREND_BINS, TREND_KNOTS = 512, 129


def _curve_task(names: list[str], kinds: dict):
    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        low, high = bins["low"].iloc[0], bins["high"].iloc[0]
        width = (high - low) / TREND_BINS
        x = low + (bins["bin"].to_numpy() + 0.5) * width
        knots = np.linspace(low, high, TREND_KNOTS)
        curve = nbfit.local_curve(x, bins[[f"m{j}" for j in range(5)]].to_numpy(), bins[[f"p{j}" for j in range(3)]].to_numpy(), bins["n"].to_numpy(), knots)
        return pd.DataFrame([[*key, "local", None, None, low, (high - low) / (TREND_KNOTS - 1), curve.tolist()]], columns=names).astype(kinds)

    return run


def local_trend(points: DataFrame, strata: Sequence[str], mean: str = "base_mean", disp: str = "disp_gene") -> DataFrame:
    """Trend of the log dispersion over the log mean by local regression, points weighted by their mean; columns as of ``dispersion_trend``.

    Points are summed into bins of the log mean, and a stratum's curve comes from its bins, so its size does not matter. A stratum whose points share one
    mean, or that has under four of them, keeps their average.
    """
    strata = list(strata)
    x, y, w = F.ln(mean), F.ln(disp), F.col(mean)
    ends = points.groupBy(*strata).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(F.lit(1)).alias("__n"), F.avg(disp).alias("flat"))
    joined = points.join(_bare(ends, strata, "e"), _on(strata, "e")).drop(*[f"__e_{k}" for k in strata])
    curved = (F.col("high") > F.col("low")) & (F.col("__n") >= 4)
    width = (F.col("high") - F.col("low")) / TREND_BINS
    binned = joined.filter(curved).withColumn("bin", F.least(F.floor((x - F.col("low")) / width), F.lit(TREND_BINS - 1)).cast("int"))
    off = x - (F.col("low") + (F.col("bin") + 0.5) * width)
    sums = binned.groupBy(*strata, "bin", "low", "high").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(w * F.pow(off, F.lit(j))).alias(f"m{j}") for j in range(5)], *[F.sum(w * y * F.pow(off, F.lit(j))).alias(f"p{j}") for j in range(3)])
    schema = _trend_schema(points, strata)
    found = sums.groupBy(*strata).applyInPandas(_curve_task(schema.names, {"a0": "float64", "a1": "float64"}), schema)
    flat = ends.filter(~curved).select(*strata, F.lit("mean").alias("trend"), F.col("flat").alias("a0"), F.lit(0.0).alias("a1"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("step"),
                                       F.lit(None).cast("array<double>").alias("curve"))
    return found.unionByName(flat)


def _trend_schema(points: DataFrame, strata: Sequence[str]) -> T.StructType:
    out = T.StructType([points.schema[k] for k in strata]).add("trend", "string")
    for name in ("a0", "a1", "low", "step"):
        out = out.add(name, "double")
    return out.add("curve", T.ArrayType(T.DoubleType()))


def dispersion_trend(points: DataFrame, strata: Sequence[str], mean: str = "base_mean", disp: str = "disp_gene",
                     max_iter: int = 60) -> DataFrame:
    """Gamma regression ``disp = a0 + a1 / mean`` per stratum by scoring steps, one aggregation each.

    At each step only points whose ratio to the current trend is inside (1e-4, 15) count. A stratum whose fit turns non-positive, or has not settled after
    ``max_iter`` steps, gets a local regression instead. Returns ``(strata, trend, a0, a1, low, step, curve)``: the kind of the trend, the coefficients of the
    parametric one, and the curve of the local one over even steps of the log mean. The driver sees one row per stratum and step.
    """
    spark = points.sparkSession
    strata = list(strata)
    x, y = 1 / F.col(mean), F.col(disp)
    state = {
        tuple(r[k] for k in strata): (0.1, 1.0, False)
        for r in points.select(*strata, F.lit(1).alias("__one")).distinct().collect()
    }
    fields = T.StructType([points.schema[k] for k in strata]).add("__a0", "double").add("__a1", "double")
    for step in range(max_iter):
        open_ = {k: v for k, v in state.items() if not v[2]}
        if not open_:
            break
        now = small_table(spark, [(*k, v[0], v[1]) for k, v in open_.items()], fields)
        fit = F.col("__a0") + F.col("__a1") * x
        ratio = y / fit
        w = F.when((ratio > 1e-4) & (ratio < 15), 1 / (fit * fit)).otherwise(0.0)
        powers = (F.lit(1.0), x, x * x)
        sums = (
            points.join(_bare(now, strata, "n"), _on(strata, "n"), "inner")
            .withColumns({"__w": w, "__u": w * ratio})
            .groupBy(*strata)
            .agg(
                *[F.sum(F.col("__w") * v).alias(f"w{i}") for i, v in enumerate(powers)],
                *[F.sum(F.col("__u") * v).alias(f"u{i}") for i, v in enumerate(powers)],
                F.sum(F.col("__w") * (y - fit)).alias("g0"), F.sum(F.col("__w") * x * (y - fit)).alias("g1"),
            )
        )
        for r in sums.collect():
            key = tuple(r[k] for k in strata)
            old = state[key][:2]
            weights = [r[f"w{i}"] for i in range(3)]
            new = _trend_step(old, weights, (r["g0"], r["g1"]))
            if step > 1:  # near the optimum the observed curvature converges faster than the expected one
                new = _trend_step(old, [2 * r[f"u{i}"] - v for i, v in enumerate(weights)], (r["g0"], r["g1"])) or new
            if new is None:
                state[key] = (None, None, True)
            else:
                state[key] = (*new, sum(abs(math.log(n / o)) for n, o in zip(new, old)) < 1e-7)
    found = [(*k, "parametric", v[0], v[1], None, None, None) for k, v in state.items() if v[2] and v[0] is not None]
    fitted = small_table(spark, found, _trend_schema(points, strata))
    if len(found) == len(state):
        return fitted
    left = small_table(spark, [k for k, v in state.items() if not v[2] or v[0] is None], T.StructType([points.schema[k] for k in strata])) if strata else None
    some = points if left is None else points.join(_bare(left, strata, "l"), _on(strata, "l"), "left_semi")
    return fitted.unionByName(durable(local_trend(some, strata, mean, disp)))


#: With so few residual degrees of freedom the spread of log dispersions is matched, not computed; candidates for the prior variance, and bins of the residuals.
FEW_DF = 3
SPREADS, RESIDUALS = np.arange(0, 801) / 100, np.arange(-40, 41) / 2


@lru_cache(maxsize=8)
def _residual_shares(df: int) -> np.ndarray:
    """Chance of each residual bin for each prior variance: log chi-square over its degrees of freedom plus a normal variable, by convolution."""
    gap = 0.05
    z = np.arange(-800, 801) * gap
    log_x = z + math.log(df)
    density = np.exp(df * log_x / 2 - np.exp(np.minimum(log_x, 50)) / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
    out = np.empty((len(SPREADS), len(RESIDUALS) - 1))
    slot = np.floor((z - RESIDUALS[0]) / 0.5 + 1e-9).astype(int)
    inside = (slot >= 0) & (slot < out.shape[1])
    for i, v in enumerate(SPREADS):
        reach = np.arange(-int(8 * math.sqrt(v) / gap) - 1, int(8 * math.sqrt(v) / gap) + 2) * gap
        kernel = np.exp(-reach**2 / (2 * max(v, 1e-9)))
        full = np.convolve(density, kernel / kernel.sum(), "same")
        out[i] = np.bincount(slot[inside], full[inside] * gap, out.shape[1])
    return out


def matched_spread(residuals: DataFrame, value: str, df: str, strata: Sequence[str]) -> DataFrame:
    """``(strata, spread)``: variance of the normal part of log dispersions around the trend, where the chi-square part is known by ``df`` (at most ``FEW_DF``).

    Residuals are counted by bins of one half; the variance is the one whose table of chances has the least divergence from these counts.
    """
    spark, strata = residuals.sparkSession, list(strata)
    small = 1e-6
    dfs = [r[0] for r in residuals.select(df).distinct().collect()]
    rows = [(k, float(v), b, float(math.log(share + small))) for k in dfs for v, shares in zip(SPREADS, _residual_shares(k)) for b, share in enumerate(shares)]
    table = small_table(spark, rows, T.StructType().add("__df", "integer").add("spread", "double").add("bin", "integer").add("__log", "double"))
    bins = F.floor((F.col(value) - float(RESIDUALS[0])) * 2).cast("int")
    counts = residuals.withColumn("bin", bins).filter(F.col("bin").between(0, len(RESIDUALS) - 2)).groupBy(*strata, F.col(df).alias("__df"), "bin").agg(F.count(F.lit(1)).alias("__n"))
    total = counts.groupBy(*strata).agg(F.sum("__n").alias("__all"))
    shares = counts.join(_bare(total, strata, "t"), _on(strata, "t")).withColumn("__p", F.col("__n") / F.col("__all")).select(*strata, "__df", "bin", "__p")
    apart = shares.join(table, ["__df", "bin"]).groupBy(*strata, "spread").agg(F.sum(F.col("__p") * (F.ln(F.col("__p") + small) - F.col("__log"))).alias("__apart"))
    return apart.groupBy(*strata).agg(F.min(F.struct("__apart", "spread"))["spread"].alias("spread"))


def dispersion_prior(points: DataFrame, trend: DataFrame, strata: Sequence[str], n_samples: DataFrame,
                     bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spread of log dispersions around the trend (by median absolute deviation) and the prior variance.

    The prior variance is that spread less the sampling variance of a log dispersion; with at most ``FEW_DF`` residual degrees of freedom, where the sampling
    distribution is far from normal, it is matched (``matched_spread``).
    """
    keys = list(strata)
    resid = points.join(_bare(trend, keys, "t"), _on(keys, "t"), "inner").select(
        *keys, F.ln(F.col("disp_gene") / _trend_column("base_mean")).alias("res"))
    mid = exact_median(resid, "res", keys, "mid", bucket_rows)
    off = resid.join(_bare(mid, keys, "m"), _on(keys, "m"), "inner").withColumn("off", F.abs(F.col("res") - F.col("mid"))).select(*keys, "off")
    mad = exact_median(off, "off", keys, "mad", bucket_rows)
    known = mad.join(_bare(n_samples, keys, "n"), _on(keys, "n"), "inner").select(*keys, "mad", "n_samples")
    few = resid.join(_bare(n_samples, keys, "n"), _on(keys, "n")).drop(*[f"__n_{k}" for k in keys]).withColumn(
        "df", F.greatest(F.col("n_samples") - 2, F.lit(1)).cast("int")).filter(F.col("df") <= FEW_DF)
    # One row per stratum: the sampling variance of a log dispersion depends on the sample count only.
    strata_rows = known.collect()
    matched = {tuple(r[k] for k in keys): r["spread"] for r in matched_spread(few, "res", "df", keys).collect()} if any(r["n_samples"] - 2 <= FEW_DF for r in strata_rows) else {}
    rows = []
    for r in strata_rows:
        key, spread = tuple(r[k] for k in keys), (1.4826 * r["mad"]) ** 2
        rows.append((*key, spread, max(matched[key] if key in matched else spread - nbfit.trigamma(max(r["n_samples"] - 2, 1) / 2), 0.25)))
    schema = T.StructType([points.schema[k] for k in keys]).add("resid_var", "double").add("prior_var", "double")
    return small_table(points.sparkSession, rows, schema)


def wald_statistics(df: DataFrame, lfc: str = "log2FoldChange", se: str = "lfcSE", outlier: str | None = None) -> DataFrame:
    """Add ``stat`` and two-sided normal ``pvalue``; a flagged outlier has no p-value."""
    out = df.withColumn("stat", F.try_divide(F.col(lfc), F.col(se)))
    p = normal_p_value(F.col("stat"))
    return out.withColumn("pvalue", F.when(~F.col(outlier), p) if outlier else p)


def _estimates(df, samples, sample, feature, count, arm, control, treated, strata, bucket_rows) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Packed counts with gene-wise figures, the samples with all figures of their stratum, the fits, and the number of bins."""
    spark = df.sparkSession
    ship(spark)
    strata = list(strata)
    plan = durable(design(samples, sample, arm, control, treated, strata))
    packed = durable(pack_counts(df, plan, sample, feature, count, strata))
    sized = durable(_packed_size_factors(packed, plan, strata, bucket_rows))
    lacking = sized.filter("size_factor IS NULL").limit(1).collect()
    if lacking:
        raise ValueError(f"no feature is counted in every sample of the stratum of {lacking[0]['sample']!r}: size factors are undefined")
    bins = _fit_bins(packed, strata)

    out1 = T.StructType([packed.schema[c] for c in packed.columns]).add("base_mean", "double").add("disp_gene", "double")
    gene = durable(_binned(packed, sized, bins, strata).applyInArrow(_gene_task(packed.columns, to_arrow_schema(out1)), out1))

    points = gene.filter(F.col("disp_gene") > nbfit.FIT_DISP).select(*strata, "base_mean", "disp_gene")
    trend = dispersion_trend(points, strata)
    per_stratum = plan.groupBy(*strata).agg(F.max("n_samples").alias("n_samples"))
    prior = dispersion_prior(points, trend, strata, per_stratum, bucket_rows)
    limits = {
        r["n_samples"]: f_quantile(nbfit.COOK_PROB, 2, r["n_samples"] - 2)
        for r in per_stratum.select("n_samples").distinct().collect() if r["n_samples"] > 2
    }
    limit = F.lit(None).cast("double")
    for n, q in limits.items():
        limit = F.when(F.col("n_samples") == n, F.lit(q)).otherwise(limit)
    params = trend.join(_bare(prior, strata, "p"), _on(strata, "p"), "left").drop(*[f"__p_{k}" for k in strata])
    full_plan = (
        sized.join(_bare(params, strata, "t"), _on(strata, "t"), "left").drop(*[f"__t_{k}" for k in strata])
        .withColumn("cook_limit", limit)
    )
    out2 = (
        T.StructType([packed.schema[c] for c in [*strata, "feature"]])
        .add("baseMean", "double").add("dispersion", "double").add("log2FoldChange", "double").add("lfcSE", "double")
        .add("converged", "boolean").add("max_cook", "double").add("cook_outlier", "boolean").add("replaced", "boolean").add("trend", "string").add("trend_value", "double")
    )
    fits = _binned(gene, full_plan, bins, strata).applyInArrow(_wald_task(strata, to_arrow_schema(out2)), out2)
    return gene, full_plan, durable(fits), bins


def nb_wald(
    df: DataFrame, samples: DataFrame, sample: str, feature: str, count: str, arm: str, control, treated,
    strata: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Fold change of treated over control per (stratum, feature) with dispersion, se, Wald statistic and p.

    Size factors, gene-wise dispersions, trend, prior, final dispersions and coefficients are estimated
    per stratum. A stratum in which no dispersion rises above the floor has no trend; its gene-wise dispersions are
    final, and every feature stays. ``trend`` names the kind of its trend. In arms of seven or more samples counts of too great an influence are replaced and
    their features fitted again (``replaced``); in smaller ones such a feature has no p-value. ``converged`` tells whether a fit settled. The result is a written table, so that
    filtering and adjustment can pass over it again.
    """
    fits = _estimates(df, samples, sample, feature, count, arm, control, treated, strata, bucket_rows)[2]
    return durable(wald_statistics(fits.drop("trend_value"), outlier="cook_outlier"))


def fold_change_prior(df: DataFrame, lfc: str, weight: str, strata: Sequence[str] = (), upper: float = 0.05, cap: float = 10.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(strata, n, upper_quantile, prior_var)``: width of a normal prior whose upper quantile is that of the absolute fold changes.

    The quantile weighs each fold change by ``weight``, scaled to a mean of one; fold changes of ``cap`` and more do not count. Values are reduced to distinct ones
    with their weights, and the running weight is carried over buckets, so a stratum may have any number of features.
    """
    strata = list(strata)
    known = df.filter(F.abs(F.col(lfc)) < cap).filter(F.col(weight) > 0).select(*strata, F.abs(F.col(lfc)).alias("x"), F.col(weight).alias("w"))
    values = value_table(known, "x", strata, {"w": F.sum("w")}).withColumnsRenamed({"ties": "rows"}).withColumnRenamed("w", "ties")
    running = running_counts(values, "x", strata, bucket_rows)
    sizes = known.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    at = running.join(_bare(sizes, strata, "s"), _on(strata, "s")).drop(*[f"__s_{k}" for k in strata])
    reached = (F.col("before") + F.col("ties")) * F.col("n") / F.col("total") + F.lit(1e-9)
    spot = 1 + (F.col("n") - 1) * (1 - upper)
    low = F.greatest(F.floor(spot), F.lit(1))
    picks = at.groupBy(*strata).agg(
        F.max("n").alias("n"), F.max("x").alias("top"), F.min(F.when(reached >= low, F.col("x"))).alias("lo"),
        F.min(F.when(reached >= F.least(low + 1, F.col("n")), F.col("x"))).alias("hi"), F.max(spot - F.floor(spot)).alias("part"))
    quantile = (1 - F.col("part")) * F.coalesce("lo", "top") + F.col("part") * F.coalesce("hi", "top")
    z = statistics.NormalDist().inv_cdf(1 - upper / 2)
    return picks.select(*strata, "n", quantile.alias("upper_quantile"), F.pow(quantile / z, F.lit(2.0)).alias("prior_var"))


def _map_task(strata: list[str], schema: pa.Schema):
    def run(key: tuple, feats: pa.Table, plan: pa.Table) -> pa.Table:
        if not len(feats) or not len(plan):
            return schema.empty_table()
        sf, arm = _plan_arrays(plan)
        width = plan["lfc_var"][0].as_py()
        disp = feats["dispersion"].to_numpy()
        # Without a prior width (no fold change to match) the fit is the plain one.
        ridge = nbfit.RIDGE if not width else 1 / (width * LN2**2)
        _, b1, se, settled, _, _ = nbfit.wald_fit(_dense(feats, len(sf)), sf, arm, disp, ridge=ridge)
        out = _fitted_rows(feats, strata, feats["base_mean"].to_numpy(), disp, b1, se, settled)
        return pa.table(out | {"prior_var": pa.array([width] * len(feats), pa.float64())}).select(schema.names)

    return run


def shrunken_wald(
    df: DataFrame, samples: DataFrame, sample: str, feature: str, count: str, arm: str, control, treated,
    strata: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``nb_wald`` with fold changes drawn towards zero by a normal prior, whose width all features of a stratum give together.

    The prior is matched to the plain fold changes (``fold_change_prior``), each weighted by the precision that its mean and the trend imply; then every feature is
    fitted once more with that prior and the dispersion it has. ``plain`` is the fold change without the prior. An influential count is not replaced here; a
    feature that ``nb_wald`` flags has no p-value.
    """
    strata = list(strata)
    gene, plan, fits, bins = _estimates(df, samples, sample, feature, count, arm, control, treated, strata, bucket_rows)
    weighted = fits.withColumn("weight", 1 / (1 / F.col("baseMean") + F.coalesce("trend_value", "dispersion")))
    width = durable(fold_change_prior(weighted, "log2FoldChange", "weight", strata, bucket_rows=bucket_rows))
    keys = [*strata, "feature"]
    plain = fits.select(*keys, "dispersion", F.col("log2FoldChange").alias("plain"), "cook_outlier")
    feats = gene.drop("disp_gene").join(_bare(plain.drop("plain", "cook_outlier"), keys, "f"), _on(keys, "f")).drop(*[f"__f_{k}" for k in keys])
    priors = plan.join(_bare(width.select(*strata, F.col("prior_var").alias("lfc_var")), strata, "w"), _on(strata, "w"), "left").drop(*[f"__w_{k}" for k in strata])
    schema = (T.StructType([gene.schema[c] for c in keys]).add("baseMean", "double").add("dispersion", "double").add("log2FoldChange", "double").add("lfcSE", "double")
              .add("converged", "boolean").add("prior_var", "double"))
    out = _binned(feats, priors, bins, strata).applyInArrow(_map_task(strata, to_arrow_schema(schema)), schema)
    out = out.join(_bare(plain.drop("dispersion"), keys, "p"), _on(keys, "p")).drop(*[f"__p_{k}" for k in keys])
    return durable(wald_statistics(out, outlier="cook_outlier"))




def rejections_by_cutoff(
    df: DataFrame, p: str, filter_by: str, alpha: float, family: Sequence[str] = (), steps: int = 50,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """How many features BH rejects at ``alpha`` if those below a quantile of ``filter_by`` are left out.

    One row per (family, step): ``theta``, ``cutoff``, ``n_rej``. Only p-values below ``alpha`` can be
    rejected, so only they are ranked, once per cut-off they pass.
    """
    family = list(family)
    thetas = [float(v) for v in np.linspace(0.0, 0.95, steps)]
    cuts = exact_quantiles(df, filter_by, thetas, family, bucket_rows)
    cuts = durable(cuts.withColumn("quantiles", F.transform("quantiles", lambda v: v.cast("double"))))
    tested = (
        df.filter(F.col(p).isNotNull()).select(*family, F.col(p).alias("p"), F.col(filter_by).alias("by"))
        .join(_bare(cuts, family, "q"), _on(family, "q"), "inner")
        .select(*family, "p", F.size(F.filter("quantiles", lambda c: c <= F.col("by"))).alias("passes"))
    )
    grid = cuts.select(*family, F.posexplode("quantiles").alias("step", "cutoff"))
    reach = tested.groupBy(*family, "passes").agg(F.count(F.lit(1)).alias("n"))
    m = (
        reach.withColumn("step", F.explode(F.sequence(F.lit(0), F.greatest(F.col("passes") - 1, F.lit(0)))))
        .filter("step < passes").groupBy(*family, "step").agg(F.sum("n").alias("m"))
    )
    small = tested.filter(F.col("p") < F.lit(alpha)).filter("passes > 0").withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    keys = [*family, "step"]
    ranked = running_counts(value_table(small, "p", keys), "p", keys, bucket_rows)
    ranked = ranked.join(_bare(m, keys, "m"), _on(keys, "m"), "inner").withColumn("upto", F.col("before") + F.col("ties"))
    rejected = ranked.filter(F.col("p") * F.col("m") / F.col("upto") < F.lit(alpha)).groupBy(*keys).agg(F.max("upto").alias("n_rej"))
    return grid.join(_bare(rejected, keys, "r"), _on(keys, "r"), "left").select(
        *family, "step", F.element_at(F.array(*[F.lit(t) for t in thetas]), F.col("step") + 1).alias("theta"), "cutoff",
        F.coalesce("n_rej", F.lit(0)).cast("long").alias("n_rej"))


def _choose_step(n_keys: int, names: list[str]):
    def run(key: tuple, curve: pd.DataFrame) -> pd.DataFrame:
        curve = curve.sort_values("step")
        rej = curve["n_rej"].to_numpy(dtype=float)
        pick = 0
        if rej.max() > 10:
            fit = nbfit.smooth(curve["theta"].to_numpy(), rej)
            rest = (rej - fit)[rej > 0]
            enough = np.flatnonzero(rej > fit.max() - math.sqrt((rest**2).mean()))
            pick = int(enough[0]) if len(enough) else 0
        return pd.DataFrame([[*key[:n_keys], float(curve["cutoff"].iloc[pick])]], columns=names)

    return run


def filtered_bh(
    df: DataFrame, p: str, filter_by: str, alpha: float, family: Sequence[str] = (), out: str = "padj",
    steps: int = 50, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """BH adjustment after independent filtering at ``alpha``; filtered features have a NULL ``out``.

    The cut-off is the first whose rejections come within one residual spread of the smoothed curve's top;
    with ten or fewer rejections nothing is filtered.
    """
    ship(df.sparkSession)
    family = list(family)
    curve = rejections_by_cutoff(df, p, filter_by, alpha, family, steps, bucket_rows)
    schema = T.StructType([df.schema[k] for k in family]).add("__cut", "double")
    chosen = curve.groupBy(*family).applyInPandas(_choose_step(len(family), schema.names), schema)
    marked = df.join(_bare(chosen, family, "c"), _on(family, "c"), "left").drop(*[f"__c_{k}" for k in family])
    marked = durable(marked.withColumn("__p", F.when(F.col(filter_by) >= F.col("__cut"), F.col(p))))
    return bh_adjust(marked, "__p", family, out, bucket_rows=bucket_rows).drop("__p", "__cut")


def differential(
    df: DataFrame, samples: DataFrame, sample: str, feature: str, count: str, arm: str, control, treated,
    alpha: float, strata: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The full result table: nb_wald, then filtered BH at ``alpha``."""
    fits = nb_wald(df, samples, sample, feature, count, arm, control, treated, strata, bucket_rows)
    result = filtered_bh(fits, "pvalue", "baseMean", alpha, strata, bucket_rows=bucket_rows)
    return result.select(*strata, "feature", "baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj", "converged")
