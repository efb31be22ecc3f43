"""Simple linear regression per group, in closed form from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assayframe.functions.columns import ratio
from assayframe.functions.tails import t_p_value


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, log_y: bool = False) -> DataFrame:
    """Slope, intercept, their standard errors, t statistics and two-sided p-values, r2 and n per group.

    With ``log_y`` the fit is log-linear: rows whose measure is not positive have no logarithm
    and are left out, as is any row with a NULL on either side.
    """
    yc = F.ln(F.when(F.col(y) > 0, F.col(y))) if log_y else F.col(y).cast("double")
    xc = F.col(x).cast("double")
    sums = df.groupBy(*keys).agg(
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.regr_count(yc, xc).alias("n"),
        F.regr_sxx(yc, xc).alias("__sxx"),
        F.regr_syy(yc, xc).alias("__syy"),
        F.regr_sxy(yc, xc).alias("__sxy"),
        F.regr_avgx(yc, xc).alias("__mx"),
    )
    rest = F.greatest(F.col("__syy") - ratio(F.col("__sxy") * F.col("__sxy"), F.col("__sxx")), F.lit(0.0))
    s2 = ratio(rest, F.when(F.col("n") > 2, F.col("n") - 2))
    fit = sums.select(
        *keys, "slope", "intercept",
        F.sqrt(ratio(s2, F.col("__sxx"))).alias("slope_se"),
        F.sqrt(s2 * (1 / F.col("n") + ratio(F.col("__mx") * F.col("__mx"), F.col("__sxx")))).alias("intercept_se"),
        "r2", "n",
    )
    df_ = F.when(F.col("n") > 2, F.col("n") - 2)
    for term in ("slope", "intercept"):
        fit = fit.withColumn(f"{term}_t", ratio(F.col(term), F.col(f"{term}_se"))).withColumn(f"{term}_p", t_p_value(F.col(f"{term}_t"), df_))
    return fit


def growth_rate(df: DataFrame, keys: Sequence[str], days: str, measure: str, out: str = "mu") -> DataFrame:
    """Log-linear growth rate per group: the slope of ln(measure) on days."""
    return linear_fit(df, keys, days, measure, log_y=True).select(*keys, F.col("slope").alias(out))
