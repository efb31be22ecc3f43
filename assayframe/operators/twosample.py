"""Variance-ratio and t tests between two arms, for many groups and measures in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assayframe.functions.columns import ratio
from assayframe.functions.tails import f_critical, f_p_value, t_critical, t_p_value


def arm_moments(df: DataFrame, groups: Sequence[str], arm: str, control, treated, measures: Sequence[str]) -> DataFrame:
    """Count, mean and variance by arm: one row per (group, measure)."""
    aggs = []
    for m in measures:
        for tag, level in (("1", control), ("2", treated)):
            v = F.when(F.col(arm) == F.lit(level), F.col(m).cast("double"))
            aggs += [
                F.count(v).alias(f"{m}__n{tag}"),
                F.avg(v).alias(f"{m}__m{tag}"),
                F.var_samp(v).alias(f"{m}__v{tag}"),
            ]
    wide = df.groupBy(*groups).agg(*aggs)
    fields = ("n1", "m1", "v1", "n2", "m2", "v2")
    each = F.array(*[
        F.struct(F.lit(m).alias("measure"), *[F.col(f"{m}__{f}").alias(f) for f in fields]) for m in measures
    ])
    return wide.select(*groups, F.inline(each))


def two_sample(
    df: DataFrame,
    groups: Sequence[str],
    arm: str,
    control,
    treated,
    measures: Sequence[str],
    alpha_f: float = 0.05,
    conf: float | None = None,
    conf_f: float | None = None,
) -> DataFrame:
    """F test of equal variances, pooled and Welch t tests, and the t test the F test calls for.

    The differences and ratios are control over treated. A zero variance on one side is the clearest case of
    unequal variances: F is infinite or 0 and its p-value 0. Zero on both sides leaves the statistics NULL. ``conf`` adds the confidence limits of the mean difference,
    ``conf_f`` those of the variance ratio (``f_lo``, ``f_hi``; NULL where the ratio is not a positive number).
    """
    m = arm_moments(df, groups, arm, control, treated, measures)
    c = F.col
    enough = (c("n1") > 1) & (c("n2") > 1)
    s1, s2 = c("v1") / c("n1"), c("v2") / c("n2")
    pooled = ((c("n1") - 1) * c("v1") + (c("n2") - 1) * c("v2")) / F.when(enough, c("n1") + c("n2") - 2)
    se_p = F.sqrt(pooled * (1 / c("n1") + 1 / c("n2")))
    se_w = F.sqrt(s1 + s2)
    stats = m.withColumns({
        "f": F.when(enough & (c("v2") == 0) & (c("v1") > 0), F.lit(float("inf"))).when(enough, ratio(c("v1"), c("v2"))),
        "df1": F.when(enough, c("n1") - 1),
        "df2": F.when(enough, c("n2") - 1),
    }).withColumns({
        "t_pooled": F.when(enough, ratio(c("m1") - c("m2"), se_p)),
        "df_pooled": F.when(enough, (c("n1") + c("n2") - 2).cast("double")),
        "t_welch": F.when(enough, ratio(c("m1") - c("m2"), se_w)),
        "df_welch": F.when(enough, ratio((s1 + s2) * (s1 + s2), s1 * s1 / (c("n1") - 1) + s2 * s2 / (c("n2") - 1))),
        "__sp": se_p,
        "__sw": se_w,
    })
    one_sided = (c("f") == 0) | (c("f") == float("inf"))
    stats = stats.withColumn("__f", F.when(~one_sided, c("f"))).withColumn(
        "p_f", F.when(one_sided, 0.0).otherwise(f_p_value(c("__f"), c("df1"), c("df2")))).drop("__f")
    welch = c("p_f") < F.lit(alpha_f)
    chosen = stats.withColumns({
        "choice": F.when(c("t_pooled").isNull(), F.lit(None).cast("string")).when(welch, F.lit("welch")).otherwise(F.lit("pooled")),
        "t": F.when(welch, c("t_welch")).otherwise(c("t_pooled")),
        "df": F.when(welch, c("df_welch")).otherwise(c("df_pooled")),
        "__se": F.when(welch, c("__sw")).otherwise(c("__sp")),
    }).withColumns({"p_t": t_p_value(c("t"), c("df"))})
    if conf is not None:
        half = t_critical(F.lit((1 + conf) / 2), c("df")) * c("__se")
        chosen = chosen.withColumns({
            "ci_lo": c("m1") - c("m2") - half,
            "ci_hi": c("m1") - c("m2") + half,
        })
    if conf_f is not None:
        plain = F.when(~one_sided, c("f"))
        chosen = chosen.withColumns({
            "f_lo": plain / f_critical(F.lit((1 + conf_f) / 2), c("df1"), c("df2")),
            "f_hi": plain / f_critical(F.lit((1 - conf_f) / 2), c("df1"), c("df2")),
        })
    return chosen.drop("__sp", "__sw", "__se")
