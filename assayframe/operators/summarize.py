"""Group summaries. Every function is one partial-then-final aggregation unless it says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.columns import ratio, strict, value_at
from assayframe.operators.joins import with_total
from assayframe.session import durable


def mean_sd(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean and sample sd of every measure, as ``<measure>_mean`` and ``<measure>_sd``."""
    aggs = []
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    return df.groupBy(*keys).agg(*aggs)


def peak(df: DataFrame, keys: Sequence[str], measure: str, out: str, skip_null: bool = False) -> DataFrame:
    """Largest value per group; NULL if the group holds a NULL, unless ``skip_null``."""
    agg = F.max(measure) if skip_null else strict(F.max, measure)
    return df.groupBy(*keys).agg(agg.alias(out))


def total(df: DataFrame, keys: Sequence[str], measure: str, out: str, skip_null: bool = False) -> DataFrame:
    agg = F.sum(measure) if skip_null else strict(F.sum, measure)
    return df.groupBy(*keys).agg(agg.alias(out))


def endpoint_change(
    df: DataFrame,
    keys: Sequence[str],
    first: Column,
    last: Column,
    measure: str,
    per: str | None = None,
    out: str = "change",
    ratio_out: str = "change_ratio",
) -> DataFrame:
    """Value at ``last`` minus value at ``first`` per group, and optionally its ratio to another measure's."""
    change = value_at(measure, last) - value_at(measure, first)
    aggs = [change.alias(out)]
    if per:
        aggs.append(ratio(change, value_at(per, last) - value_at(per, first)).alias(ratio_out))
    return df.groupBy(*keys).agg(*aggs)


def richness(df: DataFrame, sample: Sequence[str], abundance: str, out: str = "richness") -> DataFrame:
    """Number of features with positive abundance; samples that only hold zeros get 0."""
    return df.groupBy(*sample).agg(F.count_if(F.col(abundance) > 0).alias(out))


def distinct_count(df: DataFrame, keys: Sequence[str], column: str, out: str = "n_distinct") -> DataFrame:
    """Number of distinct non-NULL values per group. Values are made distinct first, so a hot group is counted by many tasks."""
    return df.select(*keys, column).distinct().groupBy(*keys).agg(F.count(column).alias(out))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str = "share_pct") -> DataFrame:
    """Per-key total and its percentage of the grand total."""
    per_key = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    grand = with_total(per_key, {"__grand": F.sum("total")})
    return grand.withColumn(out, 100 * F.try_divide(F.col("total"), F.col("__grand"))).drop("__grand")


def rollup_labels(
    shares: DataFrame,
    category: str,
    share: str,
    threshold: float,
    buckets: Mapping[str, Sequence[str]],
    other: str = "Other",
    out: str = "legend_label",
) -> DataFrame:
    """Name for each category: its own above the threshold, else its named bucket, else ``other``."""
    label = F.when(F.col(share) > F.lit(threshold), F.col(category).cast("string"))
    for name, members in buckets.items():
        label = label.when(F.col(category).isin(*members), F.lit(name))
    return shares.withColumn(out, label.otherwise(F.lit(other)))


def rollup_rare(
    df: DataFrame,
    sample: str,
    category: str,
    value: str,
    threshold: float,
    buckets: Mapping[str, Sequence[str]],
    other: str = "Other",
) -> DataFrame:
    """Per sample and legend label, the summed value after rare categories are pooled.

    The fact table is summed once to (sample, category), which is written; everything after reads that.
    """
    per_sample = durable(df.groupBy(sample, category).agg(F.sum(value).alias("__v")))
    shares = share_of_total(per_sample, [category], "__v")
    labels = rollup_labels(shares, category, "share_pct", threshold, buckets, other)
    named = per_sample.join(labels.select(category, "legend_label"), category, "inner")
    return named.groupBy(sample, "legend_label").agg(F.sum("__v").alias(value))
