"""Exact ranks, running totals, quantiles and step-up adjustment over whole columns.

An ordered window without partitions would put every row in one task. Here the column is first reduced to
its distinct values with counts, values are cut into ordered buckets of about equal size, and the running
figures are taken inside buckets and carried across them through one row per bucket. The cut points only
decide how work is spread; the results do not depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayframe.functions.columns import salt
from assayframe.operators.joins import _bare, _on
from assayframe.session import durable

#: Distinct values that one window task may sort.
BUCKET_ROWS = 1_000_000
#: Most buckets asked for; beyond that, buckets grow and Spark sorts them with spill.
MAX_BUCKETS = 10_000
#: A value is hot when it has more than one in this many of all rows, so at most this many are hot.
HOT_SHARE = 10_000


def value_table(
    df: DataFrame, value: str, strata: Sequence[str] = (), extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Distinct non-NULL values per stratum with ``ties`` and any further aggregates."""
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*strata, value)
        .agg(F.count(F.lit(1)).alias("ties"), *more)
    )


def _bucketed(table: DataFrame, value: str, bucket_rows: int) -> tuple[DataFrame, int]:
    table = durable(table)
    wanted = min(math.ceil(table.count() / bucket_rows), MAX_BUCKETS)
    if wanted <= 1:
        return table.withColumn("bucket", F.lit(0)), 1
    probs = [i / wanted for i in range(1, wanted)]
    cuts = sorted(set(table.approxQuantile(value, probs, 0.25 / wanted)))
    splits = [-math.inf, *cuts, math.inf]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol="bucket", handleInvalid="keep")
    return cut.transform(table).withColumn("bucket", F.col("bucket").cast("int")), len(splits) - 1


def running_counts(
    table: DataFrame,
    value: str,
    strata: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``bucket``, ``before`` (rows with a smaller value) and ``total`` (rows) per stratum."""
    table, buckets = _bucketed(table, value, bucket_rows)
    inside = Window.partitionBy(*strata, "bucket").orderBy(value)
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    if buckets == 1:
        whole = Window.partitionBy(*strata, "bucket")
        return table.withColumns({
            "before": F.coalesce(F.sum("ties").over(below), F.lit(0)),
            "total": F.sum("ties").over(whole),
        })
    per_bucket = table.groupBy(*strata, "bucket").agg(F.sum("ties").alias("__n"))
    earlier = (
        Window.partitionBy(*strata).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bucket.select(
        *strata, "bucket",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(*strata)).alias("total"),
    )
    keys = [*strata, "bucket"]
    inner = table.withColumn("__in", F.coalesce(F.sum("ties").over(below), F.lit(0)))
    return (
        inner.join(_bare(offsets, keys, "o"), _on(keys, "o"), "inner")
        .withColumn("before", F.col("__offset") + F.col("__in"))
        .drop("__in", "__offset", *[f"__o_{k}" for k in keys])
    )


def suffix_min(table: DataFrame, value: str, target: str, strata: Sequence[str], out: str) -> DataFrame:
    """Smallest ``target`` among this and all larger values; ``table`` carries ``bucket``."""
    from_here = (
        Window.partitionBy(*strata, "bucket").orderBy(F.col(value).desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    later = (
        Window.partitionBy(*strata).orderBy(F.col("bucket").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    keys = [*strata, "bucket"]
    minima = table.groupBy(*keys).agg(F.min(target).alias("__m")).select(
        *keys, F.min("__m").over(later).alias("__later")
    )
    return (
        table.withColumn("__here", F.min(target).over(from_here))
        .join(_bare(minima, keys, "m"), _on(keys, "m"), "inner")
        .withColumn(out, F.least("__here", "__later"))
        .drop("__here", "__later", *[f"__m_{k}" for k in keys])
    )


def attach_by_value(
    rows: DataFrame,
    table: DataFrame,
    value: str,
    strata: Sequence[str],
    columns: Sequence[str],
    salt_on: Sequence[str],
    parts: int = 200,
) -> DataFrame:
    """Left join figures of a value table back to the rows that hold the values.

    Hot values (at most ``HOT_SHARE`` of them, by definition) are broadcast. Their rows then
    carry a random-like second key in the shuffle for the remaining values, so no task gets them all.
    """
    keys = [*strata, value]
    table = durable(table.select(*keys, "ties", *columns))
    n_rows = table.agg(F.sum("ties")).scalar()
    is_hot = F.col("ties") * F.lit(HOT_SHARE) > n_rows
    hot = table.filter(is_hot).withColumnsRenamed({c: f"__hot_{c}" for c in columns}).drop("ties")
    cold = table.filter(~is_hot).withColumnsRenamed({c: f"__cold_{c}" for c in columns})
    cold = cold.withColumn("__zero", F.lit(0)).drop("ties")
    step = rows.join(F.broadcast(_bare(hot, keys, "h").withColumn("__is_hot", F.lit(True))), _on(keys, "h"), "left")
    spread = F.when(F.col("__is_hot") | F.col(value).isNull(), salt(salt_on, parts) + 1).otherwise(F.lit(0))
    step = step.withColumn("__spread", spread).drop(*[f"__h_{k}" for k in keys])
    done = step.join(_bare(cold, keys, "c"), _on(keys, "c") & (F.col("__spread") == F.col("__zero")), "left")
    done = done.withColumns({c: F.coalesce(F.col(f"__hot_{c}"), F.col(f"__cold_{c}")) for c in columns})
    return done.select(*rows.columns, *columns)


def average_rank(
    df: DataFrame,
    value: str,
    strata: Sequence[str] = (),
    out: str = "avg_rank",
    salt_on: Sequence[str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rank of ``value`` within its stratum, tied values sharing the mean of their ranks."""
    counts = running_counts(value_table(df, value, strata), value, strata, bucket_rows)
    ranks = counts.withColumn(out, F.col("before") + (F.col("ties") + 1) / F.lit(2.0))
    return attach_by_value(df, ranks, value, strata, [out], salt_on or df.columns)


def bh_adjust(
    df: DataFrame,
    p: str,
    family: Sequence[str] = (),
    out: str = "padj",
    salt_on: Sequence[str] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each family. NULL p-values stay NULL and do not count."""
    counts = running_counts(value_table(df, p, family), p, family, bucket_rows)
    raw = F.col(p) * F.col("total") / (F.col("before") + F.col("ties"))
    stepped = suffix_min(counts.withColumn("__q", raw), p, "__q", family, out)
    stepped = stepped.withColumn(out, F.least(F.col(out), F.lit(1.0)))
    return attach_by_value(df, stepped, p, family, [out], salt_on or df.columns)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    strata: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Exact quantiles per stratum, linearly interpolated: array column ``quantiles`` in ``probs`` order.

    One way for any number of rows, so that a cut-off does not depend on the table's size. The built-in
    ``percentile`` would hold all distinct values of a group in one task.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = running_counts(value_table(known, value, strata), value, strata, bucket_rows)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])
    spot = F.col("q.q") * (F.col("total") - 1)
    here = lambda pos: (pos >= F.col("before")) & (pos < F.col("before") + F.col("ties"))
    # A value is looked at once per asked quantile; only the few that sit at an asked position go on.
    low, high = F.floor(spot), F.ceil(spot)
    picks = (
        counts.withColumn("q", F.explode(wanted))
        .filter(here(low) | here(high))
        .groupBy(*strata, F.col("q.i").alias("i"))
        .agg(
            F.max(F.when(here(low), F.col(value))).alias("lo"),
            F.max(F.when(here(high), F.col(value))).alias("hi"),
            F.max(spot - low).alias("w"),
        )
    )
    each = picks.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "v")))
    return each.groupBy(*strata).agg(ordered["v"].alias("quantiles"))


def exact_median(df: DataFrame, value: str, strata: Sequence[str] = (), out: str = "median",
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    q = exact_quantiles(df, value, [0.5], strata, bucket_rows)
    return q.select(*strata, F.col("quantiles")[0].alias(out))
