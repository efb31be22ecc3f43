"""Rule-window selection: keep the rows whose position falls in a range set for their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from assayframe.session import durable

#: Cells over the span of ranges that name no key; disjoint ranges fill at most this many plus one each.
SPAN_CELLS = 1_000


def _islands(rules: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Union of the ranges of each key as ranges that do not overlap."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("__reach").isNull() | (F.col(low) > F.col("__reach"))
    return (
        rules.withColumn("__reach", F.max(high).over(before))
        .withColumn("__isle", F.sum(F.when(fresh, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__isle")
        .agg(F.min(low).alias("__lo"), F.max(high).alias("__hi"))
        .drop("__isle")
    )


def rule_window(
    df: DataFrame,
    rules: DataFrame,
    keys: Sequence[str],
    position: str,
    low: str = "day_lo",
    high: str = "day_hi",
) -> DataFrame:
    """Rows of ``df`` that at least one rule admits, each once.

    A rule gives a range of ``position`` for some of the keys; a NULL key means any. Rules are split by
    which keys they name, so each part is an equality join (never a nested loop over rules). Ranges of
    one key pattern are merged first: a row then meets at most one, and cannot be duplicated by overlapping rules.
    """
    kept = rules.filter(F.col(low) <= F.col(high)).select(*keys, low, high)
    isles = durable(_islands(kept, keys, low, high))  # small, read once per pattern
    named = [F.col(k).isNotNull().alias(k) for k in keys]
    # One row per pattern of named keys (at most 2^keys), with the span of its ranges.
    patterns = isles.groupBy(*named).agg(
        F.min("__lo").cast("double").alias("__from"), F.max("__hi").cast("double").alias("__to")).collect()
    if not patterns:
        return df.limit(0)
    out, hit = df, F.lit(False)
    for i, pattern in enumerate(sorted(patterns, reverse=True)):
        tag = f"__r{i}_"
        part, on = isles, None
        for k in keys:
            part = part.filter(F.col(k).isNotNull() if pattern[k] else F.col(k).isNull())
            if pattern[k]:
                same = F.col(k) == F.col(f"{tag}{k}")
                on = same if on is None else on & same
        if on is None:
            # No key to join on: cut the span into cells and join on the cell of the position.
            start, width = pattern["__from"], max((pattern["__to"] - pattern["__from"]) / SPAN_CELLS, 1e-9)
            cell = lambda c: F.floor((c.cast("double") - F.lit(start)) / F.lit(width))  # noqa: B023, E731
            part = part.withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")))))
            on = cell(F.col(position)) == F.col(f"{tag}__cell")
        part = part.withColumnsRenamed({c: f"{tag}{c}" for c in part.columns})
        on = on & F.col(position).between(F.col(f"{tag}__lo"), F.col(f"{tag}__hi"))
        out = out.join(part, on, "left")
        hit = hit | F.col(f"{tag}__lo").isNotNull()
    return out.filter(hit).select(*df.columns)
