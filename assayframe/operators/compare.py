"""Comparing significant features across strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.operators.joins import full_outer


def significant(df: DataFrame, alpha: float, padj: str = "padj") -> DataFrame:
    return df.filter(F.col(padj) < F.lit(alpha))


def annotate(df: DataFrame, descriptions: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of a result with the description of its key."""
    return df.select(key, *columns).join(descriptions, key, "inner")


def wide_compare(df: DataFrame, keys: Sequence[str], stratum: str, levels: Sequence, measures: Sequence[str]) -> DataFrame:
    """One row per key with ``<measure>_<level>`` columns: the k-way full outer join of the strata.

    All strata stay in one table and one shuffle does the work of k - 1 outer joins; NULL keys meet each
    other because grouping treats them as equal. Keys must be unique within a stratum.
    """
    picks = [
        F.max(F.when(F.col(stratum) == F.lit(v), F.col(m))).alias(f"{m}_{v}") for v in levels for m in measures
    ]
    return df.groupBy(*keys).agg(*picks)


def chained_outer(tables: Sequence[tuple[str, DataFrame]], keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Same result from separate tables, by outer joins in sequence. For inputs that do not share a layout."""
    out = None
    for name, t in tables:
        t = t.select(*keys, *[F.col(m).alias(f"{m}_{name}") for m in measures])
        out = t if out is None else full_outer(out, t, keys)
    return out


def unique_to_one(df: DataFrame, keys: Sequence[str], stratum: str) -> DataFrame:
    """Keys present in exactly one stratum, with that stratum."""
    return (
        df.groupBy(*keys)
        .agg(F.min(stratum).alias("__lo"), F.max(stratum).alias("__hi"))
        .filter("__lo = __hi")
        .select(*keys, F.col("__lo").alias(stratum))
    )


def membership_counts(df: DataFrame, keys: Sequence[str], stratum: str, levels: Sequence) -> DataFrame:
    """Number of keys per combination of strata they occur in (regions of a Venn diagram)."""
    flags: list[Column] = [
        F.max(F.when(F.col(stratum) == F.lit(v), F.lit(True)).otherwise(F.lit(False))).alias(f"in_{v}") for v in levels
    ]
    return (
        df.groupBy(*keys).agg(*flags)
        .groupBy(*[f"in_{v}" for v in levels])
        .agg(F.count(F.lit(1)).alias("n_keys"))
    )
