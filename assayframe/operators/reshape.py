"""Wide to long and back, strata, renormalising, and the all-zero filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.operators.joins import attach_group_values


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None,
         key: str = "sample", value: str = "abundance") -> DataFrame:
    """Wide to long. Long tables keep every cell here, zeros included."""
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, key, value)


def spread(df: DataFrame, ids: Sequence[str], key: str, levels: Sequence[str], value: str) -> DataFrame:
    """Long to wide for a known list of levels: one aggregation, one column per level."""
    picks = [F.max(F.when(F.col(key) == F.lit(v), F.col(value))).alias(str(v)) for v in levels]
    return df.groupBy(*ids).agg(*picks)


def present(df: DataFrame, abundance: str = "abundance") -> DataFrame:
    """Sparse form: absent features are not stored."""
    return df.filter(F.col(abundance) != 0)


def drop_all_zero(df: DataFrame, feature: str, abundance: str, strata: Sequence[str] = ()) -> DataFrame:
    """Remove features whose total over the samples of a stratum is zero."""
    keys = [*strata, feature]
    kept = df.groupBy(*keys).agg(F.sum(abundance).alias("__t")).filter("__t != 0").select(*keys)
    k = kept.withColumnsRenamed({c: f"__k_{c}" for c in keys})
    on = None
    for c in keys:
        part = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        on = part if on is None else on & part
    return df.join(k, on, "left_semi")


def share_in_group(df: DataFrame, groups: Sequence[str], value: str, salt_on: Sequence[str],
                   out: str = "share") -> DataFrame:
    """Value over the group's total. The total is pre-aggregated; hot groups are spread by ``salt_on``."""
    totals = df.groupBy(*groups).agg(F.sum(value).alias("__total"))
    joined = attach_group_values(df, totals, groups, salt_on)
    return joined.withColumn(out, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def renormalise(df: DataFrame, keep: Column, groups: Sequence[str], value: str,
                salt_on: Sequence[str]) -> DataFrame:
    """Keep a subset of features and rescale each sample to total one."""
    return share_in_group(df.filter(keep), groups, value, salt_on, out=value)


def level_rank(df: DataFrame, column: str, levels: Sequence[str], out: str = "level_rank") -> DataFrame:
    """Position of a value in a fixed level order; NULL for a value outside it."""
    spot = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return df.withColumn(out, F.when(spot > 0, spot).cast("int"))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``names`` maps new to old."""
    return df.withColumnsRenamed({old: new for new, old in names.items()})
