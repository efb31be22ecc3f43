"""Equi-joins that keep NULL keys and do not pile a hot key onto one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.functions.columns import salt


def _bare(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"__{tag}_{k}" for k in keys})


def _on(keys: Sequence[str], tag: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{tag}_{k}")) for k in keys] or [F.lit(True)])


def add_covariates(facts: DataFrame, covariates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of a fact table to a covariate or dimension table on plain key equality.

    No hint is given: Spark broadcasts the covariates if their measured size is under its limit and
    otherwise sorts and merges, splitting hot partitions at run time.
    """
    return facts.join(covariates, list(keys), "inner")


def attach_group_values(
    rows: DataFrame,
    per_group: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str],
    parts: int = 16,
) -> DataFrame:
    """Left join of one-row-per-group values back to the rows of the groups.

    A group may hold a third of all rows, so each group row is repeated ``parts`` times and the rows
    are spread over the copies by a hash of ``salt_on``. NULL keys match each other.
    """
    copies = _bare(per_group, keys, "g").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    spread = rows.withColumn("__salt", salt(salt_on, parts))
    joined = spread.join(copies, _on(keys, "g") & (F.col("__salt") == F.col("__part")), "left")
    return joined.drop("__salt", "__part", *[f"__g_{k}" for k in keys])


def full_outer(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = True,
) -> DataFrame:
    """Full outer join with coalesced keys; clashing measure names get the suffixes.

    ``null_safe`` matches NULL keys to each other; without it they stay unmatched, as in plain SQL.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    lhs = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    rhs = _bare(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), keys, "r")
    if null_safe:
        on = _on(keys, "r")
    else:
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__r_{k}") for k in keys])
    joined = lhs.join(rhs, on, "full")
    merged = [F.coalesce(F.col(k), F.col(f"__r_{k}")).alias(k) for k in keys]
    rest = [c for c in lhs.columns if c not in keys] + [
        c for c in rhs.columns if not c.startswith("__r_")
    ]
    return joined.select(*merged, *rest)


def with_total(df: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Add whole-table aggregates to every row through one-row scalar subqueries."""
    aggregates = df.agg(F.struct(*[c.alias(n) for n, c in totals.items()]).alias("t"))
    picked = df.withColumn("__t", aggregates.scalar())
    return picked.withColumns({n: F.col("__t")[n] for n in totals}).drop("__t")
