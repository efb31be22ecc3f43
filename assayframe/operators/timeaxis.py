"""Clock texts to timestamps, interval midpoints, and elapsed days from an origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.operators.joins import attach_group_values

US_PER_DAY = 86_400_000_000


def clock(date: str, time: str, pattern: str = "M/d/yy H:mm") -> Column:
    """Timestamp of a date text and a clock text, read as UTC; NULL where they do not parse.

    Fixing the zone keeps elapsed times free of daylight saving, whatever the session's zone.
    """
    text = F.concat(F.col(date), F.lit(" "), F.col(time), F.lit(" +0000"))
    return F.try_to_timestamp(text, F.lit(f"{pattern} xx"))


def midpoint(start: Column, end: Column) -> Column:
    """Middle of an interval in microseconds since the epoch."""
    return (F.unix_micros(start) + F.unix_micros(end)) / F.lit(2)


def elapsed_days(df: DataFrame, micros: str, origin: Column, per: Sequence[str] = (),
                 out: str = "days_elapsed") -> DataFrame:
    """Days since the row(s) where ``origin`` holds.

    By default the table has one global origin, taken through a scalar subquery. With ``per``, each
    group has its own.
    """
    start = F.min(F.when(origin, F.col(micros)))
    if not per:
        first = df.agg(start).scalar()
        return df.withColumn(out, (F.col(micros) - first) / F.lit(US_PER_DAY))
    starts = df.groupBy(*per).agg(start.alias("__start"))
    joined = attach_group_values(df, starts, per, salt_on=[micros])
    return joined.withColumn(out, (F.col(micros) - F.col("__start")) / F.lit(US_PER_DAY)).drop("__start")
