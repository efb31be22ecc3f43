"""Delimited scans. Types are never inferred: every scan takes or builds a schema."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayframe.session import durable


def _header(spark: SparkSession, path: str, starts: str | None = None) -> str:
    lines = spark.read.text(path)
    if starts:
        lines = lines.filter(F.col("value").startswith(starts))
    first = lines.head()
    if first is None:
        raise ValueError(f"no header line in {path}")
    return first[0]


def _names(line: str, sep: str) -> list[str]:
    return [n.strip().strip('"') for n in line.rstrip("\r\n").split(sep)]


def read_table(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | T.StructType,
    sep: str = ",",
    na: str = "NA",
    row_key: str = "row_key",
) -> DataFrame:
    """Headered text table. ``types`` maps column name to type (``string`` where it says nothing).

    Blanks around header names are trimmed; an unnamed first column (row names) becomes ``row_key``.
    """
    if isinstance(types, T.StructType):
        schema = types
    else:
        names = [n or row_key for n in _names(_header(spark, path), sep)]
        schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("nullValue", na)
        .csv(path)
    )


def read_checked(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | T.StructType,
    sep: str = ",",
    na: str = "NA",
    row_key: str = "row_key",
) -> tuple[DataFrame, DataFrame]:
    """``read_table`` with the records that do not fit kept apart: ``(rows, quarantined)``.

    A record with too few or too many fields, or with a field that is not of its type, is not a row; it goes to ``(file, reason, record)`` with the reason
    ``short``, ``long`` or ``value``. Together they hold every record once. The scan is written out once, as both results come from it.
    """
    if not isinstance(types, T.StructType):
        names = [n or row_key for n in _names(_header(spark, path), sep)]
        types = T._parse_datatype_string(", ".join(f"`{n}` {types.get(n, 'string')}" for n in names))
        header = True
    else:
        header = False
    mark, file = "__record", "__file"
    raw = (
        spark.read.schema(T.StructType([*types.fields, T.StructField(mark, T.StringType())]))
        .option("header", header).option("enforceSchema", True).option("sep", sep).option("nullValue", na)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", mark).csv(path)
    )
    read = durable(raw.withColumn(file, F.col("_metadata.file_path")))
    # Separators inside quotes do not part fields.
    fields = F.size(F.split(F.regexp_replace(mark, '"[^"]*"', ""), re.escape(sep), -1))
    reason = F.when(fields < len(types), "short").when(fields > len(types), "long").otherwise("value")
    bad = read.filter(F.col(mark).isNotNull()).select(F.col(file).alias("file"), reason.alias("reason"), F.col(mark).alias("record"))
    return read.filter(F.col(mark).isNull()).drop(mark, file), bad


def read_feature_matrix(
    spark: SparkSession,
    path: str,
    feature: str = "feature",
    text_columns: Sequence[str] = ("taxonomy",),
    header_mark: str = "#OTU ID",
) -> DataFrame:
    """Tab-separated feature x sample matrix with comment lines and a ``#``-marked header.

    The header line gives the sample names; both ``#`` lines are then skipped by the scan.
    """
    names = _names(_header(spark, path, header_mark), "\t")
    schema = T.StructType().add(feature, "string")
    for n in names[1:]:
        schema = schema.add(n, "string" if n in text_columns else "double")
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def read_keyed_matrix(spark: SparkSession, path: str, feature: str = "feature", sep: str = "\t") -> DataFrame:
    """Headered matrix whose first column is the row key and whose other columns are numbers."""
    names = _names(_header(spark, path), sep)
    schema = T.StructType().add(feature, "string")
    for n in names[1:]:
        schema = schema.add(n, "double")
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts; empty for a proper row key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
