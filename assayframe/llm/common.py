"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayframe.session import durable

__all__ = ["durable", "read", "remainder", "whole_row", "sampled", "chosen"]

#: Parts of the hash range that a share is compared with.
FINE = 1 << 62


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def whole_row(df: DataFrame, **extra: Column) -> DataFrame:
    """Pack all columns of ``df`` into one struct ``_row`` beside ``extra``, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in extra.items()])


def chosen(share: float, *key: Column) -> Column:
    """Whether a row is among ``share`` of all, by a hash of its key."""
    return F.pmod(F.xxhash64(*key), F.lit(FINE)) < int(share * FINE)


def sampled(rows: DataFrame, classes: Column, key: Sequence[Column], bound: int, most: int = 256) -> DataFrame:
    """About ``bound`` rows of each class (all of a smaller class), chosen by a hash of the key, with their ``_class`` and its
    ``_weight``: how many rows of the class each stands for. Rows of one class and key count once in the sample.

    Key and class should tell rows apart (an id and a text). Where the hash takes no row of a class, as when its rows have few different keys, the first
    in hash order are taken. Class sizes are counted over all rows; of more than ``most`` classes the largest are kept. Rows without a class go.
    """
    spark = rows.sparkSession
    known = rows.withColumns({"_class": classes, "_key": F.xxhash64(*key)}).where("_class IS NOT NULL")
    sizes = {r["_class"]: r["count"] for r in known.groupBy("_class").count().orderBy(F.desc("count"), "_class").limit(most).collect()}
    if not sizes:
        return known.drop("_key").withColumn("_weight", F.lit(1.0))
    kind = known.schema["_class"].dataType
    shares = spark.createDataFrame([(c, int(min(1.0, bound / n) * FINE)) for c, n in sizes.items()], T.StructType().add("_class", kind).add("_share", "long"))
    by_hash = F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(FINE))
    taken = known.join(F.broadcast(shares), "_class").where(by_hash < F.col("_share")).drop("_share").dropDuplicates(["_class", "_key"])
    found = {r["_class"]: r["count"] for r in taken.groupBy("_class").count().collect()}
    for value in sorted((c for c in sizes if c not in found), key=str):
        first = known.where(F.col("_class") == F.lit(value)).dropDuplicates(["_key"]).orderBy(by_hash, "_key").limit(bound)
        found[value] = first.count()
        taken = taken.unionByName(first)
    weights = spark.createDataFrame([(c, n / found[c]) for c, n in sizes.items()], T.StructType().add("_class", kind).add("_weight", "double"))
    return taken.join(F.broadcast(weights), "_class").drop("_key")
