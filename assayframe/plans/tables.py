"""Inputs of the registered queries: the given tables and the abundance tables Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fixed(column: str | Column, digits: int = 6) -> Column:
    """Rounded result column. The nudge keeps exact halves from falling either way in different engines."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double") + F.lit(1e-9), digits)


def fixed_all(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: fixed(c, digits) for c in columns})


def fixed_sql(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, {digits})"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the customer's nation and the part's feature names; only needed columns are read."""
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus")
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = load(spark, folder, "customer").select("c_custkey", "c_nationkey")
    parts = load(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("feature", F.concat_ws("|", "p_brand", "p_type"))
    )


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """Nation key with its region's name."""
    nation = load(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = load(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))


def abund(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per (nation, brand and type)."""
    return (
        _lines(spark, folder)
        .groupBy(F.col("c_nationkey").alias("sample"), "feature", F.col("p_type").alias("family"), F.col("p_brand").alias("brand"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def abund_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per (supplier, brand and type): many samples."""
    lines = load(spark, folder, "lineitem").select("l_partkey", "l_suppkey")
    parts = load(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("sample"), F.concat_ws("|", "p_brand", "p_type").alias("feature"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def arm_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per (region, nation and line status, feature): two arms of five nations in each region."""
    return (
        _lines(spark, folder)
        .join(regions(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("region", F.concat_ws("|", "c_nationkey", "l_linestatus").alias("sample"), F.col("l_linestatus").alias("arm"), "feature")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per (region, order and line status, feature): six samples in two arms of three in each region."""
    return (
        _lines(spark, folder)
        .join(regions(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("region", F.concat_ws("|", "o_orderstatus", "l_linestatus").alias("sample"), F.col("l_linestatus").alias("arm"), "feature")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def supplier_arms(spark: SparkSession, folder: str, outlier: int = 60) -> tuple[DataFrame, DataFrame]:
    """Lines per (supplier, brand) and the suppliers in two arms of many; one count in every fifth brand is ``outlier`` times as large."""
    lines = load(spark, folder, "lineitem").select("l_partkey", "l_suppkey")
    parts = load(spark, folder, "part").select("p_partkey", "p_brand")
    cells = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("sample"), F.col("p_brand").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    brand = F.regexp_extract("feature", "[0-9]+", 0).cast("int")
    odd = (brand % 5 == 0) & (F.col("sample") == brand % 7 + 1)
    suppliers = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("sample"))
    samples = suppliers.select(F.lit("all").alias("study"), "sample", F.when(F.col("sample") % 2 == 0, "even").otherwise("odd").alias("arm"))
    return cells.withColumn("n", F.when(odd, F.col("n") * outlier).otherwise(F.col("n"))), samples


LINES_SQL = """
lines AS (
  SELECT c.c_nationkey AS nation, l.l_suppkey AS supp, l.l_linestatus AS ls, o.o_orderstatus AS os,
         p.p_brand || '|' || p.p_type AS feature, p.p_type AS family, p.p_brand AS brand, r.r_name AS region
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
ABUND_SQL = LINES_SQL + """,
abund AS (SELECT nation AS sample, feature, family, brand, count(*) AS n FROM lines GROUP BY ALL)"""
ARMS_SQL = LINES_SQL + """,
arms AS (SELECT region, nation || '|' || ls AS sample, ls AS arm, feature, count(*) AS n FROM lines GROUP BY ALL)"""
SPLIT_SQL = LINES_SQL + """,
split AS (SELECT region, os || '|' || ls AS sample, ls AS arm, feature, count(*) AS n FROM lines GROUP BY ALL)"""
