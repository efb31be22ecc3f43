"""Registered queries on scans, sinks and plain selections.

A given table is written as text to the shared folder and read back through the reader under test, so the SQL
on the original table must give the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayframe.functions.columns import nan_to_null
from assayframe.operators.reshape import melt, present, rename_columns, spread
from assayframe.operators.summarize import distinct_count, share_of_total
from assayframe.plans.growth_queries import FIGURE_SQL, figure_panels
from assayframe.plans.tables import ABUND_SQL, abund, fixed, fixed_sql as fx, load, regions
from assayframe.session import durable, shared_folder
from assayframe.sources.readers import read_checked, read_feature_matrix, read_keyed_matrix, read_table
from assayframe.sources.writers import write_mart, write_text

SAMPLES = [f"s{i}" for i in range(25)]
DROPPED = ["s3", "s7", "s24"]
KEPT_REGIONS = ["ASIA", "EUROPE"]


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/assayframe-text-{uuid.uuid4().hex}"


def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice")
    path = _path(spark)
    write_text(load(spark, sf, "orders").select("o_orderkey", "o_custkey", price, "o_orderpriority"), path)
    return read_table(spark, path, {"o_orderkey": "long", "o_custkey": "long", "o_totalprice": "double"})


def scan_tab(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark)
    write_text(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path, sep="\t")
    return read_table(spark, path, {"l_orderkey": "long", "l_linenumber": "int", "l_quantity": "double"}, sep="\t")


def scan_row_key(spark: SparkSession, sf: str) -> DataFrame:
    """A text table whose first header field is empty, as row names are written."""
    path = _path(spark)
    c = load(spark, sf, "customer")
    # Each part file has its own header.
    write_text(c.select(F.col("c_name").alias(""), "c_custkey", "c_mktsegment"), path)
    return read_table(spark, path, {"c_custkey": "long"})


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as text with planted bad lines: how many records of each kind, and the balance of those that are rows."""
    path = _path(spark)
    key = F.col("c_custkey") % 10
    fields = [F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_mktsegment", F.lit(', "')), F.when(key == 3, "n/a?").otherwise(F.col("c_acctbal").cast("string"))]
    line = F.when(key == 5, F.concat_ws(",", *fields[:2])).when(key == 7, F.concat_ws(",", *fields, F.lit("extra"))).otherwise(F.concat_ws(",", *fields))
    load(spark, sf, "customer").select(line.alias("value")).write.text(path)
    schema = T.StructType().add("c_custkey", "long").add("segment", "string").add("acct", "double")
    rows, bad = read_checked(spark, path, schema)
    kept = rename_columns(rows, {"balance": "acct"}).agg(F.lit("row").alias("reason"), F.count(F.lit(1)).alias("n"), fixed(F.sum("balance"), 2).alias("balance"))
    return kept.unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("balance")))


def figure_mart(spark: SparkSession, sf: str) -> DataFrame:
    """The figure feed written twice, as a rerun does, then one of its figures once more, and read back."""
    path = _path(spark)
    feed = durable(figure_panels(spark, sf))
    write_mart(feed, path)
    write_mart(feed, path)
    write_mart(feed.filter("figure = 'fig_late'"), path)
    return spark.read.parquet(path).select(*feed.columns)


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return spread(abund(spark, sf).withColumn("col", F.concat(F.lit("s"), F.col("sample"))), ["feature"], "col", SAMPLES, "n")


def scan_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A marked feature x sample matrix with a taxonomy column, read, melted, and without its zeros."""
    path = _path(spark)
    head = ["# feature by sample counts", "\t".join(["#OTU ID", *SAMPLES, "taxonomy"])]
    rows = _wide(spark, sf).select(F.concat_ws("\t", "feature", *[F.coalesce(s, F.lit(0)).cast("double") for s in SAMPLES], F.lit("k__All; p__Part")).alias("value"))
    spark.range(len(head), numPartitions=1).select(F.get(F.array(*map(F.lit, head)), F.col("id").cast("int")).alias("value")).write.text(path)
    rows.write.mode("append").text(path)
    return present(melt(read_feature_matrix(spark, path), ["feature", "taxonomy"]))


def scan_pathways(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark)
    write_text(_wide(spark, sf).withColumnRenamed("feature", "pathway").fillna(0, SAMPLES), path, sep="\t")
    return read_keyed_matrix(spark, path)


def distinct_customers(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_count(load(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", "n_customers")


def sorted_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Brands by falling total."""
    out = share_of_total(abund(spark, sf), ["brand"], "n").orderBy(F.desc("total"), "brand")
    return out.select("brand", "total", fixed("share_pct").alias("share_pct"))


def keep_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the wide table kept by what the sample metadata say, in the long form."""
    kept = regions(spark, sf).filter(F.col("region").isin(KEPT_REGIONS)).select("n_nationkey").collect()  # one row per column
    columns = [f"s{r[0]}" for r in kept]
    return melt(_wide(spark, sf).select("feature", *columns), ["feature"], columns, value="n")


def keep_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the samples that the metadata keep."""
    kept = regions(spark, sf).filter(F.col("region").isin(KEPT_REGIONS)).select(F.col("n_nationkey").alias("sample"))
    return abund(spark, sf).join(kept, "sample", "left_semi").select("sample", "feature", "n")


def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf).drop(*DROPPED)


def nan_mean(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    orders = load(spark, sf, "orders").select("o_orderpriority", nan_to_null(price).alias("price"))
    out = orders.groupBy("o_orderpriority").agg(F.avg("price").alias("price_mean"), F.count("price").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    return out.withColumn("price_mean", fixed("price_mean", 4))


QUERIES = {
    "scan_csv": scan_csv,
    "scan_tab": scan_tab,
    "scan_row_key": scan_row_key,
    "quarantine": quarantine,
    "figure_mart": figure_mart,
    "scan_matrix": scan_matrix,
    "scan_pathways": scan_pathways,
    "distinct_customers": distinct_customers,
    "sorted_totals": sorted_totals,
    "keep_columns": keep_columns,
    "keep_rows": keep_rows,
    "drop_columns": drop_columns,
    "nan_mean": nan_mean,
}

_kept = ", ".join(f"'{r}'" for r in KEPT_REGIONS)
_META = f"kept AS (SELECT n_nationkey AS sample FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ({_kept}))"


def _wide_sql(columns: list[str], kind: str = "BIGINT", absent: str = "NULL") -> str:
    return ", ".join(f"coalesce(max(CASE WHEN sample = {c[1:]} THEN n END), {absent})::{kind} AS {c}" for c in columns)


ORACLES = {
    "scan_csv": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderpriority FROM orders",
    "scan_tab": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
    "quarantine": f"""
WITH c AS (SELECT c_acctbal AS b, CASE c_custkey % 10 WHEN 3 THEN 'value' WHEN 5 THEN 'short' WHEN 7 THEN 'long' ELSE 'row' END AS reason FROM customer)
SELECT reason, count(*) AS n, CASE WHEN reason = 'row' THEN {fx('sum(b)', 2)} END AS balance FROM c GROUP BY 1""",
    "figure_mart": FIGURE_SQL,
    "scan_row_key": "SELECT c_name AS row_key, c_custkey, c_mktsegment FROM customer",
    "scan_matrix": f"WITH {ABUND_SQL} SELECT feature, 'k__All; p__Part' AS taxonomy, 's' || sample AS sample, sum(n)::DOUBLE AS abundance FROM abund GROUP BY ALL",
    "scan_pathways": f"WITH {ABUND_SQL} SELECT feature, {_wide_sql(SAMPLES, 'DOUBLE', '0')} FROM abund GROUP BY 1",
    "distinct_customers": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1",
    "sorted_totals": f"WITH {ABUND_SQL} SELECT brand, CAST(sum(n) AS BIGINT) AS total, {fx('100.0 * sum(n) / (SELECT sum(n) FROM abund)')} AS share_pct FROM abund GROUP BY 1 ORDER BY total DESC, brand",
    "keep_columns": f"""WITH {ABUND_SQL}, {_META}
SELECT f.feature, 's' || k.sample AS sample, max(a.n) AS n FROM (SELECT DISTINCT feature FROM abund) f CROSS JOIN kept k
LEFT JOIN abund a ON a.feature = f.feature AND a.sample = k.sample GROUP BY 1, 2""",
    "keep_rows": f"WITH {ABUND_SQL}, {_META} SELECT sample, feature, n FROM abund WHERE sample IN (SELECT sample FROM kept)",
    "drop_columns": f"WITH {ABUND_SQL} SELECT feature, {_wide_sql([s for s in SAMPLES if s not in DROPPED])} FROM abund GROUP BY 1",
    "nan_mean": f"""SELECT o_orderpriority, {fx("avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END)", 4)} AS price_mean,
  count(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS n, count(*) AS n_rows FROM orders GROUP BY 1""",
}
