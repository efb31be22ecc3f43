"""What the physical plans must and must not contain."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayframe.operators.distance import bray_curtis
from assayframe.operators.joins import with_total
from assayframe.operators.summarize import mean_sd
from assayframe.plans import tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    text = plan(tables.arm_counts(spark, SF))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    lines = next(s for s in scans if "l_orderkey" in s)
    assert set(re.findall(r"l_\w+?(?=#)", lines)) == {"l_orderkey", "l_partkey", "l_linestatus"}
    assert "p_name" not in text and "o_totalprice" not in text


def test_filters_reach_the_scan(spark):
    text = plan(mean_sd(tables.load(spark, SF, "supplier").filter("s_nationkey < 20"), ["s_nationkey"], ["s_acctbal"]))
    assert "PushedFilters: [IsNotNull(s_nationkey), LessThan(s_nationkey,20)]" in text


def test_summaries_shuffle_once(spark):
    for name in ("mean_sd_all", "loglinear_terms", "melt", "strict_aggregates"):
        text = plan(entry.queries()[name](spark, SF))
        assert text.count("Exchange hashpartitioning") == 1, name
        assert "partial_" in text


def test_no_cross_or_nested_loop_joins(spark):
    for name in ("rule_window", "bray_curtis", "anosim_r", "avg_rank", "share_total", "blank_correct", "size_factors", "wide_compare"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_cells_of_a_feature_are_never_dealt_by_the_feature_alone(spark):
    cells = spark.createDataFrame([(f"s{i}", "everywhere", 1.0) for i in range(40)], "sample string, feature string, v double")
    text = plan(bray_curtis(cells, "sample", "feature", "v", block_samples=4))
    # Only the lists of blocks, distinct before they are dealt, are grouped by feature.
    by_feature = re.findall(r"Exchange hashpartitioning\(feature#\d+, \d+\)", text)
    assert len(by_feature) <= 1 and re.search(r"hashpartitioning\(feature#\d+, block#\d+, \d+\)", text)


def test_small_sides_are_broadcast_by_size(spark):
    assert "BroadcastHashJoin" in plan(entry.queries()["rule_window"](spark, SF))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()["rule_window"](spark, SF))
        assert "SortMergeJoin" in text and "Broadcast" not in text  # no hint stands in the way
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grand_total_is_a_one_row_subquery(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2.0)
    text = plan(with_total(df, {"t": F.sum("v")}))
    assert "Subquery" in text and "Window" not in text


def test_entry_and_registry(spark):
    got = entry.entry(spark)
    assert got.columns == ["event_type", "mu_mean", "mu_sd"] and got.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
