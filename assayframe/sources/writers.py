"""Result sinks: text tables with an NA marker, and figure feeds partitioned by figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_text(df: DataFrame, path: str, na: str = "NA", sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", na).option("sep", sep).csv(path)


def write_mart(df: DataFrame, path: str, partition: str = "figure", mode: str = "replace") -> None:
    """Parquet table with one folder per figure, so that a reader of one figure scans only its part.

    A figure that is written again takes the place of its former rows, and other figures stay, so a rerun leaves the table as it was: the new
    folders are written aside and moved in when the job commits. ``mode="append"`` adds rows instead. Rows are spread by the partition column and a hash of the row, so
    that a large figure is written by many tasks and small ones do not each leave a file per task.
    """
    others = [c for c in df.columns if c != partition]
    spread = F.pmod(F.xxhash64(*others), F.lit(16))
    out = df.repartition(partition, spread).write.partitionBy(partition)
    if mode == "replace":
        out = out.option("partitionOverwriteMode", "dynamic")
        mode = "overwrite"
    out.mode(mode).parquet(path)


def result_summary(df: DataFrame, alpha: float, by: list[str] | None = None) -> DataFrame:
    """Counts of up, down, outlier and low-count features per stratum at level ``alpha``.

    An outlier has no p-value although it was tested; a low count has a p-value but no adjusted one.
    """
    sig = F.col("padj") < F.lit(alpha)
    return df.groupBy(*(by or [])).agg(
        F.count_if(F.col("baseMean") > 0).alias("n_tested"),
        F.count_if(sig & (F.col("log2FoldChange") > 0)).alias("n_up"),
        F.count_if(sig & (F.col("log2FoldChange") < 0)).alias("n_down"),
        F.count_if((F.col("baseMean") > 0) & F.col("pvalue").isNull()).alias("n_outlier"),
        F.count_if(F.col("pvalue").isNotNull() & F.col("padj").isNull()).alias("n_low_count"),
    )


def figure_feed(df: DataFrame, figure: str, panel: str, keep: list[str], mean: str, sd: str | None = None,
                where: Column | None = None) -> DataFrame:
    """Rows behind one plot panel: keys, mean, and error bar ends at one standard deviation."""
    if where is not None:
        df = df.filter(where)
    m = F.col(mean)
    s = F.col(sd) if sd else F.lit(None).cast("double")
    return df.select(
        F.lit(figure).alias("figure"), F.lit(panel).alias("panel"), *keep,
        m.alias("mean"), (m - s).alias("lo"), (m + s).alias("hi"),
    )
