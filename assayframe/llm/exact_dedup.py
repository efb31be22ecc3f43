"""Exact duplicates by a tree merge of sorted digest runs.

Rows are dealt into runs by a hash of their id, and each run is reduced to one entry per digest (its size and its best row), sorted by digest.
Runs are then merged in binomial rounds. In the round of some bits, each run deals its entries among the runs whose numbers differ from its own in
these bits only, by the same bits of the digest's hash; so each run receives one sorted part from every partner, merges them, and keeps the verified best entry
of a digest. After the last round a run's number is that of its digests, and each digest stands in one run. A digest has at most one entry per run and round, so no
task sees more than ``fan_in`` of them at once, however many copies there are. On the way back the winner of a digest meets one entry per run, and a
run's entry meets the rows of that run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.llm.common import durable

SPACES = "[\\x20\\x09-\\x0D]"
#: What must agree for two texts to count as equal: digest, length and a second hash of the normalised text.
KEY = ["_digest", "_length", "_second"]


def _best(inverse: Column, points: Column) -> Column:
    return F.max(F.struct(points.alias("points"), inverse.alias("inverse"))).alias("_best")


def tree_merge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty. The row with the most code points stays,
    ties go to the smallest id. A null id loses every tie; a group of null ids alone keeps none of them by id (keep_id
    null, kept true for the group's rows). Rows repeated whole share id and text: each is returned, each counts in
    group_size, and each carries the same answer. An empty table gives an empty table; other columns are ignored.
    """
    plain = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.char_length(plain).alias("_points"), F.regexp_replace(plain, SPACES, "").alias("_text"))
    rows = durable(rows.select(
        "doc_id", "_points", F.unhex(F.sha2("_text", 256)).alias("_digest"), F.octet_length("_text").alias("_length"),
        F.xxhash64("_text").alias("_second"), F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("_run")))
    # Bitwise not reverses the order of ids, so that one maximum finds the most points and then the smallest id.
    entries = durable(rows.groupBy("_run", *KEY).agg(F.count(F.lit(1)).alias("_n"), _best(F.bitwise_not("doc_id"), F.col("_points"))))
    merged, step = entries, max(1, (fan_in - 1).bit_length())
    for low in range(0, max(1, (runs - 1).bit_length()), step):
        bits = ((1 << step) - 1) << low
        run = F.col("_run").bitwiseAND(F.lit(~bits)).bitwiseOR(F.col("_second").bitwiseAND(F.lit(bits)).cast("int"))
        # Parts of runs come together and are merged in the order of their digests.
        met = merged.withColumn("_run", run).repartition("_run").sortWithinPartitions("_run", *KEY)
        merged = met.groupBy("_run", *KEY).agg(F.sum("_n").alias("_n"), F.max("_best").alias("_best"))
    winners = merged.select(*KEY, F.col("_n").alias("group_size"), F.bitwise_not(F.col("_best.inverse")).alias("keep_id"))
    down = entries.select(*KEY, "_run").join(winners, KEY)
    return rows.join(down, [*KEY, "_run"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def op5_exact_dedup(spark, folder: str) -> DataFrame:
    return tree_merge(spark.read.parquet(f"{folder}/documents.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, digest AS text_sha256
FROM t WINDOW w AS (PARTITION BY digest ORDER BY points DESC, doc_id NULLS LAST)
"""
