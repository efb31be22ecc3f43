"""From raw documents to shards: five stages, each on all that the one before it kept.

Each stage's result is written to the shared folder and read again before the next one starts. In every stage but the last all columns of the documents stay as they
are, whatever their names; an empty table gives an empty table; null ids and null texts are no errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm import decontaminate, jaccard, langid, mixing, sharding
from assayframe.llm.common import durable, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without a letter and undecided ones go. Repeated rows stay or go together."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group joined by a Jaccard similarity of five-word shingles of at least 0.8; of rows with this id, one.

    SimHash fingerprints propose, the shingles decide; links that fingerprints do not show are found by a prefix filter.
    Null and blank texts are one group. Rows without an id stay.
    """
    return jaccard.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark text; null texts have none. Repeated rows stay or go together."""
    return decontaminate.drop_overlapping(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of domains, languages and sources takes them; a null language or source is one of its own."""
    return mixing.apply_mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's size, checksum, shard and slot; repeated rows are rows of their own, a null text has no bytes."""
    return sharding.shard(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints and learned languages have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
