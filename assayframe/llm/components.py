"""Connected components of a large link table by rounds of contraction.

In each round every node points to its smallest neighbour (or itself), pointers are followed once more, and the links are
rewritten between the nodes pointed to. At least half of the nodes with a link disappear in a round, so the rounds are few and the
later ones small. Each round's pointers and links are written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayframe.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of comparable ids, in any direction, repeats allowed -> (node, component): the smallest id reachable.

    Nodes without a link to another node do not appear; null ends are ignored.
    """
    links = durable(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    steps = []
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        hop = durable(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("to2")).hint("merge"), "to").select("node", F.col("to2").alias("to")))
        steps.append(hop)
        for end in ("a", "b"):
            links = links.join(hop.select(F.col("node").alias(end), F.col("to").alias("_to")).hint("merge"), end).drop(end).withColumnRenamed("_to", end)
        links = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0]
    for hop in steps[1:]:
        found = found.join(hop.select(F.col("node").alias("to"), F.col("to").alias("_to")).hint("merge"), "to", "left").select("node", F.coalesce("_to", "to").alias("to"))
    return found.withColumnRenamed("to", "component")
