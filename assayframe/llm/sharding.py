"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring of 2^32 places. A row falls at the place its key hashes to, which belongs to the arc
that ends at the next point clockwise. A shard accepts rows only up to its capacity, in the order of arcs and, within an
arc, of row hashes; what overflows goes on clockwise to the next shard that has room. The capacities are the floor or the
ceiling of rows over shards and add up to all rows, so counts are at most one apart, and only the overflow leaves its home.

Which rows of an arc overflow depends on counts alone, so the rounds run on a table with one row per arc (its size is
points x shards, whatever the data); rows then learn their shard and slot from their rank in the arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from assayframe.llm.common import durable

RING = 1 << 32
#: Cells per arc into which rows are dealt by their hash, so that an arc is ranked in parts.
SUBS = 16
#: The ring is also cut at this many even places, so that a row finds its arc by an equality on the cell.
CELLS = 4096


def _place(text) -> F.Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int, points: int) -> DataFrame:
    """One row per arc: arc (its rank on the ring), place, owner, and ``route``: all shards in clockwise order from it."""
    nodes = spark.range(shards * points, numPartitions=1).select((F.col("id") % shards).cast("int").alias("owner"), F.floor(F.col("id") / shards).alias("point"))
    nodes = nodes.withColumn("place", _place(F.concat_ws(":", F.lit("shard"), "owner", "point")))
    ordered, ahead = W.orderBy("place", "owner", "point"), W.orderBy("place", "owner", "point").rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy("place", "owner", "point").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    distance = [
        F.struct(F.coalesce(F.min(F.when(F.col("owner") == s, F.col("place"))).over(ahead), F.min(F.when(F.col("owner") == s, F.col("place"))).over(everything) + RING).alias("at"),
                 F.lit(s).alias("shard")) for s in range(shards)]
    nodes = nodes.select((F.row_number().over(ordered) - 1).cast("int").alias("arc"), "place", "owner", *[d.alias(f"d{s}") for s, d in enumerate(distance)])
    # At equal places the arc's own shard comes first.
    own = [F.struct(F.col(f"d{s}.at").alias("at"), (F.col("owner") != s).alias("other"), F.lit(s).alias("shard")) for s in range(shards)]
    return nodes.select("arc", "place", "owner", F.transform(F.array_sort(F.array(*own)), lambda x: x["shard"]).alias("route"))


def _segments(arcs: DataFrame) -> DataFrame:
    """The ring cut at arcs and at even cells: cell, low (exclusive), high (inclusive), arc. CELLS + arcs rows."""
    size = RING // CELLS
    w = W.orderBy("place", "arc")
    spans = arcs.select("arc", "place", F.lag("place", 1, -1).over(w).alias("before"))
    first = arcs.agg(F.min(F.struct("place", "arc")).alias("f"), F.max("place").alias("last"))
    tail = first.select(F.col("f.arc").alias("arc"), F.lit(RING - 1).cast("bigint").alias("place"), F.col("last").alias("before"))
    spans = spans.unionByName(tail).where("place > before")
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor((F.col("before") + 1) / size), F.floor(F.col("place") / size))))
    return cells.select("cell", "arc", F.col("before").alias("low"), F.col("place").alias("high"))


def _fill(sized: DataFrame, shards: int) -> DataFrame:
    """Run the rounds on (arc, route, n): adds ``parts``, an array of (shard, from, n) in the order of the route."""
    every = W.partitionBy()
    total = F.sum("n").over(every)
    state = sized.select("arc", "route", "n", F.col("n").alias("left"), F.array(*[F.floor((total + (shards - 1 - s)) / shards) for s in range(shards)]).alias("room"))
    for t in range(shards):
        state = state.withColumn("to", F.col("route")[t])
        before = F.coalesce(F.sum("left").over(W.partitionBy("to").orderBy("arc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        state = state.withColumn(f"take{t}", F.greatest(F.lit(0), F.least("left", F.get("room", F.col("to")) - before)).cast("bigint"))
        state = state.withColumn("left", F.col("left") - F.col(f"take{t}"))
        used = F.array(*[F.sum(F.when(F.col("to") == s, F.col(f"take{t}")).otherwise(0)).over(every) for s in range(shards)])
        state = state.withColumn("room", F.zip_with("room", used, lambda a, b: a - b))
    start, parts = F.lit(0).cast("bigint"), []
    for t in range(shards):
        parts.append(F.struct(F.col("route")[t].alias("shard"), start.alias("from"), F.col(f"take{t}").alias("n")))
        start = start + F.col(f"take{t}")
    return state.select("arc", F.filter(F.array(*parts), lambda p: p["n"] > 0).alias("parts"))


def shard(docs: DataFrame, shards: int = 8, points: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key is the id with the checksum of the text. Null text has size 1 and checksum 0, like empty text; a null id
    hashes like empty text. Rows with the same key lie in one arc, side by side, each with a slot of its own; which of
    two identical rows gets which slot has no meaning. Counts differ by one at most: the first ``rows mod shards`` shards hold one more.
    An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("hash", F.md5(F.concat_ws(":", "doc_id", "text_crc32")))
    rows = rows.withColumn("at", F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint"))
    rows = rows.withColumn("cell", F.floor(F.col("at") / (RING // CELLS))).withColumn("sub", F.conv(F.substring("hash", 9, 1), 16, 10).cast("int"))
    arcs = durable(ring(spark, shards, points))
    # The segments are CELLS + points x shards rows, whatever the data: safe to broadcast.
    seg = F.broadcast(_segments(arcs))
    placed = durable(rows.join(seg, (rows["cell"] == seg["cell"]) & (rows["at"] > seg["low"]) & (rows["at"] <= seg["high"]))
                     .select("doc_id", "size", "text_crc32", "hash", "arc", "sub"))
    cells = durable(placed.groupBy("arc", "sub").agg(F.count(F.lit(1)).alias("n")))
    parts = _fill(arcs.join(cells.groupBy("arc").agg(F.sum("n").alias("n")), "arc").select("arc", "route", "n"), shards)
    flat = parts.select("arc", F.posexplode("parts").alias("step", "p")).select("arc", "step", "p.*")
    flat = flat.withColumn("offset", F.sum("n").over(W.partitionBy("shard").orderBy("arc", "step").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    parts = flat.groupBy("arc").agg(F.collect_list(F.struct("from", "n", "shard", "offset")).alias("parts"))  # at most one per shard
    base = F.sum("n").over(W.partitionBy("arc").orderBy("sub").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    cells = durable(cells.select("arc", "sub", base.alias("base")).join(parts, "arc"))
    rank = F.row_number().over(W.partitionBy("arc", "sub").orderBy("hash", "doc_id", "text_crc32", "size")) - 1
    ranked = placed.withColumn("rank", rank).join(cells, ["arc", "sub"]).withColumn("rank", F.col("rank") + F.col("base"))
    mine = F.filter("parts", lambda p: (F.col("rank") >= p["from"]) & (F.col("rank") < p["from"] + p["n"]))[0]
    return ranked.withColumn("part", mine).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.shard").cast("int").alias("shard"),
        (F.col("part.offset") + F.col("rank") - F.col("part.from")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(spark.read.parquet(f"{folder}/documents.parquet"))
