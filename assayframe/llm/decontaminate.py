"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few words in a row that looks at some places and ignores the others. Each place of a document
and of a benchmark text gives one hash per mask; equal hashes are hits. Around a hit both texts are laid side by
side and compared word by word: a stretch of ``WINDOW`` places in which at least ``share`` of the words agree is an overlap, so
exchanged words are tolerated.

The benchmark's seeds are broadcast in blocks of bounded size, each met by all documents; the hashes of a document are neither
shuffled nor stored. Only verified overlaps leave the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayframe.llm.common import durable, whole_row

#: Places looked at. Together the two masks find every 13-word stretch in which two words were exchanged. Shorter texts and
#: smaller shares are met by runs of words instead, as long as the exchanged words must leave one.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 4, 6, 9, 10))
WINDOW = 13
#: Seeds per broadcast block: about 60 bytes each, so some 15 MB.
BLOCK = 250_000


def _words(text: Column) -> Column:
    """Hashes of the words: runs of letters and digits, lower case."""
    plain = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    return F.transform(plain, lambda w: F.xxhash64(w))


def masks_for(size: int, share: float) -> tuple[tuple[int, ...], ...]:
    """Masks of which every stretch of ``size`` words with at least ``share`` agreeing ones holds one: n agreeing words
    between size - n others leave a run of n / (size - n + 1) at least."""
    agree = math.ceil(size * share)
    if size >= WINDOW and size - agree <= 2:
        return MASKS
    return (tuple(range(math.ceil(agree / (size - agree + 1)))),)


def _seeds(rows: DataFrame, words: str, place: str, masks: Sequence[tuple[int, ...]], own: dict[tuple[int, ...], list[int]] | None = None) -> DataFrame:
    """One row per place and mask that fits: adds ``place`` and ``seed``. Works on the array in place, without lambdas.

    ``own`` names the sizes (WINDOW for all from there on) of the texts that a mask is for.
    """
    rows = rows.select("*", F.posexplode(F.col(words)).alias(place, "_word"))
    hashes = []
    for k, m in enumerate(masks):
        fits = F.col(place) + max(m) < F.size(words)
        if own is not None:
            fits &= F.least(F.lit(WINDOW), F.size(words)).isin(own[m])
        hashes.append(F.when(fits, F.xxhash64(F.lit(k), *[F.get(words, F.col(place) + o) for o in m])))
    return rows.select("*", F.explode(F.array(*hashes)).alias("seed")).where("seed IS NOT NULL").drop("_word")


def overlaps(docs: DataFrame, bench: DataFrame, key: Column, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """Verified overlaps: _key, doc_id, item_id, overlap, place.

    One row per document and benchmark text that share a stretch of WINDOW words (the whole text, if it is shorter) in which at least ``share`` of the words
    agree: ``overlap`` is the most agreeing words of such a stretch, ``place`` the first place of the document, counted in words, at which a best one begins.
    Benchmark rows with equal words count once, under their smallest id. Texts without words overlap with nothing.
    Rows repeated whole give one row. Other columns are ignored.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    items = bench.select(F.col(item_col).alias("item_id"), _words(F.col(item_text)).alias("item"))
    items = durable(items.groupBy("item").agg(F.min("item_id").alias("item_id")).where(F.size("item") > 0))
    own: dict[tuple[int, ...], list[int]] = {}
    for r in items.select(F.least(F.lit(WINDOW), F.size("item")).alias("n")).distinct().orderBy(F.desc("n")).collect():
        for m in masks_for(r["n"], share):
            own.setdefault(m, []).append(r["n"])
    masks = list(own) or list(MASKS)
    seeds = durable(_seeds(items.withColumn("_item", F.xxhash64("item")), "item", "q", masks, own or dict.fromkeys(MASKS, [WINDOW])).select("seed", "q", "_item"))
    blocks = max(1, math.ceil(seeds.count() / block))
    texts = docs.select(key.alias("_key"), F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("w")).where(F.size("w") > min(max(m) for m in masks))
    found = None
    for b in range(blocks):
        # Places of one benchmark text stay in one block with it; both sides of the block are bounded by its size.
        mine = F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b
        part = _seeds(texts, "w", "p", masks).join(F.broadcast(seeds.where(mine)), "seed")
        part = part.join(F.broadcast(items.withColumn("_item", F.xxhash64("item")).where(mine)), "_item")
        found = part if found is None else found.unionByName(part)
    size = F.least(F.lit(WINDOW), F.size("item"))
    low = F.greatest(F.lit(0), F.col("q") - F.col("p"), F.col("q") + 1 - size)
    high = F.least(F.col("q"), F.size("item") - size, F.size("w") - size + F.col("q") - F.col("p"))
    found = found.withColumn("size", size).withColumn("low", low).withColumn("high", high).where("low <= high")
    # Running counts of agreement along the diagonal, then differences over the window.
    agree = F.expr("aggregate(sequence(low, high + size - 1), cast(array(0) as array<int>), (a, j) -> concat(a, array(element_at(a, -1) + if(item[j] = w[j + p - q], 1, 0))))")
    found = found.withColumn("a", agree)
    best = F.expr("array_max(transform(sequence(low, high), j -> struct(a[j - low + size] - a[j - low] as n, -(j + p - q) as place)))")
    found = found.select("_key", "doc_id", "item_id", "size", best.alias("b")).where((F.col("b.n") >= F.col("size") * share))
    return found.groupBy("_key", "doc_id", "item_id").agg(F.max("b.n").alias("overlap"), F.max(F.struct("b.n", "b.place")).alias("b")).select(
        "_key", "doc_id", "item_id", "overlap", (-F.col("b.place")).alias("place"))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def drop_overlapping(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with all their columns; a row is known by a hash of id and text."""
    bad = durable(overlaps(docs, bench, _key()).select("_key").distinct())
    rows = whole_row(docs, _key=_key())
    return rows.join(bad, "_key", "left_anti").select("_row.*")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    return overlaps(docs, bench, F.xxhash64("doc_id", "text")).select("doc_id", "item_id", "overlap", "place")


def _seed_sql(rows: str, words: str, place: str, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, {words}, {place}, {k} AS k, [{', '.join(f'{words}[{place} + {o + 1}]' for o in m)}] AS seed "
        f"FROM (SELECT *, unnest(range(len({words}))) AS {place} FROM {rows}) WHERE {place} + {max(m)} < len({words})" for k, m in enumerate(MASKS))


_SPLIT = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, text, {_SPLIT} AS w FROM documents),
i AS (SELECT item, min(item_id) AS item_id FROM (SELECT item_id, {_SPLIT} AS item FROM benchmark) GROUP BY item HAVING len(item) >= {min(max(m) for m in MASKS) + 1}),
hits AS (SELECT DISTINCT doc_id, text, w, item_id, item, q, p - q AS shift, least({WINDOW}, len(item)) AS size
  FROM ({_seed_sql('d', 'w', 'p', 'doc_id, text')}) JOIN ({_seed_sql('i', 'item', 'q', 'item_id')}) USING (k, seed)),
spans AS (SELECT DISTINCT doc_id, text, w, item_id, item, shift, size,
    unnest(range(greatest(0, -shift, q + 1 - size), least(q, len(item) - size, len(w) - size - shift) + 1)) AS j FROM hits),
counted AS (SELECT doc_id, text, item_id, size, j + shift AS place,
    len(list_filter(range(size), lambda x: item[j + x + 1] = w[j + shift + x + 1])) AS n FROM spans)
SELECT doc_id, item_id, max(n)::INTEGER AS overlap, arg_max(place, n * 1000000000 - place)::INTEGER AS place
FROM counted WHERE n >= 0.8 * size GROUP BY doc_id, text, item_id
"""
