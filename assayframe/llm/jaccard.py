"""Near-duplicates by SimHash, verified by the Jaccard similarity of word shingles, without a lost pair.

Candidates come from the fingerprints first: sets whose texts have fingerprints within ``RADIUS`` bits are found by the generalised pigeonhole search of ``simhash``, and
verified. At a similarity of 4/5 two fingerprints may differ in ten bits and more, which no search over 64 bits covers. The links that they do not show are
found by a prefix filter, among the sets that are not joined yet.

Two sets whose Jaccard similarity is at least 4/5 share at least 4/5 of either; so, with all shingles in one fixed order, they share
one among the first n - ceil(4 n / 5) + 1 of each set of n (prefix filter). Only these are stored and met. Any fixed order is right;
common shingles come last, the commonest at the end, so that buckets of unrelated documents are rare: those of a bounded sample, and those that
turn up more than ``crowd`` times among the first shingles of all documents, counted over twice as many as a prefix has, so that a set can go past its common ones.

Most of these shingles stand in one document only. They are found first, on shortened hashes (which can only let too many through), and never take part in a join.
What is left is a bucket per shingle. In every bucket all sets are compared with one of them; sets that are joined by then need no further comparison
within a bucket, and all other pairs of a bucket are compared, in crowded buckets after a few more rounds with one set each. These are drawn anew in every bucket and round: sets that
share many buckets meet many others, and few are left that are not joined.

Buckets that are far larger even then (many versions of one text) are met by what their sets do not have in common. The middle of a cluster of such buckets holds the shingles of over half of its
sets, and D is what a set of n shingles and the middle differ in. Two sets are alike exactly when 9 |Da ^ Db| <= na + nb, that is when 18 |Da & Db| >= wa + wb with w = 9 |D| - n. So all pairs with
wa + wb <= 0 are alike, and joined by links to the set of the smallest w. The others share one of the first |D| - o + 1 differences each, rarest first, where o is the least number that they must share;
a set's o is known from its own w and the smallest w of the sets that are not joined to it.

A comparison is first made on sketches: a set's shingles are dealt to about as many bits, each the parity of its shingles' number. Two sketches cannot differ in more bits than
their sets differ in shingles, so a pair whose sketches differ too much is none; the longer of two sketches is folded to the length of the other, half upon half. All other pairs
are verified on the whole sets, which are made anew from the texts of these documents alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe.llm.common import durable, whole_row
from assayframe.llm.components import components
from assayframe.llm.simhash import CROWD, LOWER, fingerprint, near_links
from assayframe.operators.joins import attach_group_values

WIDTH = 5
#: Bits in which fingerprints of candidates may differ.
RADIUS = 2
#: Documents in which common shingles are counted, how many must hold one, and how many are put last.
SAMPLE, COMMON, LAST = 10_000, 3, 200_000
#: How many times a prefix's shingles of every document are counted, how often a task counts one at most in a chunk, and how many are ranked (5 bytes each in every task).
AHEAD, OFTEN, RANKED = 2, 64, 4_000_000
#: Documents up to which common shingles are of one rank.
VERY = 1024
#: Fewest bits of a sketch.
SKETCH = 1024
#: Shingles that one task looks for repeats among, and how many are dealt out at once.
BUCKET, CHUNK = 1 << 18, 1 << 20
#: Shortened hashes of repeated shingles (or keys of documents to verify) that are held by every task, at most 64 MB; more of them are joined.
HELD = 8_000_000
#: From so many shingles on they are not shortened.
WIDE = 1 << 28
#: Rounds of crowded buckets: with one of their sets each, and in the last round all that are not joined yet.
ROUNDS = 2
#: From so many times a crowded bucket's size on, buckets are met by their middle; the pairs of smaller ones are at most half as many to each of their sets.
LARGE = 4
#: Shingles of crowded buckets that a set carries, so that a pair that shares many of them is compared once.
LISTED = 64


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct word shingles (all words, if there are fewer than ``width``); none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(view[s:e]) for s, e in zip(starts.tolist(), last.tolist())), dtype=np.uint64, count=len(last)).view(np.int64))


def cut(hashes: np.ndarray) -> np.ndarray:
    """Shortened hashes."""
    return (hashes.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def prefix(hashes: np.ndarray, order: tuple[np.ndarray, np.ndarray], times: int = 1) -> np.ndarray:
    """The first shingles in the fixed order, ``times`` as many as the filter needs.

    ``order``: shortened hashes (sorted) and their ranks. Shingles of no rank come first, then those of the lowest; those of one rank by hash.
    """
    n, (cuts, ranks) = len(hashes), order
    if len(cuts) and n:
        own = cut(hashes)
        at = np.minimum(np.searchsorted(cuts, own), len(cuts) - 1)
        hashes = hashes[np.argsort(np.where(cuts[at] == own, ranks[at], 0), kind="stable")]
    return hashes[:times * (n - (4 * n + 4) // 5 + 1)] if n else hashes


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of the number of shingles dealt to each of at least as many bits (a power of two)."""
    size = max(SKETCH, 1 << (max(1, len(hashes)) - 1).bit_length())
    odd = np.bincount((hashes >> 7) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, at the length of the shorter one: never more than their sets differ in shingles."""
    x, y = (np.frombuffer(v, dtype=np.uint64) for v in (a, b))
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches do not rule out a similarity of 4/5, which is a difference of at most a ninth of both sizes together."""
    for b in batches:
        both = (b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + b.column(4).to_numpy(zero_copy_only=False)).tolist()
        keep = [apart(x.as_py(), y.as_py()) * 9 <= n for x, y, n in zip(b.column(3), b.column(5), both)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _ranks(cuts: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shortened hashes and a rank for each: 1 up to ``VERY`` documents, then one more for each time twice as many."""
    by_cut = np.lexsort((-often, cuts))
    cuts, first = np.unique(cuts[by_cut], return_index=True)
    return cuts, 1 + np.ceil(np.log2(np.maximum(often[by_cut][first] / VERY, 1))).astype(np.uint8)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several documents of a bounded sample, shortened, and in how many of all documents by this sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()))], names=["shingle"])

    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 40)))
    top = some.select("text").mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(LAST)
    top = top.toArrow()
    return cut(top["shingle"].to_numpy().astype(np.int64)), top["count"].to_numpy() * max(1.0, n / SAMPLE)


def _parts(values: np.ndarray, shift: int) -> pa.RecordBatch:
    """Sorted numbers dealt to buckets by their top bits: (bucket, values)."""
    bits = values.dtype.itemsize * 8
    bucket = (values >> values.dtype.type(shift)).astype(np.int64) if shift < bits else np.zeros(len(values), dtype=np.int64)
    names, starts = np.unique(bucket, return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([p.tobytes() for p in np.split(values, starts[1:])], pa.binary())], names=["bucket", "values"])


def _buckets(entries: int) -> int:
    return 1 << min(20, max(0, (entries // BUCKET).bit_length()))


def _order(docs: DataFrame, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``prefix``: common shingles of a sample, and of the first shingles of all documents those met more than ``crowd`` times, by how often they are met.

    It says only which shingles come first; any order finds every pair.
    """
    common, n_common = _common(docs)
    begin = docs.sparkSession.sparkContext.broadcast(_ranks(common, n_common))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shift = 32 - _buckets(size * AHEAD // 25).bit_length() + 1  # a word and its space have five bytes or more, and a prefix a fifth of the shingles

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows_of() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return _parts(np.repeat(values, np.minimum(n, OFTEN)), shift)

        size = 0
        for b in batches:
            for t in b.column(0):
                held.append(cut(prefix(shingles(t.as_py()), begin.value, AHEAD)))
                size += len(held[-1])
                if size >= CHUNK:
                    yield rows_of()
                    held, size = [], 0
        if size:
            yield rows_of()

    def often(key: tuple, table: pa.Table) -> pa.Table:
        values, n = np.unique(np.concatenate([np.frombuffer(v.as_py(), dtype=np.uint32) for v in table["values"]]), return_counts=True)
        return pa.table({"cut": values[n > crowd].astype(np.int64), "n": n[n > crowd].astype(np.int64)})

    found = docs.select("text").mapInArrow(deal, "bucket long, values binary").groupBy("bucket").applyInArrow(often, "cut long, n long")
    top = durable(found).orderBy(F.desc("n"), "cut").limit(RANKED).toArrow()
    return _ranks(np.concatenate([common, top["cut"].to_numpy().astype(np.uint32)]), np.concatenate([n_common, top["n"].to_numpy()]))


def _repeated(rows: DataFrame, entries: int, wide: bool) -> DataFrame:
    """(cut): shortened hashes that stand in the prefixes of two rows or more; copies of a row count too."""
    shift = (64 if wide else 32) - _buckets(entries).bit_length() + 1
    kind = np.uint64 if wide else np.uint32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows_of() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return _parts(np.repeat(values, np.minimum(n, 2)), shift)  # what repeats here is handed on twice

        size = 0
        for b in batches:
            values = b.column(0).flatten().to_numpy(zero_copy_only=False)
            held.append(values.view(np.uint64) if wide else cut(values))
            size += len(values)
            if size >= CHUNK:
                yield rows_of()
                held, size = [], 0
        if size:
            yield rows_of()

    def repeats(key: tuple, table: pa.Table) -> pa.Table:
        values, n = np.unique(np.concatenate([np.frombuffer(v.as_py(), dtype=kind) for v in table["values"]]), return_counts=True)
        return pa.table({"cut": values[n > 1].astype(np.uint64).view(np.int64)})

    return durable(rows.select("first").mapInArrow(deal, "bucket long, values binary").groupBy("bucket").applyInArrow(repeats, "cut long"))


def _standing(rows: DataFrame, entries: int, carried: list[str]) -> DataFrame:
    """(shingle, *carried) for the ``entries`` in the lists ``first`` whose shortened hashes stand in two rows or more."""
    wide = entries >= WIDE
    cuts = _repeated(rows, entries, wide)
    if cuts.count() <= HELD:
        held = rows.sparkSession.sparkContext.broadcast(np.sort(cuts.toArrow()["cut"].to_numpy().view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for b in batches:
                first = b.column(0)
                shingle = first.flatten().to_numpy(zero_copy_only=False)
                value = shingle.view(np.uint64) if wide else shingle.view(np.uint64) >> np.uint64(32)
                at = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
                hit = known[at] == value if len(known) else np.zeros(len(value), dtype=bool)
                owner = pa.array(np.repeat(np.arange(b.num_rows), first.value_lengths().to_numpy(zero_copy_only=False))[hit])
                yield pa.RecordBatch.from_arrays([pa.array(shingle[hit]), *(c.take(owner) for c in b.columns[1:])], names=["shingle", *carried])

        rows = rows.select("first", *carried)
        return rows.mapInArrow(run, T.StructType([T.StructField("shingle", T.LongType()), *rows.schema.fields[1:]]))
    each = rows.select(*carried, F.explode("first").alias("shingle"))
    return each.withColumn("cut", F.col("shingle") if wide else F.shiftrightunsigned("shingle", 32)).join(cuts.hint("merge"), "cut").select("shingle", *carried)


def _met(rows: DataFrame) -> DataFrame:
    """(shingle, sig, n) for the shingles that stand in the prefixes of two different sets or more."""
    met = durable(_standing(rows, rows.agg(F.sum(F.size("first"))).head()[0] or 0, ["sig", "n"]).distinct())
    shared = met.groupBy("shingle").agg(F.min("sig").alias("_low"), F.max("sig").alias("_top")).where("_low <> _top").select("shingle")
    return durable(met.join(shared.hint("merge"), "shingle"))


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(sig, hashes) of the documents ``needed`` (sig, key), each once; the texts of no others leave their task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()) for t in part.column(1)], pa.list_(pa.int64()))], names=["sig", "hashes"])

    side = F.broadcast(needed) if needed.count() <= HELD // 2 else needed.hint("merge")
    # Repeated rows have one key.
    return durable(docs.join(side, "key").select("sig", "text").dropDuplicates(["sig"]).mapInArrow(run, "sig long, hashes array<long>"))


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least 4/5; ``known`` (sig, key, n, bits) describes all sets."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("sig").alias(end), F.col("n").alias(f"_n{end}"), F.col("bits").alias(f"_bits{end}")).hint("merge"), end)
    pairs = durable(pairs.select("a", "b", "_na", "_bitsa", "_nb", "_bitsb").mapInArrow(_near, "a long, b long"))
    sets = _sets(docs, durable(known.join(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().hint("merge"), "sig").select("sig", "key")))
    for end in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("sig").alias(end), F.col("hashes").alias(f"_{end}")).hint("merge"), end)
    both = F.size(F.array_intersect("_a", "_b"))
    return durable(pairs.where(both * 9 >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b"))


def _close(x: str, y: str) -> Column:
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def _alike(rows: DataFrame, crowd: int) -> DataFrame:
    """Pairs (a, b) of sets whose texts have the same fingerprint, or fingerprints within ``RADIUS`` bits."""
    prints = durable(rows.select("sig", "fp").distinct())
    first = durable(prints.groupBy("fp").agg(F.min("sig").alias("rep")))
    same = prints.join(first.hint("merge"), "fp").where("sig <> rep").select(F.col("sig").alias("a"), F.col("rep").alias("b"))
    # One set may stand for several fingerprints, as equal sets can have texts of different order.
    near = near_links(first.select(F.col("fp").alias("rep"), "fp"), RADIUS, crowd)
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("rep").alias(f"_{end}")).hint("merge"), end).drop(end)
    return same.unionByName(near.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _grouped(met: DataFrame, found: DataFrame, step: int = 0) -> DataFrame:
    """``met`` with the ``group`` its sets are joined to so far, without buckets whose sets are all joined, and with one set of each bucket as ``_one``.

    From step 1 on this set is drawn by a hash of bucket and step.
    """
    drawn = F.xxhash64("sig", "shingle", F.lit(step)) if step else F.col("sig")
    joined = components(found)
    met = met.join(joined.withColumnRenamed("node", "sig").hint("merge"), "sig", "left").select("shingle", "sig", "n", F.coalesce("component", "sig").alias("group"))
    split = met.groupBy("shingle").agg(F.min("group").alias("_low"), F.max("group").alias("_top"), F.min(F.struct(drawn.alias("drawn"), "sig", "n", "group")).alias("_one"), F.count(F.lit(1)).alias("m")).where("_low <> _top")
    return durable(met.join(split.select("shingle", "_one", "m").hint("merge"), "shingle"))


def _with_one(met: DataFrame) -> DataFrame:
    other = (F.col("sig") != F.col("_one.sig")) & (F.col("group") != F.col("_one.group"))
    return met.where(other & _close("n", "_one.n")).select(F.col("sig").alias("a"), F.col("_one.sig").alias("b"))


def _all_pairs(met: DataFrame) -> DataFrame:
    """All pairs of sets of one bucket and different groups. A pair is made in the first bucket that both sets list, or in each that is not after it."""
    listed = met.groupBy("sig").agg(F.slice(F.sort_array(F.collect_list("shingle")), 1, LISTED).alias("listed"))
    met = durable(met.select("shingle", "sig", "n", "group").join(listed.hint("merge"), "sig"))
    other = met.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("sig", "n", "group", "listed")])
    once = F.coalesce(F.array_min(F.array_intersect("listed", "_listed")), F.col("shingle")) >= F.col("shingle")
    return met.join(other.hint("merge"), "shingle").where((F.col("sig") < F.col("_sig")) & (F.col("group") != F.col("_group")) & _close("n", "_n") & once).select(F.col("sig").alias("a"), F.col("_sig").alias("b"))


def _differing(met: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """(cluster, sig, n, group, w, apart) for the sets of ``met``: ``apart`` is what a set and the middle of its cluster differ in. Buckets of one ``_one`` are a cluster."""
    each = durable(met.select(F.col("_one.sig").alias("cluster"), "sig", "n", "group").distinct())
    sets = _sets(docs, durable(known.join(each.select("sig").distinct().hint("merge"), "sig").select("sig", "key")))
    sizes = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("_all"))
    each = durable(attach_group_values(each, sizes, ["cluster"], ["sig"]).join(sets.hint("merge"), "sig"))
    held = each.select("cluster", "_all", F.explode("hashes").alias("shingle")).groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("_held"), F.first("_all").alias("_all"))
    middle = held.where("2 * _held > _all").groupBy("cluster").agg(F.collect_list("shingle").alias("_middle"))
    each = attach_group_values(each, middle, ["cluster"], ["sig"]).withColumn("_middle", F.coalesce("_middle", F.array().cast("array<long>")))
    each = each.withColumn("apart", F.concat(F.array_except("hashes", "_middle"), F.array_except("_middle", "hashes")))
    return durable(each.select("cluster", "sig", "n", "group", F.size("apart").alias("differs"), (9 * F.size("apart") - F.col("n")).alias("w"), "apart"))


def _rarest_first(each: DataFrame) -> DataFrame:
    """(cluster, sig, shared): for each row of ``each`` (cluster, sig, apart) the differences that another row of its cluster has too, those that few have first."""
    entries = each.select(F.col("sig").alias("_sig"), "cluster", F.transform("apart", lambda x: x.bitwiseXOR(F.xxhash64("cluster"))).alias("first"))
    entries = _standing(entries, entries.agg(F.sum(F.size("first"))).head()[0] or 0, ["cluster", "_sig"])
    often = entries.groupBy("cluster", "shingle").agg(F.collect_list("_sig").alias("_sigs")).where(F.size("_sigs") > 1)
    rows = often.select("cluster", F.size("_sigs").alias("often"), F.col("shingle").bitwiseXOR(F.xxhash64("cluster")).alias("shingle"), F.explode("_sigs").alias("sig"))
    return rows.groupBy("cluster", "sig").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("shared"))


def _by_middle(met: DataFrame, found: DataFrame, docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that are certain, and the pairs that are left to verify, enough to join all alike sets of the buckets of ``met`` (see ``_grouped``)."""
    whole = _differing(met, docs, known)
    each = whole.drop("apart")
    least = each.groupBy("cluster").agg(F.min(F.struct("w", "sig")).alias("_least"))
    certain = attach_group_values(each, least, ["cluster"], ["sig"]).where((F.col("w") + F.col("_least.w") <= 0) & (F.col("sig") != F.col("_least.sig")))
    certain = durable(certain.select(F.col("sig").alias("a"), F.col("_least.sig").alias("b")))
    joined = components(found.unionByName(certain))
    each = durable(each.join(joined.withColumnRenamed("node", "sig").hint("merge"), "sig", "left").withColumn("group", F.coalesce("component", "group")).drop("component"))

    # The smallest w of the other groups of a cluster.
    low = durable(each.groupBy("cluster", "group").agg(F.min("w").alias("_w")))
    low = attach_group_values(low, low.groupBy("cluster").agg(F.min(F.struct("_w", "group")).alias("_low")), ["cluster"], ["group"])
    second = low.where(F.col("group") != F.col("_low.group")).groupBy("cluster").agg(F.first("_low").alias("_low"), F.min("_w").alias("_second"))
    each = attach_group_values(each, second, ["cluster"], ["sig"]).where("_second IS NOT NULL")
    other = F.when(F.col("group") == F.col("_low.group"), F.col("_second")).otherwise(F.col("_low._w"))
    must = lambda w: F.greatest(F.lit(1), F.ceil((F.col("w") + F.greatest(other, w)) / 18))
    # The set of the smaller w of a pair shows the first of its differences; the w of both can lie apart by twice the size of one of them.
    size = F.greatest(F.lit(0), F.col("differs") - must(F.col("w") - 5 * F.col("n") / 2) + 1).cast("int")
    each = durable(each.select("cluster", "sig", "n", "group", "w", "differs", (F.col("differs") - must(F.col("w")) + 1).alias("shown"), size.alias("size")).where("size > 0"))
    shared = _rarest_first(whole.select("cluster", "sig", "apart").join(each.select("cluster", "sig").hint("merge"), ["cluster", "sig"]))
    # Differences that no other set has come before these.
    alone = F.col("differs") - F.size("shared")
    entries = shared.join(each.hint("merge"), ["cluster", "sig"]).where(F.col("size") > alone).withColumn("_alone", alone)
    entries = entries.select("cluster", "sig", "n", "group", "w", "shown", "differs", "_alone", F.posexplode(F.slice("shared", F.lit(1), F.col("size") - F.col("_alone"))).alias("_at", "_x")).withColumn("rank", F.col("_alone") + F.col("_at"))
    entries = durable(entries.select("cluster", "_x.shingle", "sig", "n", "group", "w", (F.col("rank") < F.col("shown")).alias("shows"), (F.col("differs") - F.col("rank")).alias("left")))
    other = entries.select("cluster", "shingle", *[F.col(c).alias(f"_{c}") for c in ("sig", "n", "group", "w", "left")])
    # They can share no more than what is left of both from here on.
    enough = F.col("w") + F.col("_w") <= 18 * F.least("left", "_left")
    after = F.struct("w", "sig") < F.struct(F.col("_w").alias("w"), F.col("_sig").alias("sig"))
    pairs = entries.where("shows").join(other.hint("merge"), ["cluster", "shingle"]).where(after & (F.col("group") != F.col("_group")) & _close("n", "_n") & enough)
    return certain, pairs.select(F.col("sig").alias("a"), F.col("_sig").alias("b"))


def links(docs: DataFrame, rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Verified links (a, b) between sets, enough to join every pair with a similarity of at least 4/5.

    ``docs`` (key, doc_id, text) and ``rows`` (key, sig, n, bits, fp: the fingerprint, first: the prefix) describe the same documents.
    """
    known = durable(rows.groupBy("sig").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    found = _verified(_alike(rows.where("n > 0"), crowd), docs, known)
    met = _grouped(_met(rows), found)
    found = durable(found.unionByName(_verified(_with_one(met), docs, known)))
    met = _grouped(met.where(F.col("sig") != F.col("_one.sig")).select("shingle", "sig", "n"), found)

    small = met.where(F.col("m") <= crowd).groupBy("shingle").agg(F.collect_list(F.struct("sig", "n", "group")).alias("e"))
    pairs = small.select(F.explode(F.flatten(F.transform("e", lambda x: F.transform(
        F.filter("e", lambda y: (x["sig"] < y["sig"]) & (x["group"] != y["group"]) & (5 * F.least(x["n"], y["n"]) >= 4 * F.greatest(x["n"], y["n"]))),
        lambda y: F.struct(x["sig"].alias("a"), y["sig"].alias("b")))))).alias("l")).select("l.*")
    crowded = met.where(F.col("m") > crowd)
    found = durable(found.unionByName(_verified(pairs.unionByName(_with_one(crowded)), docs, known)))
    for step in range(1, ROUNDS + 1):
        # The last step takes one and the same set for all buckets that hold it, if it can.
        crowded = _grouped(crowded.where(F.col("sig") != F.col("_one.sig")).select("shingle", "sig", "n"), found, step % ROUNDS)
        if crowded.isEmpty():
            break
        if step < ROUNDS:
            pairs = _with_one(crowded)
        else:
            certain, pairs = _by_middle(crowded.where(F.col("m") > LARGE * crowd), found, docs, known)
            found = found.unionByName(certain)
            pairs = pairs.unionByName(_all_pairs(crowded.where(F.col("m") <= LARGE * crowd)))
        found = durable(found.unionByName(_verified(pairs, docs, known)))
    return found


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(key, doc_id, group) for every row with an id: documents of one group are linked by similarities of at least 4/5.

    ``key`` is a hash of id and text. Null and blank texts have no shingles and are one group.
    """
    texts = _texts(docs).where("doc_id IS NOT NULL")
    order = docs.sparkSession.sparkContext.broadcast(_order(texts, crowd))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t.as_py()) for t in part.column(2)]
                sig = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                fp = np.array([fingerprint(t.as_py()) for t in part.column(2)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sig), pa.array([len(s) for s in sets], pa.int32()),
                                                  pa.array([sketch(s) for s in sets], pa.binary()), pa.array(fp), pa.array([prefix(s, order.value) for s in sets], pa.list_(pa.int64()))],
                                                 names=["key", "doc_id", "sig", "n", "bits", "fp", "first"])

    rows = durable(texts.mapInArrow(run, "key long, doc_id long, sig long, n int, bits binary, fp long, first array<long>"))
    found = durable(components(links(texts, rows, crowd)).withColumnRenamed("node", "sig"))
    # Copies share a key of this join; they are spread by their place in the written table.
    numbered = rows.select("key", "doc_id", "sig", F.monotonically_increasing_id().alias("_place"))
    return attach_group_values(numbered, found, ["sig"], ["_place"]).select("key", "doc_id", F.coalesce("component", "sig").alias("group"))


def keep_first(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id (any one, if several rows have this id). Rows without an id stay."""
    first = near_duplicates(docs, crowd).groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("r"), F.count(F.lit(1)).alias("_n"))
    kept = durable(first.select(F.col("r.key").alias("_key"), "_n"))
    out = whole_row(docs.where("doc_id IS NOT NULL"), _key=F.xxhash64("doc_id", "text")).join(kept.hint("merge"), "_key")
    once = out.where("_n = 1").select("_row.*")
    several = out.where("_n > 1").dropDuplicates(["_key"]).select("_row.*")
    return once.unionByName(several).unionByName(docs.where("doc_id IS NULL"))
