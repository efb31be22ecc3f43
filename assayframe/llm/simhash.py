"""Near-duplicates by SimHash, with a generalised pigeonhole search.

If two fingerprints differ in at most ``radius`` bits and the bits are dealt into parts with thresholds that add up to
radius - parts + 1, then in some part they differ by at most that part's threshold. Bits that agree more often than
chance are grouped, so that the parts are as independent of each other as they can be, and a dynamic program gives each part the threshold (-1: not probed) for which
the estimated number of probes and candidates is least. The estimates come from how often each bit is set among all distinct
fingerprints.

Fingerprints are reduced to distinct ones first. A bucket (a part's value) with at most ``crowd`` entries is verified
directly. Fingerprints in a larger bucket are matched by a form that needs no pairs: each names itself and all values
one bit away; two differ by two bits at most exactly when they name a common value, and at most 65 fingerprints can name it, so each is linked to the smallest that does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.llm.common import durable, whole_row
from assayframe.llm.components import components
from assayframe.operators.joins import attach_group_values

BITS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingle hashes turned into bits at once.
CHUNK = 1 << 14
SHIFTS = np.arange(BITS, dtype=np.uint64)
CROWD = 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles: a bit is set when it is set in over half of their hashes. 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - width + 1)
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    view, hashed, ones = memoryview(joined), xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at:min(n, at + CHUNK)].tolist(), last[at:at + CHUNK].tolist())
        h = np.fromiter((hashed(view[s:e], seed) for s, e in pairs), dtype=np.uint64, count=min(n - at, CHUNK))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` holds the 64 bits as a signed long. Null and blank texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, in how many both are set; one small row per task comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), dtype=np.float64)
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), CHUNK):
                x = (values[at:at + CHUNK, None] >> SHIFTS & np.uint64(1)).astype(np.float32)
                both += x.T @ x
            n += len(values)
        if n:
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["i", "j", "n"])

    counts = np.zeros((BITS + 1, BITS + 1))
    for r in distinct.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        counts[r["i"], r["j"]] = r["n"]
    return int(counts[-1, -1]), counts[:BITS, :BITS]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into parts of even size, each grown from its most correlated bits."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        first = max(sorted(free), key=lambda b: related[b, sorted(free)].sum())
        group = [first]
        free.discard(first)
        while len(group) < size:
            nxt = max(sorted(free), key=lambda b: related[b, group].sum())
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, radius: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of least estimated cost: probes and stored keys plus candidates."""
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    best = None
    for parts in range(1, radius + 3):
        groups = group_bits(n, both, parts)
        costs = []
        for bits in groups:
            at = np.zeros(radius + 1)  # chance that a pair differs in exactly t bits of the part
            at[0] = 1
            for b in bits:
                at[1:] = at[1:] * (1 - differ[b]) + at[:-1] * differ[b]
                at[0] *= 1 - differ[b]
            probes = np.cumsum([len(list(combinations(range(len(bits)), t))) for t in range(radius + 1)])
            # Keys are shuffled, sorted and counted; a candidate costs one comparison.
            costs.append([0.0] + [n * (1.0 + probes[t] * (t > 0)) + n * n / 2 * at[: t + 1].sum() for t in range(radius + 1)])
        total = radius - parts + 1
        # table[s]: least cost of the parts so far with thresholds + 1 adding up to s.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in table.items():
                for t in range(-1, radius + 1):
                    entry = (cost + c[t + 1], [*chosen, t])
                    if s + t + 1 <= total + parts and (s + t + 1 not in grown or entry[0] < grown[s + t + 1][0]):
                        grown[s + t + 1] = entry
            table = grown
        if total + parts in table and (best is None or table[total + parts][0] < best[0]):
            best = (*table[total + parts], groups)
    return best[2], best[1]


def _keys(groups: Sequence[Sequence[int]], thresholds: Sequence[int]):
    """Arrow function: each fingerprint's stored keys, and its probes where a part's threshold is above 0."""
    masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
    flips = [[np.uint64(sum(1 << b for b in c)) for t in range(1, thresholds[k] + 1) for c in combinations(g, t)] for k, g in enumerate(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                rep, fp = part.column(0), part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                for k, mask in enumerate(masks):
                    if thresholds[k] < 0:
                        continue
                    for probe, flip in [(False, np.uint64(0)), *((True, f) for f in flips[k])]:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(fp), k, dtype=np.int32)), pa.array(((fp & mask) ^ flip).view(np.int64)), pa.array(np.full(len(fp), probe)), rep, part.column(1)],
                            names=["part", "key", "probe", "rep", "fp"])
    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's own value and all values one bit away."""
    flips = np.concatenate([np.zeros(1, dtype=np.uint64), np.uint64(1) << SHIFTS])
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            fp, rep = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64), part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(rep, len(flips)))], names=["value", "rep"])


def near_links(distinct: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between representatives, enough to join every pair of fingerprints within ``radius`` (at most 2) bits.

    ``distinct`` (rep, fp) holds each fingerprint once.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the form for crowded buckets covers up to two bits")
    n, both = bit_counts(distinct)
    groups, thresholds = allocate(n, both, radius)
    keys = distinct.select("rep", "fp").mapInArrow(_keys(groups, thresholds), "part int, key long, probe boolean, rep long, fp long")
    keys = durable(keys)
    sizes = durable(keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("probe"), 1)).alias("stored")).where("n > 1 AND stored > 0"))
    met = durable(keys.join(sizes.select("part", "key", "n").hint("merge"), ["part", "key"]))
    small = met.where(F.col("n") <= crowd).repartition("part", "key").groupBy("part", "key").agg(F.collect_list(F.struct("rep", "fp", "probe")).alias("m"))
    pairs = small.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (
        ~x["probe"] & (x["rep"] != y["rep"]) & (y["probe"] | (x["rep"] > y["rep"])) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius))),
        lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))).alias("l")).select("l.*")
    crowded = met.where(F.col("n") > crowd).select("rep", "fp").distinct()
    if radius < 2:  # one bit apart or equal: a value named by both is one of the two
        named = crowded.mapInArrow(_named, "value long, rep long").join(crowded.select(F.col("fp").alias("value"), F.col("rep").alias("a")), "value").select("a", F.col("rep").alias("b"))
        return pairs.unionByName(named)
    named = durable(crowded.mapInArrow(_named, "value long, rep long"))
    first = durable(named.groupBy("value").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return pairs.unionByName(named.join(first.hint("merge"), "value").where("rep <> a").select("a", F.col("rep").alias("b")))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null, empty and blank texts share fingerprint zero and link like others. Fingerprints link at ``radius`` or fewer differing bits.
    Rows without an id link nothing; they carry the component of their fingerprint, null if no row with an id has it.
    Repeated rows are returned as often as they occur. An empty table gives an empty table; other columns are ignored.
    """
    rows = durable(fingerprints(docs, id_col, text_col, width))
    distinct = durable(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = durable(components(near_links(distinct, radius, crowd)))
    named = durable(distinct.join(found.hint("merge"), distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    # Copies and empty texts share a fingerprint; they are spread by their place in the written table.
    numbered = rows.withColumn("_place", F.monotonically_increasing_id())
    return attach_group_values(numbered, named, ["fp"], ["_place"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id (any one, if several rows have this id). Rows without an id stay."""
    found = near_duplicates(docs, radius)
    kept = durable(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")))
    rows = whole_row(docs, _id=F.col("doc_id").cast("long"))
    # The ids to keep grow with the corpus: never a broadcast side, at any size.
    out = rows.join(kept.hint("merge"), "_id")
    once = out.where("_n = 1").select("_row.*")
    several = out.where("_n > 1").dropDuplicates(["_id"]).select("_row.*")
    return once.unionByName(several).unionByName(docs.where("doc_id IS NULL"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
