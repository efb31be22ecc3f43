"""Rank-based permutation tests on pair distances, and the relabelings they use."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayframe.functions.columns import ratio
from assayframe.operators.distance import block_count, block_pairs, sample_block
from assayframe.operators.joins import _bare, _on
from assayframe.operators.ranking import BUCKET_ROWS, attach_by_value, running_counts, value_table
from assayframe.session import durable, ship

#: Distances are compared at this many digits, so that equal sums in another order still tie.
DIGITS = 12
#: Samples per block when labels meet pairs: a task holds up to this many squared ranked pairs.
BLOCK_SAMPLES = 512
#: Splits listed from one row before their numbers are dealt out to tasks.
SPLITS_PER_ROW = 65_536


def _positions(samples: DataFrame, sample: str, strata: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*strata).orderBy(sample)
    return samples.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def random_relabelings(
    samples: DataFrame,
    sample: str,
    label: str,
    permutations: int,
    seed: int = 0,
    strata: Sequence[str] = (),
) -> DataFrame:
    """``(strata, perm_id, sample, label)`` for ``perm_id`` 1..permutations, shuffled within strata.

    A relabeling orders the samples by ``md5(seed|perm_id|sample)`` and deals the labels out in that
    order, so any SQL engine can repeat the draw.
    """
    strata = list(strata)
    placed = _positions(samples.select(*strata, sample, label).distinct(), sample, strata)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm_id").cast("string"), F.col(sample).cast("string")))
    deal = Window.partitionBy(*strata, "perm_id").orderBy("__key", sample)
    drawn = (
        placed.select(*strata, sample, F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm_id"))
        .withColumn("__key", key)
        .withColumn("pos", (F.row_number().over(deal) - 1).cast("int"))
    )
    keys = [*strata, "pos"]
    dealt = _bare(placed.select(*keys, label), keys, "p")
    return drawn.join(dealt, _on(keys, "p"), "inner").select(*strata, "perm_id", sample, label)


def exact_relabelings(samples: DataFrame, sample: str, label: str, strata: Sequence[str] = ()) -> DataFrame:
    """Every distinct split of a stratum's samples into two arms of the observed sizes, but the observed one.

    With arms of equal size a split and its mirror image are one. ``perm_id`` counts from 1. Splits are numbered in
    ascending order of the set bits of the first arm; each task computes its splits from their numbers alone, so no
    subset that is not a split is ever listed and the number of samples has no limit of its own.
    """
    strata = list(strata)
    dealt = samples.select(*strata, sample, label).distinct()
    sizes = dealt.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("n_labels"))
    bad = sizes.filter(F.col("n_labels") != 2).limit(1).collect()
    if bad:
        raise ValueError(f"exact relabelings need two arms: {bad[0]}")
    most = sizes.agg(F.max("n")).head()[0] or 2
    # Binomial coefficients up to the largest stratum; those above 2^62 cannot be listed in any case.
    table = F.lit([[min(math.comb(i, k), 1 << 62) for k in range(most + 1)] for i in range(most + 1)])
    # One entry per sample of a stratum, in sample order.
    rows = dealt.groupBy(*strata).agg(
        F.sort_array(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(label).alias("l")))).alias("m")
    )
    first = F.col("m")[0]["l"]
    rows = rows.withColumns({
        "__first": first,
        "__other": F.filter("m", lambda e: e["l"] != first)[0]["l"],
        "__ones": F.size(F.filter("m", lambda e: e["l"] == first)),
    })
    # With equal arms the first sample stays in the first arm, and only the others are dealt.
    rows = rows.withColumn("__fixed", (F.col("__ones") * 2 == F.size("m")).cast("int"))
    rows = rows.withColumns({"__n": F.size("m") - F.col("__fixed"), "__k": F.col("__ones") - F.col("__fixed")})
    rows = rows.withColumn("__choose", table).withColumn("__total", F.get(F.get("__choose", F.col("__n")), F.col("__k")))
    rows = rows.withColumn("__seen", F.expr(
        "aggregate(sequence(0, __n - 1), struct(0L as r, 0 as j), (a, i) -> if(m[i + __fixed].l = __first, "
        "struct(a.r + __choose[i][a.j + 1] as r, a.j + 1 as j), a), a -> a.r)"))
    numbers = (
        rows.withColumn("__from", F.explode(F.expr(f"sequence(0L, __total - 1, {SPLITS_PER_ROW}L)")))
        .repartition(*strata, "__from")
        .withColumn("__rank", F.explode(F.expr(f"sequence(__from, least(__from + {SPLITS_PER_ROW}, __total) - 1)")))
        .filter("__rank <> __seen")
    )
    # From the last sample down: it belongs to the first arm if the number reaches past all splits without it.
    bits = F.expr(
        "aggregate(reverse(sequence(0, __n - 1)), struct(__rank as r, __k as k, cast(array() as array<int>) as bits), (a, i) -> if(a.k > 0 and a.r >= __choose[i][a.k], "
        "struct(a.r - __choose[i][a.k] as r, a.k - 1 as k, concat(array(1), a.bits) as bits), struct(a.r as r, a.k as k, concat(array(0), a.bits) as bits)), "
        "a -> if(__fixed = 1, concat(array(1), a.bits), a.bits))")
    perm = (F.col("__rank") + 1 - (F.col("__rank") > F.col("__seen")).cast("int")).cast("int")
    spots = numbers.select(*strata, perm.alias("perm_id"), "__first", "__other", bits.alias("__bits"), "m").select(
        *strata, "perm_id", "__first", "__other", "__bits", F.posexplode("m").alias("__i", "__e"))
    chosen = F.when(F.get("__bits", F.col("__i")) == 1, F.col("__first")).otherwise(F.col("__other"))
    return spots.select(*strata, "perm_id", F.col("__e")["s"].alias(sample), chosen.alias(label))


def _label_pairs(pairs: DataFrame, samples: DataFrame, sample: str, label: str, strata: Sequence[str]) -> DataFrame:
    """Add ``within``: whether both samples of a pair carry the same label."""
    keys = [*strata, sample]
    for side in ("a", "b"):
        tag = f"l{side}"
        names = {k: f"__{tag}_{k}" for k in keys} | {label: f"__{tag}_label"}
        side_labels = samples.select(*keys, label).withColumnsRenamed(names)
        on = F.col(f"sample_{side}") == F.col(f"__{tag}_{sample}")
        for k in strata:
            on = on & F.col(k).eqNullSafe(F.col(f"__{tag}_{k}"))
        pairs = pairs.join(side_labels, on, "inner").drop(*[f"__{tag}_{k}" for k in keys])
    return pairs.withColumn("within", F.col("__la_label") == F.col("__lb_label")).drop("__la_label", "__lb_label")


def _r_statistic(rank_within: Column, n_within: Column, n_pairs: Column) -> Column:
    all_ranks = n_pairs * (n_pairs + 1) / F.lit(2.0)
    between = ratio(all_ranks - rank_within, n_pairs - n_within)
    return ratio(between - ratio(rank_within, n_within), n_pairs / F.lit(2.0))


def anosim_r(
    pairs: DataFrame,
    samples: DataFrame,
    sample: str,
    label: str,
    strata: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """ANOSIM statistic R per stratum.

    Pairs are reduced to distinct distances with a count of all and of within-group pairs before ranking, so
    ranks never have to go back to the pairs. Pairs without a distance are left out.
    """
    rounded = _label_pairs(pairs.withColumn("dist", F.round("dist", DIGITS)), samples, sample, label, strata)
    table = value_table(rounded, "dist", strata, {"n_within": F.count_if("within")})
    counts = running_counts(table, "dist", strata, bucket_rows)
    rank = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    sums = counts.groupBy(*strata).agg(
        F.sum(rank * F.col("n_within")).alias("rank_within"),
        F.sum("n_within").alias("n_within"),
        F.max("total").alias("n_pairs"),
    )
    return sums.select(*strata, _r_statistic(F.col("rank_within"), F.col("n_within"), F.col("n_pairs")).alias("r"),
                       "n_pairs", "n_within")


def _permute_task(n_keys: int, sum_schema: list[str]):
    def run(key: tuple, pairs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(labels):
            return pd.DataFrame(columns=sum_schema)
        spot = {s: i for i, s in enumerate(labels["sample"])}
        deck = np.stack(labels["labels"].to_numpy())
        a = pairs["sample_a"].map(spot).to_numpy()
        b = pairs["sample_b"].map(spot).to_numpy()
        rank = pairs["avg_rank"].to_numpy()
        perms = deck.shape[1]
        within, count = np.zeros(perms), np.zeros(perms, dtype=np.int64)
        # A few thousand pairs at a time: same-label flags for all relabelings, then one product.
        step = max(1, 4_000_000 // perms)
        for lo in range(0, len(rank), step):
            part = slice(lo, lo + step)
            flags = deck[a[part]] == deck[b[part]]
            within += rank[part] @ flags
            count += flags.sum(axis=0)
        out = {c: key[i] for i, c in enumerate(sum_schema[:n_keys])}
        return pd.DataFrame({"perm_id": np.arange(perms), "rank_within": within, "n_within": count}).assign(**out)[sum_schema]

    return run


def anosim(
    pairs: DataFrame,
    samples: DataFrame,
    sample: str,
    label: str,
    relabelings: DataFrame,
    strata: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
    block_samples: int = BLOCK_SAMPLES,
) -> DataFrame:
    """ANOSIM with a permutation p-value per stratum: ``(strata, r, p_value, n_perm, n_pairs)``.

    ``relabelings`` is ``(strata, perm_id, sample, label)`` with ``perm_id`` 1, 2, ... in every stratum.
    ``p = (1 + count(R_perm >= R)) / (1 + n_perm)``. The ranked pairs are grouped by blocks of
    samples and meet the label arrays of their two blocks, so a pair row is never repeated per relabeling.
    """
    ship(pairs.sparkSession)
    strata = list(strata)
    pairs = durable(pairs.select(*strata, "sample_a", "sample_b", F.round("dist", DIGITS).alias("dist")).filter("dist IS NOT NULL"))
    counts = running_counts(value_table(pairs, "dist", strata), "dist", strata, bucket_rows)
    table = counts.withColumn("avg_rank", F.col("before") + (F.col("ties") + 1) / F.lit(2.0))
    ranked = attach_by_value(pairs, table, "dist", strata, ["avg_rank"], ["sample_a", "sample_b"])

    # Labels as small integers, the observed grouping first.
    seen = samples.select(*strata, F.lit(0).alias("perm_id"), F.col(sample).alias("sample"), F.col(label).alias("label")).distinct()
    drawn = relabelings.select(*strata, "perm_id", F.col(sample).alias("sample"), F.col(label).alias("label"))
    every = durable(seen.unionByName(drawn))
    # Label arrays are lined up by position: every sample of a stratum needs each relabeling once.
    sizes = every.groupBy(*strata, "sample").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("perm_id").alias("d"), F.max("perm_id").alias("top"))
    bad = sizes.groupBy(*strata).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("d").alias("d"), F.max("top").alias("top"))
    bad = bad.filter("low <> high OR d <> high OR top <> high - 1").limit(1).collect()
    if bad:
        raise ValueError(f"a sample lacks a relabeling, has one twice, or perm_id does not count from 1: {bad[0]}")
    # One row per label: a number for each, met by an ordinary join.
    levels = durable(every.select("label").distinct().withColumn("code", F.row_number().over(Window.orderBy("label"))))
    every = every.join(levels.withColumnRenamed("label", "__label"), F.col("label").eqNullSafe(F.col("__label")), "inner")
    code = F.col("code")
    decks = every.groupBy(*strata, "sample").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("perm_id", code.alias("code")))), lambda c: c["code"]).alias("labels")
    )
    most = decks.groupBy(*strata).count().agg(F.max("count")).head()[0] or 1
    blocks = block_count(most, pairs.sparkSession.sparkContext.defaultParallelism, block_samples)
    spread = (
        decks.withColumn("block", sample_block("sample", blocks))
        .withColumn("pair", F.explode(block_pairs("block", blocks)))
        .select(*strata, F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "sample", "labels")
    )
    at_a, at_b = sample_block("sample_a", blocks), sample_block("sample_b", blocks)
    placed = ranked.select(*strata, F.least(at_a, at_b).alias("lo"), F.greatest(at_a, at_b).alias("hi"),
                           "sample_a", "sample_b", F.col("avg_rank"))
    schema = T.StructType([pairs.schema[k] for k in strata])
    schema = schema.add("perm_id", "integer").add("rank_within", "double").add("n_within", "long")
    keys = [*strata, "lo", "hi"]
    sums = (
        placed.groupBy(*keys).cogroup(spread.groupBy(*keys))
        .applyInPandas(_permute_task(len(strata), schema.names), schema)
        .groupBy(*strata, "perm_id")
        .agg(F.sum("rank_within").alias("rank_within"), F.sum("n_within").alias("n_within"))
    )
    n_pairs = pairs.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_pairs"))
    stats = sums.join(_bare(n_pairs, strata, "n"), _on(strata, "n"), "inner").select(
        *strata, "perm_id", "n_pairs",
        _r_statistic(F.col("rank_within"), F.col("n_within"), F.col("n_pairs")).alias("r"))
    # One row per relabeling is left; the observed one is compared within its stratum.
    whole = Window.partitionBy(*strata)
    seen_r = F.max(F.when(F.col("perm_id") == 0, F.col("r"))).over(whole)
    flagged = stats.withColumn("__seen", seen_r)
    above = (F.col("perm_id") > 0) & (F.col("r") >= F.col("__seen"))
    n_perm = F.count_if(F.col("perm_id") > 0)
    return flagged.groupBy(*strata).agg(
        F.max("__seen").alias("r"),
        ((F.count_if(above) + 1) / (n_perm + 1)).alias("p_value"),
        n_perm.alias("n_perm"),
        F.max("n_pairs").alias("n_pairs"),
    )
