"""The three analyses end to end, as functions from input tables to named result tables.

Nothing runs until a result is used, apart from tables that feed several steps and are written once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assayframe.operators.compare import annotate, significant, unique_to_one, wide_compare
from assayframe.operators.diffabund import differential
from assayframe.operators.distance import bray_curtis
from assayframe.operators.joins import add_covariates
from assayframe.operators.permutation import anosim, exact_relabelings, random_relabelings
from assayframe.operators.regress import growth_rate
from assayframe.operators.reshape import level_rank, share_in_group
from assayframe.operators.rules import rule_window
from assayframe.operators.summarize import endpoint_change, mean_sd, peak, richness, rollup_rare, share_of_total
from assayframe.operators.timeaxis import clock, elapsed_days, midpoint
from assayframe.operators.twosample import two_sample
from assayframe.plans import reuse_design as d
from assayframe.session import durable
from assayframe.sources.writers import figure_feed, result_summary

CULTURE = ["Algae", "Round", "Treatment", "Replicate"]


def growth_study(growth: DataFrame, daily: DataFrame, windows: DataFrame, last_round: int = 3,
                 first_day: int = 0, last_day: int = 8, control: str = "F", treated: str = "R") -> dict[str, DataFrame]:
    """Time axis, blank correction, daily averages, growth rates, peaks, endpoint changes and the two-arm tests."""
    timed = daily.withColumn("__mid", midpoint(clock("Date", "Tstart"), clock("Date", "Tend")))
    axis = elapsed_days(timed, "__mid", (F.col("Round") == 0) & (F.col("Day") == 0), out="DaysElapsed").select(
        "Round", "Day", "Chl_medium", "OD750_medium", "DaysElapsed")
    enriched = durable(add_covariates(growth, axis, ["Round", "Day"]).withColumns({
        "biomass_OD": F.col("OD750") - F.col("OD750_medium"),
        "biomass_chl": F.col("Chl") - F.col("Chl_medium"),
    }))
    arm = ["Algae", "Round", "Treatment"]
    mu = growth_rate(rule_window(enriched, windows, CULTURE, "Day"), CULTURE, "DaysElapsed", "biomass_OD")
    peaks = peak(enriched, CULTURE, "biomass_OD", "max_OD")
    at = enriched.filter(F.col("Round") == last_round)
    change = endpoint_change(at, ["Algae", "Treatment", "Replicate"], F.col("Day") == first_day, F.col("Day") == last_day,
                             "DOC", "biomass_OD", "DOC_change", "DOC_per_OD")
    final = mu.join(peaks, CULTURE, "full").filter(F.col("Round") == last_round)
    return {
        "axis": axis,
        "enriched": enriched,
        "averages": mean_sd(enriched, [*arm, "Day"], d.MEASURES),
        "mu": mu,
        "mu_averages": mean_sd(mu, arm, ["mu"]),
        "peak": peaks,
        "peak_averages": mean_sd(peaks, arm, ["max_OD"]),
        "change": change,
        "change_averages": mean_sd(change, ["Algae", "Treatment"], ["DOC_change", "DOC_per_OD"]),
        "tests": two_sample(final, ["Algae"], "Treatment", control, treated, ["mu", "max_OD"], conf=0.95),
    }


def growth_figures(tables: dict[str, DataFrame]) -> DataFrame:
    """Long feed of all growth figures: one row per plotted point with its error bar."""
    keys = ["Algae", "Round", "Treatment", "Day", "x"]
    feeds = []
    for p in d.figure_panels():
        source = tables[p["source"]]
        if "Day" not in source.columns:
            source = source.withColumn("Day", F.lit(None).cast("int"))
        source = source.withColumn("x", F.col(p.get("x", "Day")).cast("double"))
        where = F.lit(True)
        for column, name in (("Algae", "strain"), ("Round", "round"), ("Day", "day")):
            if name in p:
                where = where & (F.col(column) == p[name])
        if "not_round" in p:
            where = where & (F.col("Round") != p["not_round"])
        if p.get("known"):
            where = where & F.col(f"{p['measure']}_mean").isNotNull()
        feeds.append(figure_feed(source, p["figure"], p["panel"], keys, f"{p['measure']}_mean", f"{p['measure']}_sd", where))
    every = reduce(DataFrame.unionByName, feeds)
    return level_rank(every, "Algae", d.FIGURE_STRAINS, "strain_order")


def community_study(cells: DataFrame, samples: DataFrame, families: DataFrame, seed: int = 0,
                    permutations: int = d.PERMUTATIONS) -> dict[str, DataFrame]:
    """Richness, composition and permutation tests of a long (feature, sample, abundance) table."""
    named = cells.join(families, "feature", "inner")
    rolled = rollup_rare(named, "sample", "family", "abundance", d.ROLLUP_PCT, d.ROLLUP)
    composition = share_in_group(rolled, ["sample"], "abundance", ["legend_label"])
    final = samples.filter(F.col("kind") == "final")
    grown = cells.join(final.select("strain", "sample"), "sample", "inner")
    within = bray_curtis(grown, "sample", "feature", "abundance", ["strain"], samples=final)
    every = bray_curtis(cells, "sample", "feature", "abundance", samples=samples)
    return {
        "richness": richness(cells, ["sample"], "abundance"),
        "family_shares": share_of_total(named, ["family"], "abundance"),
        "composition": level_rank(composition, "legend_label", d.LEGEND_ORDER),
        "distances": every,
        "arm_anosim": anosim(within, final, "sample", "arm", exact_relabelings(final, "sample", "arm", ["strain"]), ["strain"]),
        "strain_anosim": anosim(every, samples, "sample", "strain", random_relabelings(samples, "sample", "strain", permutations, seed)),
    }


def differential_study(counts: DataFrame, samples: DataFrame, alpha: float = d.ALPHA, control: str = "Fresh",
                       treated: str = "Reused", descriptions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Differential abundance per strain, its significant part, and the comparison across strains."""
    final = samples.filter(F.col("kind") == "final")
    result = differential(counts, final, "sample", "feature", "abundance", "arm", control, treated, alpha, ["strain"])
    out = compare_strata(significant(result, alpha), descriptions)
    return {"result": result, "summary": result_summary(result, alpha, ["strain"]),
            "fold_changes": wide_compare(result, ["feature"], "strain", d.STRAINS, ["log2FoldChange"]), **out}


def compare_strata(hits: DataFrame, descriptions: DataFrame | None = None, key: str = "feature",
                   strata: list[str] | None = None) -> dict[str, DataFrame]:
    """Significant rows, optionally annotated, as one wide table and as sets unique to a stratum."""
    keys = [key]
    columns = ["strain", "log2FoldChange", "padj"]
    rows = hits.select(key, *columns)
    if descriptions is not None:
        rows = annotate(hits, descriptions, key, columns)
        keys = [key, "description"]
    return {
        "significant": rows,
        "wide": wide_compare(rows, keys, "strain", strata or d.STRAINS, ["log2FoldChange", "padj"]),
        "unique": unique_to_one(rows, keys, "strain"),
    }
