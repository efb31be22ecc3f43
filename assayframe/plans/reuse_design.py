"""The published medium-reuse experiment as parameters: sample dimension, windows, level orders, figures.

The operators know nothing of it; a study passes these tables in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values of the experiment -------------------------------------------------------------
GROWTH_TYPES = {
    "Round": "int", "Day": "int", "Algae": "string", "Treatment": "string", "Replicate": "string", "Chl": "double",
    "OD750": "double", "DOC": "double", "TDN": "double", "FvFm": "double", "pH": "double", "PO4": "double",
    "NH4": "double", "Si": "double",
}
DAILY_TYPES = {
    "Round": "int", "Day": "int", "Date": "string", "Tstart": "string", "Tend": "string",
    "Chl_medium": "double", "OD750_medium": "double",
}
MEASURES = ["DOC", "TDN", "FvFm", "pH", "PO4", "NH4", "Si", "DaysElapsed", "biomass_OD", "biomass_chl"]
STRAINS = ["C323", "D046", "Navicula"]
FIGURE_STRAINS = ["D046", "Navicula", "C323"]
# Days used for growth rates: (Algae, Round, Treatment, Replicate, first day, last day); None means any.
GROWTH_WINDOWS = [
    ("Navicula", None, None, None, 0, 2),
    ("C323", 1, "F", "C", 0, 3),
    ("C323", 3, "F", None, 0, 3),
    ("C323", 1, "R", "E", 0, 4),
    ("D046", 3, None, None, 0, 4),
    ("C323", 1, "F", "A", 1, 3),
    ("C323", 1, "F", "B", 1, 4),
    ("C323", 1, "R", "D", 1, 4),
    ("C323", 1, "R", "F", 1, 4),
    ("C323", 2, "F", None, 1, 4),
    ("C323", 0, None, None, 2, 5),
    ("C323", 2, "R", None, 3, 5),
    ("C323", 3, "R", None, 3, 8),
]
CONTAMINANTS = ["OTU_16", "OTU_27"]
ROLLUP_PCT = 1.0
ROLLUP = {
    "Other_Gammaproteobacteria": ["HTCC2188", "Order_HTCC2188", "Order_Chromatiales", "Piscirickettsiaceae", "Saccharospirillaceae"],
    "Other_Alphaproteobacteria": ["Pelagibacteraceae", "Hyphomicrobiaceae"],
}
LEGEND_ORDER = [
    "Spirochaetaceae", "Plantomycetaceae", "Cryomorphaceae", "Balneolaceae", "Phyllobacteriaceae", "Hyphomonadaceae",
    "Rhodobacteraceae", "Rhodospirillaceae", "Erythrobacteraceae", "Other_Alphaproteobacteria", "Alteromonadaceae",
    "Other_Gammaproteobacteria", "Other",
]
ALPHA = 0.05
PERMUTATIONS = 999
# --------------------------------------------------------------------------------------------------

SAMPLE_SCHEMA = "sample string, strain string, kind string, arm string, replicate string"
WINDOW_SCHEMA = "Algae string, Round int, Treatment string, Replicate string, day_lo int, day_hi int"


def sample_rows(strains: list[str] | None = None) -> list[tuple]:
    """Seven samples per strain: an inoculum, then three fresh and three reused cultures."""
    rows = []
    for s, strain in enumerate(strains or STRAINS):
        for i in range(7):
            kind, arm, replicate = ("inoculum", None, None) if i == 0 else ("final", "Fresh" if i <= 3 else "Reused", "ABCDEF"[i - 1])
            rows.append((f"SL{7 * s + i + 1}", strain, kind, arm, replicate))
    return rows


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sample_rows(), SAMPLE_SCHEMA)


def growth_windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROWTH_WINDOWS, WINDOW_SCHEMA)


def figure_panels() -> list[dict]:
    """Every plotted panel: figure, panel, source table, measure, filters (strain, round, day, not NULL)."""
    panels = [
        dict(figure="fig1", panel="C323_OD", source="averages", measure="biomass_OD", strain="C323", not_round=3, x="DaysElapsed_mean"),
    ]
    for strain in FIGURE_STRAINS:
        rnd = {"round": 3} if strain == "C323" else {}
        panels.append(dict(figure="fig2", panel=f"{strain}_OD", source="averages", measure="biomass_OD", strain=strain, **rnd))
        for figure, measures in (("nutrients", ["PO4", "NH4", "Si"]), ("fig3", ["DOC"]), ("figS3", ["FvFm"])):
            for m in measures:
                panels.append(dict(figure=figure, panel=f"{strain}_{m}", source="averages", measure=m, strain=strain, known=True, **rnd))
    for m in ("NH4", "PO4", "Si"):
        panels.append(dict(figure="figS1", panel=f"initial_{m}", source="averages", measure=m, round=3, day=0))
    panels.append(dict(figure="figS2", panel="mu", source="mu_averages", measure="mu", round=3))
    panels.append(dict(figure="figS2", panel="max_OD", source="peak_averages", measure="max_OD", round=3))
    return panels
