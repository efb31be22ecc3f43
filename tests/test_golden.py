"""The published tables and derived anchor values."""

import math

import pytest
from golden import golden_tables
from pyspark.sql import functions as F

from assayframe.operators.distance import bray_curtis
from assayframe.operators.permutation import anosim, exact_relabelings
from assayframe.operators.reshape import melt, renormalise
from assayframe.operators.ranking import bh_adjust
from assayframe.operators.diffabund import wald_statistics
from assayframe.plans import reuse_design as d
from assayframe.plans.studies import community_study, compare_strata, differential_study, growth_figures, growth_study
from assayframe.sources.readers import read_feature_matrix, read_table


def near(a, b, tol=1e-6):
    return a is not None and abs(a - b) <= tol


@pytest.fixture(scope="module")
def growth(spark):
    measures = read_table(spark, str(golden_tables("Round ,Day ,Algae")[0]), d.GROWTH_TYPES)
    daily = read_table(spark, str(golden_tables("Round,Day,Date,")[0]), d.DAILY_TYPES)
    return growth_study(measures, daily, d.growth_windows(spark))


def test_growth_anchors(growth):
    axis = {(r.Round, r.Day): r.DaysElapsed for r in growth["axis"].collect()}
    assert near(axis[0, 6], 5.9861111) and near(axis[1, 0], 6.9864583) and near(axis[3, 8], 28.0239583)
    assert growth["enriched"].count() == 282 and growth["mu"].count() == 36
    mu = {(r.Algae, r.Treatment): (r.mu_mean, r.mu_sd) for r in growth["mu_averages"].filter("Round = 3").collect()}
    for key, mean, sd in ((("C323", "F"), 0.767145, 0.090779), (("C323", "R"), 0.211998, 0.166036), (("D046", "F"), 0.942295, 0.125014),
                          (("D046", "R"), 1.014104, 0.066150), (("Navicula", "F"), 1.111773, 0.130541), (("Navicula", "R"), 1.076100, 0.032934)):
        assert near(mu[key][0], mean) and near(mu[key][1], sd)
    od = {(r.Algae, r.Treatment): (r.max_OD_mean, r.max_OD_sd) for r in growth["peak_averages"].filter("Round = 3").collect()}
    assert near(od["C323", "R"][0], 0.024667) and near(od["D046", "R"][1], 0.047258)
    ch = {(r.Algae, r.Treatment): r for r in growth["change_averages"].collect()}
    assert near(ch["C323", "F"].DOC_change_mean, 35.7667, 1e-4) and near(ch["Navicula", "R"].DOC_change_sd, 14.2732, 1e-4)
    assert near(ch["C323", "R"].DOC_per_OD_mean, 165.4359, 1e-4) and near(ch["Navicula", "F"].DOC_per_OD_mean, 2278.9216, 1e-4)


def test_growth_tests(growth):
    t = {(r.Algae, r.measure): r for r in growth["tests"].collect()}
    for key, f, pf, tv, df, p, choice in (
        (("C323", "mu"), 0.298925, 0.460265, 5.081293, 4, 0.007074, "pooled"),
        (("D046", "mu"), 3.571587, 0.437485, -0.879386, 4, 0.428850, "pooled"),
        (("Navicula", "mu"), 15.710697, 0.119684, 0.458944, 4, 0.670106, "pooled"),
        (("C323", "max_OD"), 0.025830, 0.050360, 3.309645, 4, 0.029664, "pooled"),
        (("D046", "max_OD"), 0.003731, 0.007435, -2.755893, 2.014925, 0.109418, "welch"),
        (("Navicula", "max_OD"), 0.053305, 0.101215, -2.429575, 4, 0.072014, "pooled"),
    ):
        r = t[key]
        assert near(r.f, f) and near(r.p_f, pf) and near(r.t, tv) and near(r.df, df) and near(r.p_t, p) and r.choice == choice


def test_growth_figures(growth):
    feed = growth_figures(growth)
    per = {(r.figure, r.panel): r["count"] for r in feed.groupBy("figure", "panel").count().collect()}
    assert len(per) == len(d.figure_panels()) == 24
    assert per["figS2", "mu"] == 6 and per["figS1", "initial_Si"] == 6
    one = feed.filter("figure = 'figS2' AND panel = 'mu' AND Algae = 'C323' AND Treatment = 'F'").head()
    assert near(one.hi - one.lo, 2 * 0.090779, 2e-6) and one.strain_order == 3


@pytest.fixture(scope="module")
def matrices(spark):
    found = [melt(read_feature_matrix(spark, str(f)).drop("taxonomy"), ["feature"]) for f in golden_tables("# Constructed")]
    by_total = {}
    for m in found:
        total = m.agg(F.sum("abundance"), F.count_distinct("feature")).head()
        by_total["counts" if total[0] > 1000 else "shares" if total[1] == 40 else "clean"] = m
    return by_total


def test_community(spark, matrices):
    families = read_table(spark, str(golden_tables("OTU_ID\ttaxonomy\tFamily")[0]), {}, sep="\t")
    families = families.select(F.col("OTU_ID").alias("feature"), F.col("Family_Legend").alias("family"))
    out = community_study(matrices["counts"], d.samples(spark), families, seed=3)
    rich = {r.sample: r.richness for r in out["richness"].collect()}
    assert [rich[f"SL{i}"] for i in range(1, 22)] == [21, 21, 22, 21, 21, 23, 22, 25, 23, 24, 22, 26, 25, 28, 20, 18, 18, 22, 20, 18, 22]
    shares = {r.family: r.share_pct for r in out["family_shares"].collect()}
    assert near(shares["Rhodobacteraceae"], 45.8715, 1e-4) and near(shares["Spirochaetaceae"], 2.3935, 1e-4)
    comp = out["composition"]
    assert {r[0] for r in comp.select("legend_label").distinct().collect()} == set(d.LEGEND_ORDER)
    assert all(near(r[0], 1.0, 1e-12) for r in comp.groupBy("sample").agg(F.sum("share")).drop("sample").collect())
    arm = {r.strain: r for r in out["arm_anosim"].collect()}
    assert near(arm["C323"].r, 1) and near(arm["D046"].r, 1) and near(arm["Navicula"].r, 4 / 9)
    assert all(near(r.p_value, 0.1, 1e-12) for r in arm.values())
    every = out["strain_anosim"].head()
    assert near(every.r, 0.988986) and every.n_pairs == 210 and every.n_perm == 999 and every.p_value < 0.01


def test_distances_and_contaminants(spark, matrices):
    pairs = bray_curtis(matrices["shares"], "sample", "feature", "abundance")
    assert near(pairs.filter("sample_a = 'SL1' AND sample_b = 'SL2'").head().dist, 0.2056131418, 1e-9)
    clean = renormalise(matrices["shares"], ~F.col("feature").isin(d.CONTAMINANTS), ["sample"], "abundance", ["feature"])
    gap = clean.alias("a").join(matrices["clean"].alias("b"), ["feature", "sample"]).agg(F.max(F.abs(F.col("a.abundance") - F.col("b.abundance"))), F.count("*")).head()
    assert gap[0] < 1e-8 and gap[1] == 38 * 21
    final = d.samples(spark).filter("kind = 'final'")
    grown = clean.join(final.select("sample", "strain"), "sample")
    got = {r.strain: r for r in anosim(bray_curtis(grown, "sample", "feature", "abundance", ["strain"]), final, "sample", "arm",
                                       exact_relabelings(final, "sample", "arm", ["strain"]), ["strain"]).collect()}
    assert near(got["C323"].r, 1) and near(got["D046"].r, 0.962963) and near(got["Navicula"].r, 1 / 3)
    assert all(near(r.p_value, 0.1, 1e-12) for r in got.values())


def _published(spark):
    out = None
    for f in golden_tables('"","baseMean","log2FoldChange"'):
        types = dict.fromkeys(["baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj"], "double")
        strain = f.name.split("_")[0]
        t = read_table(spark, str(f), types, row_key="feature").withColumn("strain", F.lit("Navicula" if strain == "Navi" else strain))
        out = t if out is None else out.unionByName(t)
    return out


def test_wald_and_adjustment_on_published_rows(spark):
    t = _published(spark).cache()
    assert t.count() == 82
    again = wald_statistics(t.drop("stat", "pvalue").withColumnRenamed("padj", "padj_pub"))
    both = again.join(t.select("strain", "feature", F.col("stat").alias("s"), F.col("pvalue").alias("p")), ["strain", "feature"])
    for r in bh_adjust(both, "pvalue", ["strain"]).collect():
        assert math.isclose(r.stat, r.s, rel_tol=1e-12) and math.isclose(r.pvalue, r.p, rel_tol=1e-11) and math.isclose(r.padj, r.padj_pub, rel_tol=1e-11)


def test_differential_end_to_end(spark, matrices):
    want = {(r.strain, r.feature): r for r in _published(spark).collect()}
    out = differential_study(matrices["counts"], d.samples(spark))
    got = {(r.strain, r.feature): r for r in out["result"].collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert math.isclose(g.baseMean, w.baseMean, rel_tol=1e-12)
        assert math.isclose(g.log2FoldChange, w.log2FoldChange, rel_tol=1e-3)
        assert math.isclose(g.lfcSE, w.lfcSE, rel_tol=1e-3)
        assert (g.padj < 0.05) == (w.padj < 0.05)
    hits = {r.strain: r["count"] for r in out["significant"].groupBy("strain").count().collect()}
    assert hits == {"C323": 8, "D046": 10, "Navicula": 6}
    s = {r.strain: (r.n_tested, r.n_up + r.n_down, r.n_outlier, r.n_low_count) for r in out["summary"].collect()}
    assert s == {"C323": (26, 8, 0, 0), "D046": (30, 10, 0, 0), "Navicula": (26, 6, 0, 0)}
    assert out["fold_changes"].count() == len({k[1] for k in want})


@pytest.mark.parametrize("clean", [True, False])
def test_cross_strain_comparison(spark, clean):
    n_rows = {True: (124, 70, 17), False: (141, 115, 66)}[clean]
    parts = [f for f in golden_tables('"","pathway","log2FoldChange","padj"') if len(f.read_text().splitlines()) - 1 in n_rows]
    assert len(parts) == 3
    rows = None
    for f in parts:
        t = read_table(spark, str(f), {"log2FoldChange": "double", "padj": "double"}).drop("row_key").withColumn("strain", F.lit(f.name.split("_")[0]))
        rows = t if rows is None else rows.unionByName(t)
    names = read_table(spark, str(golden_tables("pathway,description")[0]), {})
    out = compare_strata(rows.drop("description"), names, "pathway", ["C323", "D046", "Navi"])
    unique = {r.strain: r["count"] for r in out["unique"].groupBy("strain").count().collect()}
    assert unique == ({"C323": 90, "D046": 34, "Navi": 4} if clean else {"C323": 62, "D046": 31, "Navi": 5})
    wide = out["wide"]
    assert wide.count() == (167 if clean else 191)
    every = wide.filter("padj_C323 IS NOT NULL AND padj_D046 IS NOT NULL AND padj_Navi IS NOT NULL").count()
    assert every == (5 if clean else 38)
    measures = [c for c in wide.columns if c not in ("pathway", "description")]
    head = '"","pathway","log2FoldChange_C323"' if clean else "description,pathway,log2FoldChange_C323"
    published = read_table(spark, str(golden_tables(head)[0]), dict.fromkeys(measures, "double"))
    want = {r.pathway: r for r in published.collect()}
    for r in wide.collect():
        w = want[r.pathway]
        for c in measures:
            tol = 0.0 if clean else 0.006 if c.startswith("padj") else 1e-7
            assert (r[c] is None) == (w[c] is None) and (r[c] is None or math.isclose(r[c], w[c], rel_tol=tol, abs_tol=0.0 if clean or c.startswith("padj") else 6e-9)), (r.pathway, c)
