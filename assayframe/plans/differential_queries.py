"""Registered queries on two-arm counts: size factors, adjustment, differential abundance and comparisons."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.functions.columns import round_half_even
from assayframe.operators import diffabund as da
from assayframe.operators.compare import annotate, chained_outer, membership_counts, significant, unique_to_one, wide_compare
from assayframe.operators.joins import full_outer
from assayframe.operators.ranking import bh_adjust, exact_quantiles
from assayframe.operators.reshape import drop_all_zero
from assayframe.plans.tables import (
    ARMS_SQL, abund_by_supplier, arm_counts, fixed, fixed_all, fixed_sql as fx, load, supplier_arms,
)
from assayframe.session import durable
from assayframe.sources.writers import result_summary

ALPHA = 0.2
#: The upper quantile of a normal distribution that the width of the fold changes is matched at.
_Z = statistics.NormalDist().inv_cdf(0.975)
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_ARMS = dict(sample="sample", feature="feature", count="n", arm="arm", control="F", treated="O", strata=["region"])


def size_factors(spark: SparkSession, sf: str) -> DataFrame:
    cells = durable(arm_counts(spark, sf))
    samples = cells.select("region", "sample", "arm").distinct()
    return fixed_all(da.size_factors(cells, samples, **_ARMS), ["size_factor"])


def norm_mean(spark: SparkSession, sf: str) -> DataFrame:
    cells = durable(arm_counts(spark, sf))
    samples = cells.select("region", "sample", "arm").distinct()
    factors = da.size_factors(cells, samples, **_ARMS)
    return fixed_all(da.norm_mean(cells, factors, "sample", "feature", "n", ["region"]), ["baseMean"])


def all_zero_dropped(spark: SparkSession, sf: str) -> DataFrame:
    cells = abund_by_supplier(spark, sf).withColumn("n", F.greatest(F.col("n") - 6, F.lit(0)))
    kept = drop_all_zero(cells.withColumn("half", F.col("sample") % 2), "feature", "n", ["half"])
    return kept.groupBy("half", "feature").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("total"))


def rounded_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_suppkey", round_half_even(F.col("l_quantity") / 4).alias("c"))
    return lines.groupBy("l_suppkey", "c").agg(F.count(F.lit(1)).alias("n_rows"))


def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    out = exact_quantiles(load(spark, sf, "orders"), "o_totalprice", [0.05, 0.5, 0.95], ["o_orderpriority"])
    return out.select("o_orderpriority", *[fixed(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


def bh(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus",
                                              (F.floor(F.col("o_totalprice") / 100) / 10000).alias("p"))
    family = orders.withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("p") * F.col("p") / 50))
    out = bh_adjust(family, "p", ["o_orderpriority"], salt_on=["o_orderkey"])
    return out.select("o_orderkey", fixed("padj", 9).alias("padj"))


def _crude(spark: SparkSession, sf: str) -> DataFrame:
    """Log ratio of the arms' line counts per region and feature, with its Poisson standard error."""
    arms = arm_counts(spark, sf).groupBy("region", "feature").agg(
        (F.sum(F.when(F.col("arm") == "F", F.col("n")).otherwise(0)) + 0.5).alias("a"),
        (F.sum(F.when(F.col("arm") == "O", F.col("n")).otherwise(0)) + 0.5).alias("b"))
    ln2 = F.lit(math.log(2.0))
    rated = arms.select(
        "region", "feature", ((F.col("a") + F.col("b")) / 2).alias("baseMean"),
        (F.ln(F.col("b") / F.col("a")) / ln2).alias("log2FoldChange"), (F.sqrt(1 / F.col("a") + 1 / F.col("b")) / ln2).alias("lfcSE"))
    return da.wald_statistics(rated)


def wald_p(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_all(_crude(spark, sf), ["baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue"])


def summary(spark: SparkSession, sf: str) -> DataFrame:
    tested = bh_adjust(durable(_crude(spark, sf)), "pvalue", ["region"], salt_on=["feature"])
    return result_summary(tested, 0.9, ["region"])


def rejections(spark: SparkSession, sf: str) -> DataFrame:
    tested = durable(_crude(spark, sf).withColumn("pvalue", F.col("pvalue") * F.col("pvalue") / 8))
    return fixed_all(da.rejections_by_cutoff(tested, "pvalue", "baseMean", ALPHA, ["region"]), ["theta", "cutoff"])


def filtered_adjust(spark: SparkSession, sf: str) -> DataFrame:
    tested = durable(_crude(spark, sf).withColumn("pvalue", F.col("pvalue") * F.col("pvalue") / 8))
    out = da.filtered_bh(tested, "pvalue", "baseMean", ALPHA, ["region"])
    return fixed_all(out, ["pvalue", "padj"]).select("region", "feature", "pvalue", "padj")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return significant(_crude(spark, sf), ALPHA, "pvalue")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    out = wide_compare(_hits(spark, sf), ["feature"], "region", REGIONS, ["log2FoldChange", "pvalue"])
    return fixed_all(out, [c for c in out.columns if c != "feature"])


def wide_chained(spark: SparkSession, sf: str) -> DataFrame:
    hits = durable(_hits(spark, sf).select("region", "feature", "log2FoldChange"))
    parts = [(r, hits.filter(F.col("region") == r)) for r in REGIONS]
    out = chained_outer(parts, ["feature"], ["log2FoldChange"])
    return fixed_all(out, [c for c in out.columns if c != "feature"])


def unique_sets(spark: SparkSession, sf: str) -> DataFrame:
    return unique_to_one(_hits(spark, sf), ["feature"], "region")


def venn(spark: SparkSession, sf: str) -> DataFrame:
    return membership_counts(_hits(spark, sf), ["feature"], "region", REGIONS)


def lfc_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = wide_compare(_crude(spark, sf), ["feature"], "region", REGIONS, ["log2FoldChange"])
    return fixed_all(out, [c for c in out.columns if c != "feature"])


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    named = load(spark, sf, "part").groupBy(F.concat_ws("|", "p_brand", "p_type").alias("feature")).agg(F.min("p_name").alias("description"))
    out = annotate(_hits(spark, sf), named, "feature", ["region", "log2FoldChange", "pvalue"])
    return fixed_all(out, ["log2FoldChange", "pvalue"])


def outer_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").groupBy(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nk")).agg(
        F.count(F.lit(1)).alias("n_rows"), fixed(F.avg("c_acctbal")).alias("bal"))
    suppliers = load(spark, sf, "supplier").groupBy(F.nullif(F.col("s_nationkey"), F.lit(7)).alias("nk")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return full_outer(customers, suppliers, ["nk"], ("_customer", "_supplier"))


def nb_wald(spark: SparkSession, sf: str) -> DataFrame:
    cells = durable(arm_counts(spark, sf))
    samples = cells.select("region", "sample", "arm").distinct()
    out = da.nb_wald(cells, samples, **_ARMS)
    return fixed_all(out, ["baseMean", "dispersion", "log2FoldChange", "lfcSE", "max_cook", "stat", "pvalue"])


def differential(spark: SparkSession, sf: str) -> DataFrame:
    cells = durable(arm_counts(spark, sf))
    samples = cells.select("region", "sample", "arm").distinct()
    out = da.differential(cells, samples, alpha=ALPHA, **_ARMS)
    return fixed_all(out, ["baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj"])


def lfc_prior(spark: SparkSession, sf: str) -> DataFrame:
    weighted = _crude(spark, sf).withColumn("weight", 1 / (1 / F.col("baseMean") + 0.1))
    return fixed_all(da.fold_change_prior(weighted, "log2FoldChange", "weight", ["region"]), ["upper_quantile", "prior_var"])


def nb_map(spark: SparkSession, sf: str) -> DataFrame:
    cells = durable(arm_counts(spark, sf))
    samples = cells.select("region", "sample", "arm").distinct()
    out = da.shrunken_wald(cells, samples, **_ARMS)
    return fixed_all(out, ["baseMean", "dispersion", "log2FoldChange", "lfcSE", "plain", "prior_var", "stat", "pvalue"])


def outliers_replaced(spark: SparkSession, sf: str) -> DataFrame:
    cells, samples = supplier_arms(spark, sf)
    out = da.nb_wald(durable(cells), samples, "sample", "feature", "n", "arm", "even", "odd", ["study"])
    return fixed_all(out, ["baseMean", "dispersion", "log2FoldChange", "lfcSE", "max_cook", "stat", "pvalue"])


QUERIES = {
    "size_factors": size_factors,
    "norm_mean": norm_mean,
    "drop_all_zero": all_zero_dropped,
    "rounded_counts": rounded_counts,
    "exact_quantiles": quantiles,
    "bh_adjust": bh,
    "wald_test": wald_p,
    "result_summary": summary,
    "rejections_by_cutoff": rejections,
    "filtered_bh": filtered_adjust,
    "wide_compare": wide,
    "wide_compare_chained": wide_chained,
    "unique_sets": unique_sets,
    "membership_counts": venn,
    "lfc_matrix": lfc_matrix,
    "annotate": annotated,
    "full_outer_nulls": outer_with_nulls,
    "nb_wald": nb_wald,
    "differential": differential,
    "lfc_prior": lfc_prior,
    "nb_map": nb_map,
    "outliers_replaced": outliers_replaced,
}

_FACTORS = ARMS_SQL + """,
n_smp AS (SELECT region, count(DISTINCT sample) AS m FROM arms GROUP BY 1),
lm AS (SELECT region, feature, avg(ln(n)) AS ml FROM arms JOIN n_smp USING (region) GROUP BY region, feature, m HAVING count(*) = m),
factors AS (SELECT region, sample, exp(median(ln(n) - ml)) AS size_factor FROM arms JOIN lm USING (region, feature) GROUP BY 1, 2)"""
_CRUDE = ARMS_SQL + """,
ab AS (SELECT region, feature, coalesce(sum(n) FILTER (arm = 'F'), 0) + 0.5 AS a, coalesce(sum(n) FILTER (arm = 'O'), 0) + 0.5 AS b FROM arms GROUP BY 1, 2),
lf AS (SELECT region, feature, CAST((a + b) / 2 AS DOUBLE) AS bm, ln(b / a) / ln(2) AS lfc, sqrt(1.0 / a + 1.0 / b) / ln(2) AS se FROM ab),
node AS (SELECT i / 2000.0 AS u, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 6000.0 AS wt FROM (SELECT unnest(range(2001)) AS i)),
tail AS (SELECT region, feature, sum(wt * exp(-pow(u * abs(lfc / se) / sqrt(2), 2))) AS mean_e FROM lf, node GROUP BY 1, 2),
crude AS (SELECT region, feature, bm, lfc, se, lfc / se AS stat, 1 - 2 / sqrt(pi()) * mean_e * abs(lfc / se) / sqrt(2) AS p FROM lf JOIN tail USING (region, feature)),
hits AS (SELECT * FROM crude WHERE p < 0.2)"""


def _bh_sql(source: str, keys: str, p: str = "p") -> str:
    return f"""(SELECT *, least(1.0, min(q) OVER (PARTITION BY {keys} ORDER BY {p} DESC)) AS padj FROM
  (SELECT *, {p} * count(*) OVER (PARTITION BY {keys}) / count(*) OVER (PARTITION BY {keys} ORDER BY {p}) AS q FROM {source} WHERE {p} IS NOT NULL))"""


_CUTS = """
tst AS (SELECT region, feature, bm, p * p / 8 AS p FROM crude),
th AS (SELECT CAST(unnest(range(50)) AS INTEGER) AS step),
cut AS (SELECT region, step, 0.95 * step / 49 AS theta, c AS cutoff FROM (
    SELECT region, unnest(quantile_cont(bm, [""" + ", ".join(repr(0.95 * i / 49) for i in range(50)) + """])) AS c, unnest(range(50)) AS step FROM tst GROUP BY region)),
used AS (SELECT c.region, c.step, p, count(*) OVER (PARTITION BY c.region, c.step) AS m, count(*) OVER (PARTITION BY c.region, c.step ORDER BY p) AS k
  FROM cut c JOIN tst t ON t.region = c.region AND t.bm >= c.cutoff),
rej AS (SELECT region, step, max(k) AS n_rej FROM used WHERE p * m / k < 0.2 GROUP BY 1, 2)"""


def _smooth_sql(rounds: int = 3, share: float = 0.2, steps: int = 50) -> str:
    """The robust local straight lines through (theta, n_rej) of each region, round by round, as CTEs; the last is ``fit{rounds}``."""
    near = max(2, int(share * steps + 1e-7))
    out = f"""
pt AS MATERIALIZED (SELECT c.region, c.step, theta AS x, CAST(coalesce(n_rej, 0) AS DOUBLE) AS y, cutoff FROM cut c LEFT JOIN rej USING (region, step)),
gap AS MATERIALIZED (SELECT a.region, a.step AS i, a.x AS xi, b.step AS j, b.x, b.y, abs(a.x - b.x) AS g, row_number() OVER (PARTITION BY a.region, a.step ORDER BY abs(a.x - b.x)) AS r FROM pt a JOIN pt b USING (region)),
ker AS MATERIALIZED (SELECT region, i, xi, j, x, y, CASE WHEN g > 0.999 * h THEN 0 WHEN g > 0.001 * h THEN pow(1 - pow(g / h, 3), 3) ELSE 1 END AS k
  FROM gap JOIN (SELECT region, i, g AS h FROM gap WHERE r = {near}) USING (region, i)),
wt0 AS (SELECT region, step AS j, 1.0 AS w, FALSE AS done, 0.0 AS old FROM pt)"""
    for t in range(rounds + 1):
        out += f""",
one{t} AS MATERIALIZED (SELECT region, i, any_value(xi) AS xi, sum(k * w) AS total, sum(k * w * x) / nullif(sum(k * w), 0) AS mid, sum(k * w * y) / nullif(sum(k * w), 0) AS level FROM ker JOIN wt{t} USING (region, j) GROUP BY 1, 2),
two{t} AS MATERIALIZED (SELECT o.region, o.i, any_value(o.total) AS total, any_value(o.level) AS level, any_value(o.xi - o.mid) AS off,
  sum(k * w * (x - mid) * (x - mid)) / nullif(any_value(o.total), 0) AS spread, sum(k * w * (x - mid) * y) / nullif(any_value(o.total), 0) AS slope
  FROM one{t} o JOIN ker USING (region, i) JOIN wt{t} USING (region, j) GROUP BY 1, 2),
fit{t} AS MATERIALIZED (SELECT p.region, p.step, p.x, p.y, p.cutoff, w.done, CASE WHEN w.done THEN w.old WHEN total <= 0 THEN p.y WHEN sqrt(spread) > 0.001 * 0.95 THEN level + off * slope / spread ELSE level END AS fit
  FROM pt p JOIN two{t} f ON f.region = p.region AND f.i = p.step JOIN wt{t} w ON w.region = p.region AND w.j = p.step)"""
        if t < rounds:
            out += f""",
res{t} AS (SELECT region, 6 * median(abs(y - fit)) AS scale, avg(abs(y - fit)) AS mean, max(abs(y)) AS top FROM fit{t} GROUP BY 1),
wt{t + 1} AS MATERIALIZED (SELECT f.region, f.step AS j, CASE WHEN abs(y - fit) <= 0.001 * scale THEN 1 WHEN abs(y - fit) <= 0.999 * scale THEN pow(1 - pow(abs(y - fit) / scale, 2), 2) ELSE 0 END AS w,
  f.done OR scale < 1e-7 * mean OR scale <= 1e-12 * top AS done, fit AS old FROM fit{t} f JOIN res{t} USING (region))"""
    return out


ORACLES = {
    "lfc_prior": f"""WITH {_CRUDE},
kn AS (SELECT region, abs(lfc) AS x, 1 / (1 / bm + 0.1) AS w FROM crude WHERE abs(lfc) < 10),
sz AS (SELECT region, count(*) AS n, sum(w) AS total, max(x) AS top FROM kn GROUP BY 1),
run AS (SELECT region, x, n, top, 1 + (n - 1) * 0.95 AS spot, sum(v.w) OVER (PARTITION BY region ORDER BY x) * n / total + 1e-9 AS reached FROM (SELECT region, x, sum(w) AS w FROM kn GROUP BY 1, 2) v JOIN sz USING (region)),
pick AS (SELECT region, n, spot - floor(spot) AS part, coalesce(min(x) FILTER (reached >= greatest(floor(spot), 1)), any_value(top)) AS lo,
  coalesce(min(x) FILTER (reached >= least(greatest(floor(spot), 1) + 1, n)), any_value(top)) AS hi FROM run GROUP BY region, n, spot)
SELECT region, n, {fx('(1 - part) * lo + part * hi')} AS upper_quantile, {fx(f'pow(((1 - part) * lo + part * hi) / {_Z}, 2)')} AS prior_var FROM pick""",
    "filtered_bh": f"""WITH {_CRUDE}, {_CUTS}, {_smooth_sql()},
lim AS (SELECT region, max(y) AS most, max(fit) - sqrt(avg((y - fit) * (y - fit)) FILTER (y > 0)) AS enough FROM fit3 GROUP BY 1),
pickd AS (SELECT region, coalesce(min(step) FILTER (most > 10 AND y > enough), 0) AS step FROM fit3 JOIN lim USING (region) GROUP BY 1),
msk AS (SELECT t.region, t.feature, t.p AS pvalue, CASE WHEN t.bm >= c.cutoff THEN t.p END AS p FROM tst t JOIN pickd d USING (region) JOIN cut c ON c.region = d.region AND c.step = d.step),
adj AS {_bh_sql('msk', 'region')}
SELECT m.region, m.feature, {fx('m.pvalue')} AS pvalue, {fx('a.padj')} AS padj FROM msk m LEFT JOIN adj a USING (region, feature)""",
    "size_factors": f"WITH {_FACTORS} SELECT region, sample, {fx('size_factor')} AS size_factor FROM factors",
    "norm_mean": f"""WITH {_FACTORS} SELECT region, feature, {fx('sum(n / size_factor) / max(m)')} AS "baseMean"
FROM arms JOIN factors USING (region, sample) JOIN n_smp USING (region) GROUP BY 1, 2""",
    "drop_all_zero": """
WITH c AS (SELECT l_suppkey % 2 AS half, p_brand || '|' || p_type AS feature, l_suppkey, greatest(count(*) - 6, 0) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT half, feature, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1, 2 HAVING sum(n) <> 0""",
    "rounded_counts": "SELECT l_suppkey, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS c, count(*) AS n_rows FROM lineitem GROUP BY 1, 2",
    "exact_quantiles": "SELECT o_orderpriority, " + ", ".join(
        f"{fx(f'quantile_cont(o_totalprice, {q})')} AS {n}" for q, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))) + " FROM orders GROUP BY 1",
    "bh_adjust": f"""
WITH o AS (SELECT o_orderkey, o_orderpriority AS fam, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 100) / 10000 END AS r FROM orders),
t AS (SELECT o_orderkey, fam, r * r / 50 AS p FROM o), a AS {_bh_sql('t', 'fam')}
SELECT t.o_orderkey, {fx('a.padj', 9)} AS padj FROM t LEFT JOIN a USING (o_orderkey)""",
    "wald_test": f"""WITH {_CRUDE} SELECT region, feature, {fx('bm')} AS "baseMean", {fx('lfc')} AS "log2FoldChange", {fx('se')} AS "lfcSE", {fx('stat')} AS stat, {fx('p')} AS pvalue FROM crude""",
    "result_summary": f"""WITH {_CRUDE}, a AS {_bh_sql('crude', 'region')}
SELECT region, count(*) FILTER (bm > 0) AS n_tested, count(*) FILTER (padj < 0.9 AND lfc > 0) AS n_up, count(*) FILTER (padj < 0.9 AND lfc < 0) AS n_down,
  CAST(0 AS BIGINT) AS n_outlier, CAST(0 AS BIGINT) AS n_low_count FROM a GROUP BY 1""",
    "rejections_by_cutoff": f"""WITH {_CRUDE}, {_CUTS}
SELECT c.region, CAST(c.step AS INTEGER) AS step, {fx('theta')} AS theta, {fx('cutoff')} AS cutoff, coalesce(n_rej, 0) AS n_rej FROM cut c LEFT JOIN rej USING (region, step)""",
    "wide_compare": f"WITH {_CRUDE} SELECT feature, " + ", ".join(
        f"{fx(f't{i}.lfc')} AS \"log2FoldChange_{r}\", {fx(f't{i}.p')} AS \"pvalue_{r}\"" for i, r in enumerate(REGIONS))
    + " FROM (SELECT * FROM hits WHERE region = 'AFRICA') t0 " + " ".join(
        f"FULL JOIN (SELECT * FROM hits WHERE region = '{r}') t{i} USING (feature)" for i, r in enumerate(REGIONS) if i),
    "wide_compare_chained": f"WITH {_CRUDE} SELECT feature, " + ", ".join(
        f"{fx(f'max(lfc) FILTER (region = {r!r})')} AS \"log2FoldChange_{r}\"" for r in REGIONS)
    + " FROM hits GROUP BY 1",
    "unique_sets": f"WITH {_CRUDE} SELECT h.feature, h.region FROM hits h ANTI JOIN (SELECT a.feature FROM hits a JOIN hits b ON a.feature = b.feature AND a.region < b.region) m USING (feature)",
    "membership_counts": f"WITH {_CRUDE}, f AS (SELECT feature, " + ", ".join(f"bool_or(region = '{r}') AS \"in_{r}\"" for r in REGIONS)
    + " FROM hits GROUP BY 1) SELECT " + ", ".join(f'"in_{r}"' for r in REGIONS) + ", count(*) AS n_keys FROM f GROUP BY ALL",
    "lfc_matrix": f"WITH {_CRUDE} SELECT feature, " + ", ".join(
        f"{fx(f'max(lfc) FILTER (region = {r!r})')} AS \"log2FoldChange_{r}\"" for r in REGIONS) + " FROM crude GROUP BY 1",
    "annotate": f"""WITH {_CRUDE}, d AS (SELECT p_brand || '|' || p_type AS feature, min(p_name) AS description FROM part GROUP BY 1)
SELECT feature, region, {fx('lfc')} AS "log2FoldChange", {fx('p')} AS pvalue, description FROM hits JOIN d USING (feature)""",
    "full_outer_nulls": f"""
WITH c AS (SELECT nullif(c_nationkey, 3) AS nk, count(*) AS n_rows, {fx('avg(c_acctbal)')} AS bal FROM customer GROUP BY 1),
s AS (SELECT nullif(s_nationkey, 7) AS nk, count(*) AS n_rows FROM supplier GROUP BY 1)
SELECT coalesce(c.nk, s.nk) AS nk, c.n_rows AS n_rows_customer, c.bal, s.n_rows AS n_rows_supplier FROM c FULL JOIN s ON c.nk IS NOT DISTINCT FROM s.nk""",
}
