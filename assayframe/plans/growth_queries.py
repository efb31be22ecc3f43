"""Registered queries on measurements over time: time axis, summaries, rates, changes and two-arm tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayframe.functions.columns import strict
from assayframe.operators.joins import add_covariates
from assayframe.operators.regress import growth_rate, linear_fit
from assayframe.operators.reshape import level_rank, melt
from assayframe.operators.rules import rule_window
from assayframe.operators.summarize import endpoint_change, mean_sd, peak
from assayframe.operators.timeaxis import clock, elapsed_days, midpoint
from assayframe.operators.twosample import two_sample
from assayframe.plans.tables import fixed, fixed_all, fixed_sql as fx, load, regions
from assayframe.session import small_table
from assayframe.sources.readers import duplicate_keys
from assayframe.sources.writers import figure_feed

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
# (priority, status, first day, last day); None means any.
WINDOWS = [
    ("1-URGENT", None, 0, 400),
    ("1-URGENT", "F", 300, 700),
    ("2-HIGH", "O", 100, 900),
    ("2-HIGH", "P", 500, 600),
    ("2-HIGH", "P", 550, 800),
    ("3-MEDIUM", "F", 1000, 2000),
    (None, "P", 2000, 2200),
    (None, None, 1500, 1510),
]


def _micros(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({column} AS timestamp_ntz))")


def growth_slope(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_type", "user_id", "value", _micros("ts").alias("us"))
    timed = elapsed_days(events, "us", F.lit(True))
    rates = growth_rate(timed, ["event_type", "user_id"], "days_elapsed", "value")
    return fixed_all(mean_sd(rates, ["event_type"], ["mu"]), ["mu_mean", "mu_sd"])


def time_axis(spark: SparkSession, sf: str) -> DataFrame:
    stamps = load(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    daily = stamps.groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "day", F.date_format("day", "M/d/yy").alias("date"),
        F.date_format("a", "H:mm").alias("tstart"), F.date_format("b", "H:mm").alias("tend"))
    timed = daily.withColumn("mid", midpoint(clock("date", "tstart"), clock("date", "tend")))
    first = F.col("date") == F.lit("1/1/24")
    return elapsed_days(timed, "mid", first).select(F.col("day").cast("string").alias("day"), "tstart", fixed("days_elapsed").alias("days_elapsed"))


def blank_correct(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "event_type", "value", F.to_date("ts").alias("day"))
    blank = events.groupBy("day", "event_type").agg(F.avg("value").alias("blank"))
    joined = add_covariates(events, blank, ["day", "event_type"])
    return joined.select("event_id", fixed(F.col("value") - F.col("blank")).alias("corrected"))


def rule_windows(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select(
        "o_orderpriority", "o_orderstatus", "o_totalprice",
        F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("day"))
    schema = T.StructType().add("o_orderpriority", "string").add("o_orderstatus", "string").add("day_lo", "integer").add("day_hi", "integer")
    rules = small_table(spark, WINDOWS, schema)
    kept = rule_window(orders, rules, ["o_orderpriority", "o_orderstatus"], "day")
    return kept.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("day").alias("day_sum"), fixed(F.sum("o_totalprice"), 2).alias("price_sum"))


def mean_sd_all(spark: SparkSession, sf: str) -> DataFrame:
    out = mean_sd(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], MEASURES)
    return fixed_all(out, [c for c in out.columns if c.endswith(("_mean", "_sd"))])


def peak_then_avg(spark: SparkSession, sf: str) -> DataFrame:
    best = peak(load(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "max_price")
    segments = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    out = mean_sd(add_covariates(best, segments, ["o_custkey"]), ["c_mktsegment"], ["max_price"])
    return fixed_all(out, ["max_price_mean", "max_price_sd"])


def _yearly(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("yr"))
    nations = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return orders.join(nations, "o_custkey").groupBy("c_nationkey", "yr").agg(
        F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n_orders"))


def _change(spark: SparkSession, sf: str) -> DataFrame:
    return endpoint_change(_yearly(spark, sf), ["c_nationkey"], F.col("yr") == 1995, F.col("yr") == 2001, "price", "n_orders")


def endpoint_changes(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_all(_change(spark, sf), ["change", "change_ratio"])


def endpoint_then_avg(spark: SparkSession, sf: str) -> DataFrame:
    named = _change(spark, sf).join(regions(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    out = mean_sd(named, ["region"], ["change", "change_ratio"])
    return fixed_all(out, ["change_mean", "change_sd", "change_ratio_mean", "change_ratio_sd"])


def loglinear_terms(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice",
                                              (_micros("o_orderdate") / F.lit(86_400e6 * 365)).alias("years"))
    fit = linear_fit(orders, ["o_orderpriority", "o_orderstatus"], "years", "o_totalprice", log_y=True)
    return fixed_all(fit, ["slope", "intercept", "slope_se", "intercept_se", "r2", "slope_t", "intercept_t", "slope_p", "intercept_p"])


def two_sample_tests(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice",
                                              F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("day"))
    segments = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    tests = two_sample(orders.join(segments, "o_custkey"), ["c_mktsegment"], "o_orderstatus", "F", "O", ["o_totalprice", "day"], conf_f=0.95)
    numbers = ["m1", "m2", "f", "t_pooled", "df_pooled", "t_welch", "df_welch", "t", "df", "p_f", "p_t", "f_lo", "f_hi"]
    return fixed_all(tests, numbers).select("c_mktsegment", "measure", "n1", "n2", "choice", *numbers)


def strict_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_orderkey", F.nullif(F.col("l_tax"), F.lit(0.08)).alias("tax"))
    return lines.groupBy("l_orderkey").agg(
        strict(F.max, "tax").alias("strict_max"), F.max("tax").alias("loose_max"),
        fixed(strict(F.sum, "tax")).alias("strict_sum"))


def figure_panels(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_type", "value", F.dayofmonth("ts").alias("day"))
    means = mean_sd(events, ["event_type", "day"], ["value"])
    early = figure_feed(means, "fig_early", "click", ["event_type", "day"], "value_mean", "value_sd",
                        (F.col("event_type") == "click") & (F.col("day") <= 10) & F.col("value_mean").isNotNull())
    late = figure_feed(means, "fig_late", "view", ["event_type", "day"], "value_mean", "value_sd",
                       (F.col("event_type") == "view") & F.col("day").isin(*range(20, 31)))
    return fixed_all(early.unionByName(late), ["mean", "lo", "hi"])


def ordered_levels(spark: SparkSession, sf: str) -> DataFrame:
    per = load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"))
    return level_rank(per, "o_orderpriority", PRIORITIES).orderBy("level_rank")


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_keys(load(spark, sf, "events"), ["user_id", "event_type"])


def melt_measures(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").select("l_returnflag", *MEASURES)
    long = melt(lines, ["l_returnflag"], MEASURES, "measure", "value")
    return long.groupBy("l_returnflag", "measure").agg(
        F.count("value").alias("n_cells"), fixed(F.sum("value"), 2).alias("total"), F.max("value").alias("top"))


QUERIES = {
    "growth_slope": growth_slope,
    "time_axis": time_axis,
    "blank_correct": blank_correct,
    "rule_window": rule_windows,
    "mean_sd_all": mean_sd_all,
    "peak_then_avg": peak_then_avg,
    "endpoint_change": endpoint_changes,
    "endpoint_then_avg": endpoint_then_avg,
    "loglinear_terms": loglinear_terms,
    "two_sample": two_sample_tests,
    "strict_aggregates": strict_aggregates,
    "figure_feed": figure_panels,
    "ordered_levels": ordered_levels,
    "duplicate_keys": repeated_keys,
    "melt": melt_measures,
}

FIGURE_SQL = f"""
WITH m AS (SELECT event_type, CAST(day(ts) AS INTEGER) AS day, avg(value) AS a, stddev_samp(value) AS s FROM events GROUP BY 1, 2)
SELECT CASE WHEN event_type = 'click' THEN 'fig_early' ELSE 'fig_late' END AS figure, event_type AS panel, event_type, day,
  {fx('a')} AS mean, {fx('a - s')} AS lo, {fx('a + s')} AS hi
FROM m WHERE (event_type = 'click' AND day <= 10) OR (event_type = 'view' AND day BETWEEN 20 AND 30)"""
_windows_sql = ", ".join(
    "(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in WINDOWS)
_years_sql = """
yearly AS (SELECT c_nationkey, year(o_orderdate) AS yr, avg(o_totalprice) AS price, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
change AS (SELECT a.c_nationkey, b.price - a.price AS change,
    (b.price - a.price) / nullif(b.n_orders - a.n_orders, 0) AS change_ratio
  FROM (SELECT DISTINCT c_nationkey FROM yearly) k
  LEFT JOIN yearly a ON a.c_nationkey = k.c_nationkey AND a.yr = 1995
  LEFT JOIN yearly b ON b.c_nationkey = k.c_nationkey AND b.yr = 2001)"""


def f_tail_sql(source: str, f: str, d1: str, d2: str, keys: str, out: str, steps: int = 20_000) -> str:
    """Lower tail of an F variable by the midpoint rule, after x = sin(theta)^2 in the beta integral."""
    return f"""
{out} AS (
  WITH edge AS (SELECT {keys}, {d1} AS d1, {d2} AS d2, asin(sqrt({d1} * {f} / ({d1} * {f} + {d2}))) AS th FROM {source}),
  nodes AS (SELECT e.*, s.lo + (s.hi - s.lo) * (g.i + 0.5) / {steps} AS x, (s.hi - s.lo) / {steps} AS h, s.part
    FROM edge e, LATERAL (SELECT 0.0 AS lo, e.th AS hi, 'low' AS part UNION ALL SELECT e.th, pi() / 2, 'high') s,
    (SELECT unnest(range({steps})) AS i) g),
  logs AS (SELECT *, (d1 - 1) * ln(sin(x)) + (d2 - 1) * ln(cos(x)) AS lg FROM nodes),
  peak AS (SELECT {keys}, max(lg) AS top FROM logs GROUP BY ALL)
  SELECT {keys}, sum(CASE WHEN part = 'low' THEN h * exp(lg - top) ELSE 0 END) / sum(h * exp(lg - top)) AS low,
    sum(CASE WHEN part = 'high' THEN h * exp(lg - top) ELSE 0 END) / sum(h * exp(lg - top)) AS high
  FROM logs JOIN peak USING ({keys}) GROUP BY {keys})"""


def f_quantile_sql(source: str, d1: str, d2: str, keys: str, probs: tuple[float, ...], out: str, steps: int = 200_000) -> str:
    """Quantiles q0, q1, ... of F variables: the running sum over the beta integral's steps, read backwards between two steps."""
    picks = ", ".join(f"arg_min(d2 / d1 * pow(tan((i + 1 - (cum - {p!r}) / w) * pi() / 2 / {steps}), 2), i) FILTER (cum >= {p!r}) AS q{k}" for k, p in enumerate(probs))
    return f"""
{out} AS (
  WITH node AS (SELECT {keys}, {d1} AS d1, {d2} AS d2, i, (i + 0.5) * pi() / 2 / {steps} AS x FROM {source}, (SELECT unnest(range({steps})) AS i) g),
  logs AS (SELECT *, (d1 - 1) * ln(sin(x)) + (d2 - 1) * ln(cos(x)) AS lg FROM node),
  share AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY {keys})) AS e FROM logs),
  part AS (SELECT *, e / sum(e) OVER (PARTITION BY {keys}) AS w FROM share),
  run AS (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY i) AS cum FROM part WHERE w > 0)
  SELECT {keys}, {picks} FROM run GROUP BY {keys})"""


ORACLES = {
    "growth_slope": f"""
WITH e AS (SELECT event_type, user_id, value, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400e6 AS d FROM events),
s AS (SELECT event_type, user_id, regr_slope(ln(value), d) AS mu FROM e WHERE value > 0 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT event_type, {fx('avg(mu)')} AS mu_mean, {fx('stddev_samp(mu)')} AS mu_sd FROM s GROUP BY 1""",
    "time_axis": f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, date_trunc('minute', min(ts)) AS a, date_trunc('minute', max(ts)) AS b FROM events GROUP BY 1),
m AS (SELECT day, a, (epoch_us(a) + epoch_us(b)) / 2.0 AS mid FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(a, '%-H:%M') AS tstart,
  {fx("(mid - (SELECT mid FROM m WHERE day = DATE '2024-01-01')) / 86400e6")} AS days_elapsed FROM m""",
    "blank_correct": f"""
SELECT event_id, {fx('value - avg(value) OVER (PARTITION BY CAST(ts AS DATE), event_type)')} AS corrected FROM events""",
    "rule_window": f"""
WITH r(p, s, lo, hi) AS (VALUES {_windows_sql}),
o AS (SELECT *, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders)
SELECT o_orderpriority, o_orderstatus, count(*) AS n_rows, CAST(sum(day) AS BIGINT) AS day_sum, {fx('sum(o_totalprice)', 2)} AS price_sum
FROM o WHERE EXISTS (SELECT 1 FROM r WHERE (r.p IS NULL OR r.p = o.o_orderpriority) AND (r.s IS NULL OR r.s = o.o_orderstatus)
  AND o.day BETWEEN r.lo AND r.hi) GROUP BY 1, 2""",
    "mean_sd_all": "SELECT l_returnflag, l_linestatus, " + ", ".join(
        f"{fx(f'avg({m})')} AS {m}_mean, {fx(f'stddev_samp({m})')} AS {m}_sd" for m in MEASURES) + " FROM lineitem GROUP BY 1, 2",
    "peak_then_avg": f"""
WITH b AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1)
SELECT c_mktsegment, {fx('avg(p)')} AS max_price_mean, {fx('stddev_samp(p)')} AS max_price_sd
FROM b JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "endpoint_change": f"WITH {_years_sql} SELECT c_nationkey, {fx('change')} AS change, {fx('change_ratio')} AS change_ratio FROM change",
    "endpoint_then_avg": f"""WITH {_years_sql}
SELECT r_name AS region, {fx('avg(change)')} AS change_mean, {fx('stddev_samp(change)')} AS change_sd,
  {fx('avg(change_ratio)')} AS change_ratio_mean, {fx('stddev_samp(change_ratio)')} AS change_ratio_sd
FROM change JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "loglinear_terms": f"""
WITH o AS (SELECT o_orderpriority, o_orderstatus, ln(o_totalprice) AS y, epoch_us(o_orderdate) / (86400e6 * 365) AS x FROM orders WHERE o_totalprice > 0),
c AS (SELECT o_orderpriority, o_orderstatus, avg(x) AS mx, avg(y) AS my FROM o GROUP BY 1, 2),
s AS (SELECT o_orderpriority, o_orderstatus, mx, my, count(*) AS n, sum((x - mx) * (x - mx)) AS sxx, sum((y - my) * (y - my)) AS syy, sum((x - mx) * (y - my)) AS sxy
  FROM o JOIN c USING (o_orderpriority, o_orderstatus) GROUP BY ALL),
v AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM s),
z AS (SELECT *, sxy / sxx / sqrt(s2 / sxx) AS st, (my - mx * sxy / sxx) / sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS it FROM v),
{f_tail_sql('z', '(st * st)', '1', '(n - 2)', 'o_orderpriority, o_orderstatus', 'sp', 200_000)},
{f_tail_sql('z', '(it * it)', '1', '(n - 2)', 'o_orderpriority, o_orderstatus', 'ip', 200_000)}
SELECT z.o_orderpriority, z.o_orderstatus, {fx('sxy / sxx')} AS slope, {fx('my - mx * sxy / sxx')} AS intercept, {fx('sqrt(s2 / sxx)')} AS slope_se,
  {fx('sqrt(s2 * (1.0 / n + mx * mx / sxx))')} AS intercept_se, {fx('sxy * sxy / sxx / syy')} AS r2, n,
  {fx('st')} AS slope_t, {fx('it')} AS intercept_t, {fx('sp.high')} AS slope_p, {fx('ip.high')} AS intercept_p
FROM z JOIN sp USING (o_orderpriority, o_orderstatus) JOIN ip USING (o_orderpriority, o_orderstatus)""",
    "two_sample": f"""
WITH raw AS (SELECT c_mktsegment, o_orderstatus AS arm, o_totalprice, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O')),
long AS (SELECT c_mktsegment, arm, 'o_totalprice' AS measure, o_totalprice AS v FROM raw UNION ALL SELECT c_mktsegment, arm, 'day', day FROM raw),
m AS (SELECT c_mktsegment, measure, count(v) FILTER (arm = 'F') AS n1, avg(v) FILTER (arm = 'F') AS m1, var_samp(v) FILTER (arm = 'F') AS v1,
    count(v) FILTER (arm = 'O') AS n2, avg(v) FILTER (arm = 'O') AS m2, var_samp(v) FILTER (arm = 'O') AS v2 FROM long GROUP BY 1, 2),
s AS (SELECT *, v1 / v2 AS f, CAST(n1 + n2 - 2 AS DOUBLE) AS df_pooled,
    (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t_pooled,
    (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t_welch,
    pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df_welch FROM m),
{f_tail_sql('s', 'f', '(n1 - 1)', '(n2 - 1)', 'c_mktsegment, measure', 'ft')},
w AS (SELECT s.*, least(1.0, 2 * least(low, high)) AS p_f FROM s JOIN ft USING (c_mktsegment, measure)),
x AS (SELECT *, CASE WHEN p_f < 0.05 THEN 'welch' ELSE 'pooled' END AS choice, CASE WHEN p_f < 0.05 THEN t_welch ELSE t_pooled END AS t,
    CASE WHEN p_f < 0.05 THEN df_welch ELSE df_pooled END AS df FROM w),
{f_tail_sql('x', '(t * t)', '1', 'df', 'c_mktsegment, measure', 'tt')},
{f_quantile_sql('x', '(n1 - 1)', '(n2 - 1)', 'c_mktsegment, measure', (0.025, 0.975), 'fq')}
SELECT c_mktsegment, measure, n1, n2, choice, """ + ", ".join(
        f"{fx(c)} AS {c}" for c in ["m1", "m2", "f", "t_pooled", "df_pooled", "t_welch", "df_welch", "t", "df", "p_f"])
    + f", {fx('high')} AS p_t, {fx('f / q1')} AS f_lo, {fx('f / q0')} AS f_hi FROM x JOIN tt USING (c_mktsegment, measure) JOIN fq USING (c_mktsegment, measure)",
    "strict_aggregates": f"""
WITH t AS (SELECT l_orderkey, nullif(l_tax, 0.08) AS tax FROM lineitem)
SELECT l_orderkey, CASE WHEN count(tax) = count(*) THEN max(tax) END AS strict_max, max(tax) AS loose_max,
  {fx('CASE WHEN count(tax) = count(*) THEN sum(tax) END')} AS strict_sum FROM t GROUP BY 1""",
    "figure_feed": FIGURE_SQL,
    "ordered_levels": "SELECT o_orderpriority, count(*) AS n_rows, CAST(6 - CAST(left(o_orderpriority, 1) AS INTEGER) AS INTEGER) AS level_rank FROM orders GROUP BY 1",
    "duplicate_keys": "SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "melt": f"""
SELECT l_returnflag, measure, count(value) AS n_cells, {fx('sum(value)', 2)} AS total, max(value) AS top
FROM (UNPIVOT (SELECT l_returnflag, {', '.join(MEASURES)} FROM lineitem) ON {', '.join(MEASURES)} INTO NAME measure VALUE value) GROUP BY 1, 2""",
}
