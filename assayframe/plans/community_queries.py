"""Registered queries on abundance tables: shares, roll-ups, distances and permutation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe.operators.distance import bray_curtis
from assayframe.operators.ordination import best_scaling, group_ellipse, nonmetric_scaling, procrustes
from assayframe.operators.permutation import anosim, anosim_r, exact_relabelings, random_relabelings
from assayframe.operators.ranking import average_rank
from assayframe.operators.reshape import renormalise, share_in_group, spread
from assayframe.operators.summarize import richness, rollup_rare, share_of_total
from assayframe.plans.tables import (
    ABUND_SQL, SPLIT_SQL, abund, abund_by_supplier, fixed, fixed_all, fixed_sql as fx, load, regions, split_counts,
)
from assayframe.session import durable

PERMUTATIONS, SEED = 999, 7
SCALING_STEPS = 20
ROLLUP_PCT = 4.0
ROLLUP = {"Other_low": ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6"], "Other_mid": ["Brand#11", "Brand#12", "Brand#13"]}


def richness_by_sample(spark: SparkSession, sf: str) -> DataFrame:
    cells = abund_by_supplier(spark, sf)
    return richness(cells.withColumn("n", F.col("n") - 2), ["sample"], "n")


def share_in_sample(spark: SparkSession, sf: str) -> DataFrame:
    shares = share_in_group(abund(spark, sf), ["sample"], "n", ["feature"])
    return shares.select("sample", "feature", fixed("share", 9).alias("share"))


def share_total(spark: SparkSession, sf: str) -> DataFrame:
    out = share_of_total(abund(spark, sf), ["brand"], "n")
    return out.select("brand", "total", fixed("share_pct").alias("share_pct"))


def renormalised(spark: SparkSession, sf: str) -> DataFrame:
    out = renormalise(abund(spark, sf), ~F.col("family").isin("PROMO", "SMALL"), ["sample"], "n", ["feature"])
    return out.select("sample", "feature", fixed("n", 9).alias("abundance"))


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollup_rare(abund(spark, sf), "sample", "brand", "n", ROLLUP_PCT, ROLLUP)


def transpose(spark: SparkSession, sf: str) -> DataFrame:
    renamed = abund(spark, sf).withColumn("col", F.concat(F.lit("s"), F.col("sample")))
    return spread(renamed, ["feature"], "col", [f"s{i}" for i in range(25)], "n")


def _nation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return bray_curtis(durable(abund(spark, sf)), "sample", "feature", "n")


def bray(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_all(_nation_pairs(spark, sf), ["dist"], 9)


def bray_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_all(bray_curtis(durable(abund_by_supplier(spark, sf)), "sample", "feature", "n"), ["dist"], 9)


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).withColumnRenamed("n_nationkey", "sample")


def anosim_stat(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _nation_pairs(spark, sf)
    return fixed_all(anosim_r(pairs, _nations(spark, sf), "sample", "region"), ["r"])


def relabelings(spark: SparkSession, sf: str) -> DataFrame:
    return random_relabelings(_nations(spark, sf), "sample", "region", PERMUTATIONS, SEED)


def anosim_perm(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _nation_pairs(spark, sf)
    out = anosim(pairs, _nations(spark, sf), "sample", "region", relabelings(spark, sf))
    return fixed_all(out, ["r", "p_value"])


def exact_splits(spark: SparkSession, sf: str) -> DataFrame:
    samples = split_counts(spark, sf).select("region", "sample", "arm").distinct()
    return exact_relabelings(samples, "sample", "arm", ["region"])


def anosim_exact(spark: SparkSession, sf: str) -> DataFrame:
    cells = durable(split_counts(spark, sf))
    samples = cells.select("region", "sample", "arm").distinct()
    pairs = bray_curtis(cells, "sample", "feature", "n", ["region"])
    out = anosim(pairs, samples, "sample", "arm", exact_relabelings(samples, "sample", "arm", ["region"]), ["region"])
    return fixed_all(out, ["r", "p_value"])


def _vector_maps(spark: SparkSession, sf: str) -> DataFrame:
    """(label, vec_id, pair, x, y): every vector as one point in each plane of two neighbouring components."""
    planes = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda k: F.struct(
        k.alias("pair"), F.get("embedding", 2 * k).cast("double").alias("x"), F.get("embedding", 2 * k + 1).cast("double").alias("y")))
    return load(spark, sf, "embeddings").select("label", "vec_id", F.inline(planes))


def ellipse(spark: SparkSession, sf: str) -> DataFrame:
    out = group_ellipse(_vector_maps(spark, sf), ["label", "pair"], "x", "y")
    return fixed_all(out, ["centre_x", "centre_y", "half_long", "half_short", "angle"])


def procrustes_fit(spark: SparkSession, sf: str) -> DataFrame:
    maps = _vector_maps(spark, sf)
    out = procrustes(maps.filter("pair > 0"), "pair", maps.filter("pair = 0").drop("pair"), ["vec_id"], ["label"])
    return fixed_all(out, ["turn", "scale", "rmse"])


def avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 100).cast("double").alias("v"))
    return average_rank(orders, "v", ["o_orderpriority"], salt_on=["o_orderkey"]).select("o_orderkey", "avg_rank")


def _map(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return nonmetric_scaling(_nation_pairs(spark, sf), steps=SCALING_STEPS, tolerance=0)


def nmds_points(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_all(_map(spark, sf)[0], ["axis1", "axis2"])


def nmds_stress(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_all(_map(spark, sf)[1], ["stress"])


def _best(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return best_scaling(_nation_pairs(spark, sf))


def nmds_map(spark: SparkSession, sf: str) -> DataFrame:
    """The settled map of the smallest stress, with the ellipse of each region's samples on it."""
    points = durable(_best(spark, sf)[0].join(_nations(spark, sf), "sample"))
    return fixed_all(points.join(group_ellipse(points, ["region"], "axis1", "axis2"), "region"), ["axis1", "axis2", "centre_x", "centre_y", "half_long", "half_short", "angle"])


def nmds_starts(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_all(_best(spark, sf)[1], ["stress", "rmse"])


QUERIES = {
    "richness": richness_by_sample,
    "share_in_sample": share_in_sample,
    "share_total": share_total,
    "renormalise": renormalised,
    "rollup_rare": rollup,
    "transpose": transpose,
    "bray_curtis": bray,
    "bray_curtis_suppliers": bray_suppliers,
    "anosim_r": anosim_stat,
    "relabelings": relabelings,
    "anosim_perm": anosim_perm,
    "exact_splits": exact_splits,
    "anosim_exact": anosim_exact,
    "ellipse": ellipse,
    "avg_rank": avg_rank,
    "nmds_points": nmds_points,
    "nmds_stress": nmds_stress,
    "nmds_map": nmds_map,
    "nmds_starts": nmds_starts,
    "procrustes": procrustes_fit,
}

_SUPP = """
cells AS (SELECT l_suppkey AS sample, p_brand || '|' || p_type AS feature, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _axis_sql(name: str, pairs: str, axis: str) -> str:
    """One start axis: projection on the line from the first sample to the one farthest from it."""
    return f"""
{name}_from AS MATERIALIZED (SELECT o AS sample, sq FROM {pairs} WHERE s = (SELECT min(s) FROM {pairs})),
{name}_far AS MATERIALIZED (SELECT sample AS p2, sq AS sq12 FROM {name}_from ORDER BY sq DESC, sample DESC LIMIT 1),
{name} AS MATERIALIZED (SELECT n.sample, coalesce((coalesce(f.sq, 0) + sq12 - coalesce(g.sq, 0)) / nullif(2 * sqrt(sq12), 0), 0) AS {axis}
  FROM (SELECT DISTINCT s AS sample FROM {pairs}) n CROSS JOIN {name}_far LEFT JOIN {name}_from f ON f.sample = n.sample
  LEFT JOIN {pairs} g ON g.s = p2 AND g.o = n.sample)"""


def _step_sql(t: int) -> str:
    """One step: distances of the map, the monotone fit by its max-min formula, stress, and the moves."""
    return f"""
placed{t} AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM (
    SELECT sample_a, sample_b, dist, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d
    FROM rounded JOIN map{t} a ON a.sample = sample_a JOIN map{t} b ON b.sample = sample_b) WINDOW w AS (ORDER BY dist, d)),
least{t} AS MATERIALIZED (SELECT i.rn AS i, j.rn AS rn, min((j.c - i.c + i.d) / (j.rn - i.rn + 1)) OVER (PARTITION BY i.rn ORDER BY j.rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g
  FROM placed{t} i JOIN placed{t} j ON j.rn >= i.rn),
fit{t} AS MATERIALIZED (SELECT p.*, f.fit FROM placed{t} p JOIN (SELECT rn, max(g) AS fit FROM least{t} GROUP BY 1) f USING (rn)),
sums{t} AS MATERIALIZED (SELECT sum((d - fit) ** 2) AS off, sum(d ** 2) AS dd, sum(fit ** 2) AS ff FROM fit{t}),
move{t} AS MATERIALIZED (SELECT sample_a, sample_b, dx * coalesce(fit * sqrt(dd / ff) / nullif(d, 0), 0) AS mx, dy * coalesce(fit * sqrt(dd / ff) / nullif(d, 0), 0) AS my FROM fit{t}, sums{t}),
map{t + 1} AS MATERIALIZED (SELECT sample, sum(mx) / (count(*) + 1) AS x, sum(my) / (count(*) + 1) AS y FROM (
    SELECT sample_a AS sample, mx, my FROM move{t} UNION ALL SELECT sample_b, -mx, -my FROM move{t}) GROUP BY 1)"""


def _scaling_sql() -> str:
    steps = ",".join(_step_sql(t) for t in range(SCALING_STEPS + 1))
    return f"""WITH {ABUND_SQL}, {_dense_pairs('abund')},
rounded AS MATERIALIZED (SELECT sample_a, sample_b, round(dist, 12) AS dist FROM pairs),
both1 AS MATERIALIZED (SELECT sample_a AS s, sample_b AS o, dist ** 2 AS sq FROM rounded UNION ALL SELECT sample_b, sample_a, dist ** 2 FROM rounded),
{_axis_sql('first', 'both1', 'x')},
both2 AS MATERIALIZED (SELECT s, o, greatest(sq - (a.x - b.x) ** 2, 0) AS sq FROM both1 JOIN first a ON a.sample = s JOIN first b ON b.sample = o),
{_axis_sql('second', 'both2', 'y')},
map0 AS MATERIALIZED (SELECT sample, x, y FROM first JOIN second USING (sample)),{steps}"""


def _dense_pairs(source: str, strata: str = "") -> str:
    """Distances on the dense grid, in the absolute-difference form."""
    s = f"{strata}, " if strata else ""
    on = f"AND a.{strata} = b.{strata}" if strata else ""
    using = f"USING ({strata})" if strata else "ON TRUE"
    return f"""
grid AS (SELECT {s}s.sample, f.feature, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {s}sample FROM {source}) s
  JOIN (SELECT DISTINCT {s}feature FROM {source}) f {using} LEFT JOIN {source} c USING ({s}sample, feature)),
pairs AS (SELECT {'a.' + s if s else ''}a.sample AS sample_a, b.sample AS sample_b, sum(abs(a.n - b.n)) * 1.0 / sum(a.n + b.n) AS dist
  FROM grid a JOIN grid b ON a.feature = b.feature AND a.sample < b.sample {on} GROUP BY ALL)"""


_PLANES = """SELECT label, vec_id, CAST(k AS INTEGER) AS pair, CAST(embedding[2 * k + 1] AS DOUBLE) AS x, CAST(embedding[2 * k + 2] AS DOUBLE) AS y
  FROM (SELECT label, vec_id, embedding, unnest(range(len(embedding) // 2)) AS k FROM embeddings)"""
_RANKED = """
ranked AS (SELECT sample_a, sample_b, rank() OVER (ORDER BY round(dist, 12)) + (count(*) OVER (PARTITION BY round(dist, 12)) - 1) / 2.0 AS rk FROM pairs)"""
_NATION = "nat AS (SELECT n_nationkey AS sample, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"
_DEAL = f"""
pos AS (SELECT sample, region, row_number() OVER (ORDER BY sample) AS i FROM nat),
draw AS (SELECT p.perm_id, sample, row_number() OVER (PARTITION BY p.perm_id ORDER BY md5('{SEED}|' || p.perm_id || '|' || sample), sample) AS i
  FROM nat, (SELECT CAST(unnest(range(1, {PERMUTATIONS + 1})) AS INTEGER) AS perm_id) p),
deal AS (SELECT perm_id, draw.sample, pos.region FROM draw JOIN pos USING (i))"""
_R = "((n * (n + 1) / 2.0 - w) / (n - k) - w / k) / (n / 2.0)"
_SPLITS = """
smp AS (SELECT DISTINCT region, sample, arm FROM split),
pos AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY sample) - 1 AS i FROM smp),
head AS (SELECT region, arm AS first_arm FROM pos WHERE i = 0),
seen AS (SELECT region, CAST(sum(CASE WHEN arm = first_arm THEN 1 << i ELSE 0 END) AS BIGINT) AS mask FROM pos JOIN head USING (region) GROUP BY 1),
masks AS (SELECT s.region, m.mask, CAST(row_number() OVER (PARTITION BY s.region ORDER BY m.mask) AS INTEGER) AS perm_id
  FROM seen s, (SELECT unnest(range(64)) AS mask) m WHERE bit_count(m.mask) = 3 AND m.mask % 2 = 1 AND m.mask <> s.mask),
splits AS (SELECT p.region, perm_id, sample,
  CASE WHEN (mask >> i) & 1 = 1 THEN first_arm ELSE CASE WHEN first_arm = 'F' THEN 'O' ELSE 'F' END END AS arm
  FROM masks m JOIN pos p ON m.region = p.region JOIN head h ON h.region = p.region)"""
_labels_sql = " ".join(f"WHEN brand IN ({', '.join(repr(b) for b in members)}) THEN '{name}'" for name, members in ROLLUP.items())

ORACLES = {
    "richness": f"WITH {_SUPP} SELECT sample, count(*) FILTER (n > 2) AS richness FROM cells GROUP BY 1",
    "share_in_sample": f"WITH {ABUND_SQL} SELECT sample, feature, {fx('n / sum(n) OVER (PARTITION BY sample)', 9)} AS share FROM abund",
    "share_total": f"WITH {ABUND_SQL} SELECT brand, CAST(sum(n) AS BIGINT) AS total, {fx('100.0 * sum(n) / (SELECT sum(n) FROM abund)')} AS share_pct FROM abund GROUP BY 1",
    "renormalise": f"WITH {ABUND_SQL} SELECT sample, feature, {fx('n / sum(n) OVER (PARTITION BY sample)', 9)} AS abundance FROM abund WHERE family NOT IN ('PROMO', 'SMALL')",
    "rollup_rare": f"""WITH {ABUND_SQL},
lab AS (SELECT brand, CASE WHEN 100.0 * sum(n) / (SELECT sum(n) FROM abund) > {ROLLUP_PCT} THEN brand {_labels_sql} ELSE 'Other' END AS legend_label FROM abund GROUP BY 1)
SELECT sample, legend_label, CAST(sum(n) AS BIGINT) AS n FROM abund JOIN lab USING (brand) GROUP BY 1, 2""",
    "transpose": f"WITH {ABUND_SQL} SELECT feature, " + ", ".join(f"max(CASE WHEN sample = {i} THEN n END) AS s{i}" for i in range(25)) + " FROM abund GROUP BY 1",
    "bray_curtis": f"WITH {ABUND_SQL}, {_dense_pairs('abund')} SELECT sample_a, sample_b, {fx('dist', 9)} AS dist FROM pairs",
    "bray_curtis_suppliers": f"WITH {_SUPP}, {_dense_pairs('cells')} SELECT sample_a, sample_b, {fx('dist', 9)} AS dist FROM pairs",
    "anosim_r": f"""WITH {ABUND_SQL}, {_dense_pairs('abund')}, {_RANKED}, {_NATION},
t AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN a.region = b.region THEN rk ELSE 0 END) AS w, CAST(count(*) FILTER (a.region = b.region) AS DOUBLE) AS k
  FROM ranked JOIN nat a ON a.sample = sample_a JOIN nat b ON b.sample = sample_b)
SELECT {fx(_R)} AS r, CAST(n AS BIGINT) AS n_pairs, CAST(k AS BIGINT) AS n_within FROM t""",
    "relabelings": f"WITH {_NATION}, {_DEAL} SELECT perm_id, sample, region FROM deal",
    "anosim_perm": f"""WITH {ABUND_SQL}, {_dense_pairs('abund')}, {_RANKED}, {_NATION}, {_DEAL},
every AS (SELECT 0 AS perm_id, sample, region FROM nat UNION ALL SELECT perm_id, sample, region FROM deal),
t AS (SELECT a.perm_id, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN a.region = b.region THEN rk ELSE 0 END) AS w, CAST(count(*) FILTER (a.region = b.region) AS DOUBLE) AS k
  FROM ranked JOIN every a ON a.sample = sample_a JOIN every b ON b.sample = sample_b AND b.perm_id = a.perm_id GROUP BY 1),
s AS (SELECT perm_id, n, {_R} AS r FROM t), o AS (SELECT r AS seen FROM s WHERE perm_id = 0)
SELECT {fx('max(seen)')} AS r, {fx('(1.0 + count(*) FILTER (perm_id > 0 AND r >= seen)) / (1 + count(*) FILTER (perm_id > 0))')} AS p_value,
  count(*) FILTER (perm_id > 0) AS n_perm, CAST(max(n) AS BIGINT) AS n_pairs FROM s, o""",
    "exact_splits": f"WITH {SPLIT_SQL}, {_SPLITS} SELECT region, perm_id, sample, arm FROM splits",
    "anosim_exact": f"""WITH {SPLIT_SQL}, {_SPLITS}, {_dense_pairs('split', 'region')},
ranked AS (SELECT region, sample_a, sample_b, rank() OVER (PARTITION BY region ORDER BY round(dist, 12)) + (count(*) OVER (PARTITION BY region, round(dist, 12)) - 1) / 2.0 AS rk FROM pairs),
every AS (SELECT region, 0 AS perm_id, sample, arm FROM smp UNION ALL SELECT region, perm_id, sample, arm FROM splits),
t AS (SELECT q.region, a.perm_id, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN a.arm = b.arm THEN rk ELSE 0 END) AS w, CAST(count(*) FILTER (a.arm = b.arm) AS DOUBLE) AS k
  FROM ranked q JOIN every a ON a.sample = sample_a AND a.region = q.region JOIN every b ON b.sample = sample_b AND b.region = q.region AND b.perm_id = a.perm_id GROUP BY ALL),
s AS (SELECT region, perm_id, n, {_R} AS r FROM t), o AS (SELECT region, r AS seen FROM s WHERE perm_id = 0)
SELECT region, {fx('max(seen)')} AS r, {fx('(1.0 + count(*) FILTER (perm_id > 0 AND r >= seen)) / (1 + count(*) FILTER (perm_id > 0))')} AS p_value,
  count(*) FILTER (perm_id > 0) AS n_perm, CAST(max(n) AS BIGINT) AS n_pairs FROM s JOIN o USING (region) GROUP BY region""",
    "ellipse": f"""
WITH p AS ({_PLANES}),
m AS (SELECT label, pair, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM p GROUP BY 1, 2),
e AS (SELECT *, (a + b) / 2 AS mid, sqrt((a - b) * (a - b) / 4 + c * c) AS gap, sqrt(-2 * ln(1 - 0.95)) AS rad FROM m)
SELECT label, pair, n, {fx('cx')} AS centre_x, {fx('cy')} AS centre_y, {fx('rad * sqrt(mid + gap)')} AS half_long,
  {fx('rad * sqrt(greatest(mid - gap, 0))')} AS half_short, {fx('atan2(2 * c, a - b) / 2')} AS angle FROM e""",
    "procrustes": f"""
WITH p AS ({_PLANES}),
s AS (SELECT label, m.pair, count(*) AS n, covar_pop(m.x, t.x) AS ux, covar_pop(m.x, t.y) AS uy, covar_pop(m.y, t.x) AS vx, covar_pop(m.y, t.y) AS vy,
  var_pop(m.x) + var_pop(m.y) AS uu, var_pop(t.x) + var_pop(t.y) AS xx FROM p m JOIN p t USING (label, vec_id) WHERE m.pair > 0 AND t.pair = 0 GROUP BY 1, 2),
f AS (SELECT *, sqrt((ux + vy) ** 2 + (uy - vx) ** 2) AS turned, sqrt((ux - vy) ** 2 + (uy + vx) ** 2) AS flipped FROM s)
SELECT label, pair, n, {fx('CASE WHEN flipped > turned THEN atan2(uy + vx, ux - vy) ELSE atan2(uy - vx, ux + vy) END')} AS turn, flipped > turned AS mirrored,
  {fx('greatest(turned, flipped) / uu')} AS scale, {fx('sqrt(greatest(1 - greatest(turned, flipped) ** 2 / (uu * xx), 0) / n)')} AS rmse FROM f""",
    "nmds_points": f"""{_scaling_sql()},
mid AS (SELECT avg(x) AS cx, avg(y) AS cy, coalesce(atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2, 0) AS turn FROM map{SCALING_STEPS})
SELECT sample, {fx('(x - cx) * cos(turn) + (y - cy) * sin(turn)')} AS axis1, {fx('(y - cy) * cos(turn) - (x - cx) * sin(turn)')} AS axis2 FROM map{SCALING_STEPS}, mid""",
    "nmds_stress": _scaling_sql() + " UNION ALL ".join(f" SELECT {t}::INTEGER AS step, {fx('sqrt(off / nullif(dd, 0))')} AS stress FROM sums{t}" for t in range(SCALING_STEPS + 1)),
    "avg_rank": """
WITH o AS (SELECT o_orderkey, o_orderpriority AS p, floor(o_totalprice / 100) AS v FROM orders)
SELECT o_orderkey, rank() OVER (PARTITION BY p ORDER BY v) + (count(*) OVER (PARTITION BY p, v) - 1) / 2.0::DOUBLE AS avg_rank FROM o""",
}
