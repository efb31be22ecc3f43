"""Group ellipses of 2-D points, and non-metric scaling on a pair table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from assayframe.operators.ranking import BUCKET_ROWS, running_counts, value_table
from assayframe.session import durable, ship

#: Longer steps: how fast they grow, how long they may get, and after how many small ones in a row a map has settled.
GROWTH, MOST_LEAD, QUIET = 1.3, 6.0, 3


def group_ellipse(df: DataFrame, groups: Sequence[str], x: str, y: str, conf: float = 0.95) -> DataFrame:
    """Standard-deviation ellipse per group: centre, half axes and angle of the long axis.

    The 2 x 2 covariance is decomposed in closed form. The radius is the square root of the chi-square
    quantile with two degrees of freedom, which is ``-2 ln(1 - conf)``.
    """
    radius = math.sqrt(-2.0 * math.log(1.0 - conf))
    m = df.groupBy(*groups).agg(
        F.avg(x).alias("centre_x"), F.avg(y).alias("centre_y"),
        F.var_samp(x).alias("__a"), F.var_samp(y).alias("__b"), F.covar_samp(x, y).alias("__c"),
        F.count(F.lit(1)).alias("n"),
    )
    a, b, c = F.col("__a"), F.col("__b"), F.col("__c")
    mid = (a + b) / 2
    gap = F.sqrt((a - b) * (a - b) / 4 + c * c)
    return m.select(
        *groups, "n", "centre_x", "centre_y",
        (F.sqrt(mid + gap) * F.lit(radius)).alias("half_long"),
        (F.sqrt(F.greatest(mid - gap, F.lit(0.0))) * F.lit(radius)).alias("half_short"),
        (F.atan2(2 * c, a - b) / 2).alias("angle"),
    )


def _pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Group number of each value after pooling adjacent violators, so that group means do not fall.

    Each pass merges every falling run at once; runs that fall belong together in the final fit, whatever the order of merging.
    """
    sums, sizes, owner = values * weights, weights.astype(float), np.arange(len(values))
    while (fall := sums[:-1] * sizes[1:] > sums[1:] * sizes[:-1]).any():
        first = np.r_[True, ~fall]
        starts = np.flatnonzero(first)
        sums, sizes = np.add.reduceat(sums, starts), np.add.reduceat(sizes, starts)
        owner = (np.cumsum(first) - 1)[owner]
    return owner


def _pool_pairs(pairs: pd.DataFrame) -> pd.DataFrame:
    pairs = pairs.sort_values(["dist", "d"], kind="stable")
    d = pairs["d"].to_numpy(dtype=float)
    group = _pool(d, np.ones(len(d)))
    return pairs.assign(fit=(np.bincount(group, d) / np.bincount(group))[group])


def _pool_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool a sorted partition batch by batch; blocks are numbered on, and never reach over strata."""
    n = 0
    for batch in batches:
        for _, pairs in batch.groupby("strata", sort=False):
            group = _pool(pairs["d"].to_numpy(dtype=float), np.ones(len(pairs)))
            yield pairs.assign(block=group.astype(np.int64) + n)
            n += int(group[-1]) + 1


def _pool_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    blocks = blocks.sort_values("pos", kind="stable")
    group = _pool((blocks["s"] / blocks["w"]).to_numpy(), blocks["w"].to_numpy(dtype=float))
    first = blocks["pos"].to_numpy()[np.r_[True, np.diff(group) > 0]]
    return blocks.assign(to=first[group])[["strata", "pos", "to"]]


def _merge_blocks(blocks: DataFrame, task_rows: int) -> DataFrame:
    """Pool blocks across buckets: ``(strata, pos, root)``, exact for any number of blocks.

    Pooling adjacent violators in any order leads to the same result. While there are too many blocks for
    one task they are pooled in runs of neighbours, the runs shifted by half each round; once
    a round with few blocks left, or no violation anywhere, is reached the result is final.
    """
    schema = "strata string, pos long, to long"
    roots = durable(blocks.select("strata", "pos", F.col("pos").alias("root")))
    current = blocks.select("strata", "pos", "s", "w")
    quiet = 0
    for round_ in range(10_000):
        numbered = running_counts(value_table(current, "pos", ["strata"], {"s": F.sum("s"), "w": F.sum("w")}), "pos", ["strata"], task_rows)
        single = (numbered.agg(F.max("total")).head()[0] or 0) <= task_rows
        shift = 0 if single or round_ % 2 == 0 else task_rows // 2
        run = F.lit(0) if single else F.floor((F.col("before") + shift) / task_rows)
        moved = durable(numbered.select("strata", "pos", "s", "w", run.alias("run")).groupBy("strata", "run").applyInPandas(_pool_blocks, schema))
        changed = moved.filter("pos != to").limit(1).count()
        if changed:
            step = moved.withColumnsRenamed({"strata": "__m_strata", "pos": "__m_pos"})
            roots = durable(roots.join(step, (F.col("strata") == F.col("__m_strata")) & (F.col("root") == F.col("__m_pos"))).select(
                "strata", "pos", F.col("to").alias("root")))
            current = durable(current.join(moved, ["strata", "pos"]).groupBy("strata", F.col("to").alias("pos")).agg(F.sum("s").alias("s"), F.sum("w").alias("w")))
        quiet = 0 if changed else quiet + 1
        if single or quiet == 2:
            return roots
    raise RuntimeError("pooling did not settle")


def monotone_fit(pairs: DataFrame, buckets: int, task_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``fit``: the least-squares monotone regression of ``d`` on the order of ``dist``, per ``strata``.

    Pairs with equal ``dist`` are ordered by ``d``. More than one bucket: the pairs are cut into ranges of all their columns,
    ``dist`` and ``d`` first, so that equal distances, however many, are cut like others. Each range is pooled by itself,
    then blocks are pooled across ranges.
    """
    if buckets == 1:
        return pairs.groupBy("strata").applyInPandas(_pool_pairs, T.StructType([*pairs.schema.fields]).add("fit", "double"))
    order = ["strata", "dist", "d"]
    order += [c for c in pairs.columns if c not in order]
    dealt = pairs.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("bucket", F.spark_partition_id())
    local = durable(dealt.mapInPandas(_pool_sorted, T.StructType([*dealt.schema.fields]).add("block", "long")))
    pos = F.col("bucket").cast("long") * F.lit(1 << 40) + F.col("block")
    blocks = durable(local.groupBy("strata", pos.alias("pos")).agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("w")))
    roots = _merge_blocks(blocks, task_rows)
    sums = roots.join(blocks, ["strata", "pos"]).groupBy("strata", "root").agg((F.sum("s") / F.sum("w")).alias("fit"))
    fits = roots.join(sums, ["strata", "root"]).select(F.col("strata").alias("__strata"), F.col("pos").alias("__pos"), "fit")
    placed = local.withColumn("__at", pos)
    return placed.join(fits, (F.col("strata") == F.col("__strata")) & (F.col("__at") == F.col("__pos")), "left").drop("__strata", "__pos", "__at", "block", "bucket")


def _pivot_axis(both: DataFrame, names: DataFrame, axis: str) -> DataFrame:
    """One FastMap axis: projection on the line from the first sample to the one farthest from it."""
    start = names.groupBy("strata").agg(F.min("sample").alias("p1"))
    from_p1 = both.join(start, "strata").filter("s = p1").select("strata", "p1", F.col("o").alias("sample"), F.col("sq").alias("sq1"))
    far = from_p1.groupBy("strata").agg(F.max_by(F.struct("sample", "sq1"), F.struct("sq1", "sample")).alias("m")).select(
        "strata", F.col("m.sample").alias("p2"), F.col("m.sq1").alias("sq12"))
    from_p2 = both.join(far, "strata").filter("s = p2").select("strata", F.col("o").alias("sample"), F.col("sq").alias("sq2"))
    spots = (
        names.join(start, "strata").join(far, "strata")
        .join(from_p1.select("strata", "sample", "sq1"), ["strata", "sample"], "left")
        .join(from_p2, ["strata", "sample"], "left")
    )
    sq1, sq2 = F.coalesce("sq1", F.lit(0.0)), F.coalesce("sq2", F.lit(0.0))
    along = F.try_divide(sq1 + F.col("sq12") - sq2, 2 * F.sqrt("sq12"))
    return spots.select("strata", "sample", F.coalesce(along, F.lit(0.0)).alias(axis))


def _with_distance(pairs: DataFrame, coords: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        c = coords.select("strata", "start", F.col("sample").alias(f"sample_{side}"), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}"))
        pairs = pairs.join(c, ["strata", "start", f"sample_{side}"])
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    return pairs.withColumn("d", F.sqrt(dx * dx + dy * dy))


def _start_maps(base: DataFrame, names: DataFrame, starts: Sequence[int], seed: int) -> DataFrame:
    """``(strata, start, sample, x, y)``: start 0 is a FastMap projection, all others are drawn by a hash of start and sample."""
    both = base.select("strata", F.inline(F.array(
        F.struct(F.col("sample_a").alias("s"), F.col("sample_b").alias("o"), (F.col("dist") ** 2).alias("sq")),
        F.struct(F.col("sample_b").alias("s"), F.col("sample_a").alias("o"), (F.col("dist") ** 2).alias("sq")))))
    parts = []
    if 0 in starts:
        x = durable(_pivot_axis(both, names, "x"))
        gap = (
            both.join(x.select("strata", F.col("sample").alias("s"), F.col("x").alias("xs")), ["strata", "s"])
            .join(x.select("strata", F.col("sample").alias("o"), F.col("x").alias("xo")), ["strata", "o"])
            .withColumn("sq", F.greatest(F.col("sq") - (F.col("xs") - F.col("xo")) ** 2, F.lit(0.0)))
        )
        second = _pivot_axis(gap.select("strata", "s", "o", "sq"), names, "y")
        parts.append(x.join(second, ["strata", "sample"]).select("strata", F.lit(0).alias("start"), "sample", "x", "y"))
    if drawn := [k for k in starts if k]:
        at = lambda axis: F.pmod(F.xxhash64(F.lit(seed), "start", "strata", F.col("sample").cast("string"), F.lit(axis)), F.lit(1 << 52)) / F.lit(float(1 << 52)) - 0.5
        parts.append(names.withColumn("start", F.explode(F.array(*[F.lit(k) for k in drawn]))).select("strata", "start", "sample", at("x").alias("x"), at("y").alias("y")))
    return reduce(DataFrame.unionByName, parts)


def _run_in_task(steps: int, tolerance: float, extrapolate: bool):
    """All steps of one stratum and start whose pairs fit a task, by the formulas of ``_run_on_tables``."""
    def run(key: tuple, pairs: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        place = {v: i for i, v in enumerate(start["sample"])}
        a, b = (pairs[c].map(place).to_numpy() for c in ("sample_a", "sample_b"))
        dist, n = pairs["dist"].to_numpy(), len(place)
        count = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
        at = start[["x", "y"]].to_numpy()
        trace: list[float] = []
        plain = kept = held = None
        lead, quiet, settled = 1.0, 0, False
        for step in range(steps + 1):
            gap = at[a] - at[b]
            d = np.sqrt((gap**2).sum(axis=1))
            order = np.lexsort((d, dist))
            group = _pool(d[order], np.ones(len(d)))
            fit = np.empty(len(d))
            fit[order] = (np.bincount(group, d[order]) / np.bincount(group))[group]
            dd, ff = (d * d).sum(), (fit * fit).sum()
            stress = math.sqrt(((d - fit) ** 2).sum() / dd) if dd > 0 else 0.0
            if held is not None and stress > held and lead > 1:  # too far: back to the plain step
                trace.append(held)
                at, lead = plain, 1.0
                continue
            trace.append(stress)
            quiet = quiet + 1 if held is not None and held - stress < tolerance else 0
            if held is None or stress <= held or not extrapolate:
                kept = at
            if tolerance > 0 and quiet >= (QUIET if extrapolate else 1):
                settled = True
                break
            held = stress
            pull = np.divide(fit * math.sqrt(dd / ff) if ff > 0 else fit, d, out=np.zeros_like(d), where=d > 0)[:, None] * gap
            plain = np.stack([(np.bincount(a, pull[:, c], n) - np.bincount(b, pull[:, c], n)) / count for c in (0, 1)], axis=1)
            lead = min(lead * GROWTH, MOST_LEAD) if extrapolate else 1.0
            at = at + lead * (plain - at)
        return pd.DataFrame({"strata": key[0], "start": key[1], "settled": settled, "sample": start["sample"], "x": kept[:, 0], "y": kept[:, 1], "stress": [trace] * n})
    return run


def _run_on_tables(base: DataFrame, coords: DataFrame, steps: int, tolerance: float, extrapolate: bool, task_rows: int) -> DataFrame:
    """Steps over pairs of any number: coordinates are joined to the pairs, the monotone fit is pooled over ranges, every sample moves by one aggregation.

    A stratum and start that has settled takes no further part. State is one row per stratum and start.
    """
    keys = ["strata", "start"]
    buckets = max(1, math.ceil(base.count() / task_rows))
    starts = coords.select(*keys).distinct()
    state = durable(starts.select(*keys, F.lit(None).cast("double").alias("held"), F.lit(1.0).alias("lead"), F.lit(0).alias("quiet"), F.array().cast("array<double>").alias("trace"), F.lit(False).alias("settled")))
    coords = durable(coords.withColumns({"ux": F.col("x"), "uy": F.col("y"), "kx": F.col("x"), "ky": F.col("y")}))
    finished: list[DataFrame] = []
    wanted = QUIET if extrapolate else 1
    for step in range(steps + 1):
        placed = _with_distance(base.join(state.select(*keys), "strata"), coords)
        one = placed.withColumn("strata", F.concat_ws("\u0002", "strata", F.col("start").cast("string")))
        fitted = monotone_fit(one.select("strata", "sample_a", "sample_b", "dist", "xa", "ya", "xb", "yb", "d", "start"), buckets, task_rows)
        fitted = durable(fitted.withColumn("strata", F.substring_index("strata", "\u0002", 1)))
        sums = fitted.groupBy(*keys).agg(F.sum((F.col("d") - F.col("fit")) ** 2).alias("off"), F.sum(F.col("d") ** 2).alias("dd"), F.sum(F.col("fit") ** 2).alias("ff"))
        now = state.join(sums, keys).withColumn("stress", F.coalesce(F.sqrt(F.try_divide("off", "dd")), F.lit(0.0)))
        back = F.col("held").isNotNull() & (F.col("stress") > F.col("held")) & (F.col("lead") > 1)
        calm = F.when(F.col("held").isNotNull() & (F.col("held") - F.col("stress") < F.lit(tolerance)), F.col("quiet") + 1).otherwise(0)
        now = now.withColumns({"back": back, "better": F.col("held").isNull() | (F.col("stress") <= F.col("held")) | F.lit(not extrapolate), "quiet": F.when(back, F.col("quiet")).otherwise(calm)})
        now = durable(now.withColumns({
            "trace": F.concat("trace", F.array(F.when(F.col("back"), F.col("held")).otherwise(F.col("stress")))),
            "settled": ~F.col("back") & (F.col("quiet") >= wanted) & F.lit(tolerance > 0),
            "lead": F.when(F.col("back"), F.lit(1.0)).otherwise(F.least(F.col("lead") * GROWTH, F.lit(MOST_LEAD)) if extrapolate else F.lit(1.0)),
            "held": F.when(F.col("back"), F.col("held")).otherwise(F.col("stress")),
        }))
        pull = F.coalesce(F.try_divide(F.col("fit") * F.coalesce(F.sqrt(F.try_divide("dd", "ff")), F.lit(1.0)), F.col("d")), F.lit(0.0))
        dx, dy = (F.col("xa") - F.col("xb")) * pull, (F.col("ya") - F.col("yb")) * pull
        moves = fitted.join(now.select(*keys, "dd", "ff"), keys).select(*keys, F.inline(F.array(
            F.struct(F.col("sample_a").alias("sample"), dx.alias("mx"), dy.alias("my")),
            F.struct(F.col("sample_b").alias("sample"), (-dx).alias("mx"), (-dy).alias("my")))))
        moved = moves.groupBy(*keys, "sample").agg((F.sum("mx") / (F.count(F.lit(1)) + 1)).alias("px"), (F.sum("my") / (F.count(F.lit(1)) + 1)).alias("py"))
        joined = coords.join(moved, [*keys, "sample"]).join(now.select(*keys, "back", "better", "lead", "settled"), keys)
        step_of = lambda old, plain, u: F.when(F.col("back"), F.col(u)).otherwise(F.col(old) + F.col("lead") * (F.col(plain) - F.col(old)))
        coords = durable(joined.select(
            *keys, "sample", step_of("x", "px", "ux").alias("x"), step_of("y", "py", "uy").alias("y"),
            F.when(F.col("back"), F.col("ux")).otherwise(F.col("px")).alias("ux"), F.when(F.col("back"), F.col("uy")).otherwise(F.col("py")).alias("uy"),
            F.when(~F.col("back") & F.col("better"), F.col("x")).otherwise(F.col("kx")).alias("kx"), F.when(~F.col("back") & F.col("better"), F.col("y")).otherwise(F.col("ky")).alias("ky"),
            "settled"))
        over = F.lit(True) if step == steps else F.col("settled")
        finished.append(coords.filter(over).join(now.select(*keys, "trace"), keys).select(*keys, "sample", F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("trace").alias("stress"), "settled"))
        state = now.filter("NOT settled").select(*state.columns)
        if step == steps or state.isEmpty():
            break
        coords = coords.filter("NOT settled").drop("settled")
    return durable(reduce(DataFrame.unionByName, finished))


def _scaled(base: DataFrame, names: DataFrame, starts: Sequence[int], steps: int, tolerance: float, extrapolate: bool, task_rows: int, seed: int) -> DataFrame:
    """``(strata, start, sample, x, y, stress: one per step, settled)``, as a written table."""
    coords = _start_maps(base, names, starts, seed)
    largest = base.groupBy("strata").count().agg(F.max("count")).head()[0] or 0
    if largest > task_rows:
        return _run_on_tables(base, coords, steps, tolerance, extrapolate, task_rows)
    schema = T.StructType([T.StructField("strata", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("settled", T.BooleanType()),
                           names.schema["sample"], T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("stress", T.ArrayType(T.DoubleType()))])
    left = base.withColumn("start", F.explode(F.array(*[F.lit(k) for k in starts]))).groupBy("strata", "start")
    return durable(left.cogroup(coords.groupBy("strata", "start")).applyInPandas(_run_in_task(steps, tolerance, extrapolate), schema))


def _named(pairs: DataFrame, strata: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs under one text key per stratum; their samples; the strata of a key."""
    ship(pairs.sparkSession)
    key = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in strata]) if strata else F.lit("")
    named = pairs.filter("dist IS NOT NULL").select(key.alias("strata"), *[F.col(k).alias(f"__{k}") for k in strata], "sample_a", "sample_b", F.round("dist", 12).alias("dist"))
    base = durable(named)
    lookup = base.select("strata", *[F.col(f"__{k}").alias(k) for k in strata]).distinct()
    base = base.select("strata", "sample_a", "sample_b", "dist")
    names = durable(base.select("strata", F.explode(F.array("sample_a", "sample_b")).alias("sample")).distinct())
    return base, names, lookup


def _principal(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``axis1``, ``axis2``: each map centred and turned to its principal axes, beside all columns of ``maps``."""
    middle = maps.groupBy(*keys).agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y")) / 2).alias("turn"))
    u, v, turn = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.coalesce("turn", F.lit(0.0))
    return maps.join(middle, list(keys)).withColumns({"axis1": u * F.cos(turn) + v * F.sin(turn), "axis2": v * F.cos(turn) - u * F.sin(turn)}).drop("cx", "cy", "turn")


def nonmetric_scaling(
    pairs: DataFrame,
    steps: int = 200,
    strata: Sequence[str] = (),
    task_rows: int = BUCKET_ROWS,
    tolerance: float = 1e-5,
    extrapolate: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Two-dimensional non-metric scaling of a pair table by majorisation, from a FastMap projection.

    A stratum ends when a step lowers its stress by less than ``tolerance``, or after ``steps`` steps: a trace of ``steps`` + 1 rows has not
    settled. With a tolerance of 0 all steps are taken. ``extrapolate`` lengthens the steps while they lower the stress and goes back to the plain step where
    one does not; a stratum then ends after ``QUIET`` such small steps in a row.

    Returns ``(strata, sample, axis1, axis2)``, centred and turned to its principal axes, and ``(strata, step, stress)`` with one row per step. A stratum whose
    pairs fit a task takes all steps there; larger ones take theirs over tables, to the same result.
    """
    base, names, lookup = _named(pairs, strata)
    maps = _scaled(base, names, [0], steps, tolerance, extrapolate, task_rows, 0)
    points = _principal(maps, ["strata"]).join(lookup, "strata").select(*strata, "sample", "axis1", "axis2")
    trace = maps.groupBy("strata").agg(F.first("stress").alias("stress")).select("strata", F.posexplode("stress").alias("step", "stress"))
    return points, trace.join(lookup, "strata").select(*strata, "step", "stress")


def procrustes(maps: DataFrame, key: str, target: DataFrame, points: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """How well each map of ``maps`` can be laid on the target map of its stratum by shift, turn, mirror image and scale.

    ``maps`` has ``key``, ``target`` has not; both have the columns of ``strata`` and ``points``, and ``x`` and ``y``. Both maps are centred and scaled to a sum of squares of one, so
    the result is the same either way round. Returns ``(strata, key, n, turn, mirrored, scale, rmse)``: target = scale * turned map. All of it comes from sums:
    the four products of the coordinates hold the turn and the fit in closed form.
    """
    at = [*strata, *points]
    both = maps.select(*at, key, F.col("x").alias("u"), F.col("y").alias("v")).join(target.select(*at, "x", "y"), at)
    s = both.groupBy(*strata, key).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("u", "x").alias("ux"), F.covar_pop("u", "y").alias("uy"), F.covar_pop("v", "x").alias("vx"), F.covar_pop("v", "y").alias("vy"),
        (F.var_pop("u") + F.var_pop("v")).alias("uu"), (F.var_pop("x") + F.var_pop("y")).alias("xx"))
    turned = F.sqrt((F.col("ux") + F.col("vy")) ** 2 + (F.col("uy") - F.col("vx")) ** 2)
    mirror = F.sqrt((F.col("ux") - F.col("vy")) ** 2 + (F.col("uy") + F.col("vx")) ** 2)
    s = s.withColumns({"mirrored": mirror > turned, "best": F.greatest(turned, mirror)})
    turn = F.when(F.col("mirrored"), F.atan2(F.col("uy") + F.col("vx"), F.col("ux") - F.col("vy"))).otherwise(F.atan2(F.col("uy") - F.col("vx"), F.col("ux") + F.col("vy")))
    # A map that is one point explains nothing of the target.
    left = F.greatest(1 - F.coalesce(F.try_divide(F.col("best") ** 2, F.col("uu") * F.col("xx")), F.lit(0.0)), F.lit(0.0))
    return s.select(*strata, key, "n", turn.alias("turn"), "mirrored", F.try_divide("best", "uu").alias("scale"), F.sqrt(left / F.col("n")).alias("rmse"))


def best_scaling(
    pairs: DataFrame,
    strata: Sequence[str] = (),
    batch: int = 10,
    most: int = 40,
    steps: int = 2000,
    tolerance: float = 1e-7,
    alike: float = 0.01,
    seed: int = 0,
    task_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Non-metric scaling from many starts; the map of the smallest stress in each stratum.

    Starts are a key of the same jobs, ``batch`` at a time. A stratum is done when another start has led to the same map as the best one (a root mean square
    difference of at most ``alike`` after ``procrustes``), or after ``most`` starts.

    Returns ``(strata, sample, axis1, axis2)`` of the best map and ``(strata, start, stress, steps, settled, rmse, best, agreed)`` for each start: its last stress, whether it ended by
    tolerance, its difference from the best map, and whether the stratum's best map was found twice.
    """
    base, names, lookup = _named(pairs, strata)
    maps = ends = None
    left = names
    for low in range(0, most, batch):
        found = _scaled(base.join(left.select("strata").distinct(), "strata", "left_semi"), left, range(low, min(most, low + batch)), steps, tolerance, True, task_rows, seed)
        maps = found if maps is None else durable(maps.unionByName(found))
        each = maps.groupBy("strata", "start").agg(F.element_at(F.first("stress"), -1).alias("stress"), (F.size(F.first("stress")) - 1).alias("steps"), F.first("settled").alias("settled"))
        top = each.groupBy("strata").agg(F.min(F.struct("stress", "start"))["start"].alias("start"))
        best = durable(maps.join(top, ["strata", "start"]))
        fits = procrustes(maps, "start", best, ["sample"], ["strata"]).select("strata", "start", "rmse")
        marked = each.join(fits, ["strata", "start"]).join(top.withColumn("best", F.lit(True)), ["strata", "start"], "left").withColumn("best", F.coalesce("best", F.lit(False)))
        same = marked.groupBy("strata").agg(F.max(~F.col("best") & (F.col("rmse") <= alike)).alias("agreed"))
        ends = durable(marked.join(same, "strata"))
        left = durable(names.join(ends.filter("NOT agreed").select("strata").distinct(), "strata", "left_semi"))
        if left.isEmpty():
            break
    points = _principal(best, ["strata"]).join(lookup, "strata").select(*strata, "sample", "axis1", "axis2")
    return points, ends.join(lookup, "strata").select(*strata, "start", "stress", "steps", "settled", "rmse", "best", "agreed")
