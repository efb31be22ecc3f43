"""Mixing sources to target weights through a domain-language-source tree.

Budgets go down the tree. A node shares its budget among its children by weight; a child never gets more than it can give
(its tokens times the epochs allowed), and what it lacks goes to its siblings by weight. A node can give what its leaves can
give together, so a shortage is met by the nearest siblings first and reaches another branch only when
a whole branch runs dry. All shares are whole tokens.

A leaf then takes whole epochs of its rows and, of the next epoch, the prefix that fits, in the order of a seeded hash of
the epoch and the row. The running sum over that order is taken in hash slices: only the slice that
holds the cut is summed row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from assayframe.llm.common import durable, whole_row

WORDS = "[\\x20\\x09-\\x0D]+"
#: Hex digits of the order hash that name a slice: 16^3 slices per leaf.
SLICE_DIGITS = 3


def words(text: Column) -> Column:
    """Number of words between white space; 0 for null or blank text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WORDS))).cast("bigint")


def weight(column: str, weights: Mapping[str, int], other: int) -> Column:
    """Whole-number weight of a level's value; ``other`` where it is not named."""
    w = F.lit(other)
    for value, n in weights.items():
        w = F.when(F.col(column) == value, n).otherwise(w)
    return w.cast("bigint")


def fill(nodes: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Share ``budget`` (of the parent, on each row) among children by ``weight`` up to ``can``; adds ``share``.

    Children are taken in order of can / weight. One whose fair part of what is left exceeds ``can`` gets ``can``; from the
    first that does not, all get their fair part. Children of weight 0 get nothing.
    """
    live = F.col("weight") > 0
    by = W.partitionBy(*parent).orderBy(F.when(live, F.col("can") / F.col("weight")), child)
    behind = by.rowsBetween(W.unboundedPreceding, -1)
    big = "decimal(38,0)"
    left = F.col("budget") - F.coalesce(F.sum(F.when(live, F.col("can"))).over(behind), F.lit(0))
    nodes = nodes.withColumn("_rest", F.sum(F.when(live, F.col("weight")).otherwise(0)).over(by.rowsBetween(0, W.unboundedFollowing)))
    nodes = nodes.withColumn("_left", left).withColumn(
        "_full", live & (F.col("can").cast(big) * F.col("_rest").cast(big) <= F.col("weight").cast(big) * F.col("_left").cast(big)))
    first = F.first(F.when(live & ~F.col("_full"), F.struct("_left", "_rest")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    nodes = nodes.withColumn("_first", first)
    fair = F.expr("cast(cast(weight as decimal(38,0)) * cast(_first._left as decimal(38,0)) div cast(_first._rest as decimal(38,0)) as bigint)")
    return nodes.withColumn("share", F.when(~live, 0).when(F.col("_full"), F.col("can")).otherwise(fair).cast("bigint")).drop("_rest", "_left", "_full", "_first")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], target: Column, epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with their ``budget`` in tokens; ``target`` is an expression over ``total``, the tokens of all leaves."""
    tree = leaves.withColumn("can", (F.col("tokens") * epochs).cast("bigint"))
    total = tree.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("can"), F.lit(0)).alias("all"))
    above, parent = total.select(F.least(target, F.col("all")).cast("bigint").alias("budget")), []
    for depth, level in enumerate(levels):
        here = tree.groupBy(*levels[: depth + 1]).agg(F.sum("can").alias("can")).withColumn("weight", weights[depth])
        # The total is one row.
        here = here.join(above, parent) if parent else here.crossJoin(F.broadcast(above))
        filled = fill(here, parent, level)
        parent = list(levels[: depth + 1])
        above = filled.select(*parent, F.col("share").alias("budget"))
    return leaves.join(above, list(levels))


def mix(rows: DataFrame, levels: Sequence[str], weights: Sequence[Column], target: Column, epochs: int = 2, seed: int = 7, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``rows`` (key, levels, tokens; one per document, levels not null) with ``copies``: how often the mix takes it, 0 if never."""
    rows = durable(rows)
    leaves = rows.groupBy(*levels).agg(F.sum(tokens).alias("tokens"))
    leaves = durable(budgets(leaves, levels, weights, target, epochs).select(
        *levels, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("_epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("_rest")))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "_epochs", F.coalesce(F.col(key).cast("string"), F.lit(""))))
    drawn = durable(rows.join(leaves, list(levels)).withColumn("_order", order).withColumn("_slice", F.substring("_order", 1, SLICE_DIGITS)))
    sums = drawn.groupBy(*levels, "_slice").agg(F.sum(tokens).alias("_sum"))
    sums = sums.withColumn("_through", F.sum("_sum").over(W.partitionBy(*levels).orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)))
    sums = durable(sums.join(leaves, list(levels)).select(*levels, "_slice", (F.col("_through") - F.col("_sum")).alias("_before"), ((F.col("_through") <= F.col("_rest")) & (F.col("_rest") > 0)).alias("_in")))
    seen = drawn.join(sums, [*levels, "_slice"])
    inside = W.partitionBy(*levels, "_slice").orderBy("_order", key, tokens).rowsBetween(W.unboundedPreceding, 0)
    cut = ~F.col("_in") & (F.col("_before") <= F.col("_rest")) & (F.col("_rest") > 0)
    # Rows of the one slice that holds the cut are summed one by one; the others are decided by their slice.
    plain = seen.where(~cut).withColumn("_taken", F.col("_in"))
    at_cut = seen.where(cut).withColumn("_taken", F.col("_before") + F.sum(tokens).over(inside) <= F.col("_rest"))
    return plain.unionByName(at_cut).select(key, *levels, tokens, (F.col("_epochs") + F.when(F.col("_taken"), 1).otherwise(0)).cast("int").alias("copies"))


#: Production parameters: sources are dealt into four domains by a hash of their name; weights are parts of the whole.
DOMAINS, DOMAIN_WEIGHTS = 4, {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS, OTHER = {"en": 4, "de": 2, "fr": 2, "es": 2}, 1
LEVELS = ("domain", "lang", "source")
EPOCHS, SEED = 2, 7


def _tree(docs: DataFrame, *keep: Column) -> DataFrame:
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(*keep, F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int") % DOMAINS).cast("string")).alias("domain"),
                       F.coalesce(F.col("lang"), F.lit("")).alias("lang"), source.alias("source"), words(F.col("text")).alias("tokens"))


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    weights = [weight("domain", DOMAIN_WEIGHTS, OTHER), weight("lang", LANG_WEIGHTS, OTHER), F.lit(1).cast("bigint")]
    return mix(rows, LEVELS, weights, F.expr("total * 3 div 4"), EPOCHS, SEED, key)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents' mix with the production parameters: doc_id, domain, lang, source, tokens, copies for every row.

    The target is three quarters of all tokens, a row is taken twice at most. A null source or language is the empty one; null text
    has no tokens, is no leaf's shortage, and is taken when it lies in the prefix. Rows with one id have one place in the order; of equal rows
    any may fall behind the cut. An empty table gives an empty table.
    """
    return _mixed(_tree(docs, F.col("doc_id")), "doc_id")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with all their columns.

    A row is known by a hash of its id and text; identical rows are taken alike.
    """
    key = F.xxhash64("doc_id", "text")
    copies = _mixed(_tree(docs, key.alias("key")), "key").groupBy("key").agg(F.max("copies").alias("copies")).where("copies > 0")
    kept = whole_row(docs, key=key).join(copies, "key")
    return kept.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{folder}/documents.parquet"))


def _level_sql(name: str, levels: Sequence[str], above: str) -> str:
    """SQL of one level: the same sharing by weight with running sums."""
    parent, child = list(levels[:-1]), levels[-1]
    value = {"domain": "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DOMAIN_WEIGHTS.items()) + f" ELSE {OTHER} END",
             "lang": "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items()) + f" ELSE {OTHER} END", "source": "1"}[child]
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    keys = ", ".join(levels)
    return f"""
{name}_a AS (SELECT {keys}, sum(can)::HUGEINT AS can, ({value})::HUGEINT AS weight FROM leaves GROUP BY {keys}),
{name}_b AS (SELECT {keys}, can, weight, budget,
    budget - coalesce(sum(can) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER w AS rn
  FROM {name}_a {join} WINDOW w AS ({part} ORDER BY can::DOUBLE / weight::DOUBLE, {child})),
{name}_c AS (SELECT *, can * rest <= weight * remaining AS complete FROM {name}_b),
{name}_d AS (SELECT *, min(CASE WHEN NOT complete THEN rn END) OVER ({part}) AS f FROM {name}_c),
{name}_e AS (SELECT *, max(CASE WHEN rn = f THEN remaining END) OVER ({part}) AS r0, max(CASE WHEN rn = f THEN rest END) OVER ({part}) AS w0 FROM {name}_d),
{name} AS (SELECT {keys}, CASE WHEN complete THEN can ELSE weight * r0 // w0 END AS budget FROM {name}_e)"""


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, 'domain' || (('0x' || substr(md5(source), 1, 1))::INTEGER % {DOMAINS}) AS domain, lang, source, tokens FROM (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents)),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {EPOCHS} AS can FROM t GROUP BY ALL),
root AS (SELECT least(sum(tokens) * 3 // 4, sum(can)) AS budget FROM leaves),
{_level_sql('l1', LEVELS[:1], 'root')},
{_level_sql('l2', LEVELS[:2], 'l1')},
{_level_sql('l3', LEVELS[:3], 'l2')},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaves JOIN l3 USING (domain, lang, source)),
placed AS (SELECT t.*, epochs, rest, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM t JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, (epochs + CASE WHEN sum(tokens) OVER (
  PARTITION BY domain, lang, source ORDER BY place, doc_id, tokens ROWS UNBOUNDED PRECEDING) <= rest AND rest > 0 THEN 1 ELSE 0 END)::INTEGER AS copies
FROM placed
"""
