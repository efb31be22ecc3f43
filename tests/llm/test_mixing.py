from collections import defaultdict
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from assayframe.llm import mixing


def fill(budget, nodes):
    """Share by weight with capacities, one level, by repeated rounds: {name: (weight, can)} -> {name: tokens}."""
    out, live, left = {}, dict(nodes), budget
    while True:
        total = sum(w for w, _ in live.values())
        full = {k: can for k, (w, can) in live.items() if can * total <= w * left}
        if not full:
            break
        out.update(full)
        left -= sum(full.values())
        live = {k: v for k, v in live.items() if k not in full}
    total = sum(w for w, _ in live.values())
    return out | {k: int(Fraction(w * left, total)) for k, (w, _) in live.items()}


def test_fill_and_tree(spark):
    leaves = [("a", "x", 100), ("a", "y", 5), ("b", "x", 10), ("b", "z", 0), ("c", "q", 1000)]
    df = spark.createDataFrame(leaves, "g string, s string, tokens long")
    weight = F.lit(1).cast("bigint")
    got = {(r.g, r.s): r.budget for r in mixing.budgets(df, ["g", "s"], [weight, weight], F.lit(400).cast("bigint"), 2).collect()}
    top = fill(400, {"a": (1, 210), "b": (1, 20), "c": (1, 2000)})
    want = {}
    for g in "abc":
        want |= {(g, s): v for s, v in fill(top[g], {s: (1, 2 * t) for gg, s, t in leaves if gg == g}).items()}
    assert got == want
    assert want["b", "x"] == 20 and want["a", "y"] == 10 and want["a", "x"] == 180  # siblings first, then the other branches


def test_query_matches_sql_on_odd_rows(spark, docs_of, tmp_path):
    rows = [(i, "word " * (i % 9), ["en", "fr", None, "xx"][i % 4], ["s1", "s2", None, "hot", "hot", "hot"][i % 6]) for i in range(120)]
    rows += [(200, None, None, None), (200, "a\tb  c\x0b", "en", "hot"), (200, "a\tb  c\x0b", "en", "hot"), (None, "x y", "en", "s1")]
    df = docs_of(rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(mixing.ORACLE)
    got = mixing.mix_documents(df)
    assert sorted(got.columns) == sorted(rel.columns)
    want = sorted((tuple(r[rel.columns.index(c)] for c in got.columns) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    used = defaultdict(int)
    for r in got.collect():
        used["all"] += r.tokens * r.copies
        assert 0 <= r.copies <= 2
    assert used["all"] > 0


def test_stage_and_empty(docs_of):
    df = docs_of([(i, "some words here " * (i % 3 + 1), "en", f"s{i % 4}") for i in range(40)])
    out = mixing.apply_mix(df)
    assert out.columns == df.columns and 0 < out.count() <= 80
    assert mixing.mix_documents(docs_of([])).collect() == [] and mixing.apply_mix(docs_of([])).collect() == []
