import hashlib
from math import comb

import numpy as np
import pandas as pd
import pytest

from assayframe.operators.distance import bray_curtis
from assayframe.operators.permutation import anosim, anosim_r, exact_relabelings, random_relabelings


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i:02d}", f"f{j}", float(rng.integers(0, 6) + (4 if i % 3 == j % 3 else 0))) for i in range(12) for j in range(8)]
    cells = spark.createDataFrame(rows, "sample string, feature string, v double")
    labels = {f"s{i:02d}": "xyz"[i % 3] for i in range(12)}
    samples = spark.createDataFrame(list(labels.items()), "sample string, label string")
    return cells, samples, labels


def r_of(pairs, labels):
    rank = pd.Series([d for _, _, d in pairs]).rank().to_numpy()
    same = np.array([labels[a] == labels[b] for a, b, _ in pairs])
    return (rank[~same].mean() - rank[same].mean()) / (len(pairs) / 2)


@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 7, "block_samples": 4}])
def test_anosim_against_brute_force(spark, study, limits):
    cells, samples, labels = study
    pairs = bray_curtis(cells, "sample", "feature", "v")
    drawn = random_relabelings(samples, "sample", "label", 49, seed=4)
    decks = {}
    for r in drawn.collect():
        decks.setdefault(r.perm_id, {})[r.sample] = r.label
    for k, deck in decks.items():
        names = sorted(labels)
        order = sorted(names, key=lambda s: hashlib.md5(f"4|{k}|{s}".encode()).hexdigest())
        assert deck == {s: labels[names[i]] for i, s in enumerate(order)}
    local = [(r.sample_a, r.sample_b, round(r.dist, 12)) for r in pairs.collect()]
    want = r_of(local, labels)
    above = sum(r_of(local, deck) >= want - 1e-12 for deck in decks.values())
    got = anosim(pairs, samples, "sample", "label", drawn, **limits).head()
    assert abs(got.r - want) < 1e-12 and -1 <= got.r <= 1
    assert got.p_value == (1 + above) / 50 and got.n_perm == 49 and got.n_pairs == comb(12, 2)
    alone = anosim_r(pairs, samples, "sample", "label", bucket_rows=limits.get("bucket_rows", 10**6)).head()
    assert abs(alone.r - want) < 1e-12


def test_exact_relabelings_are_the_distinct_splits(spark):
    rows = [("p", f"s{i}", "ab"[i % 2]) for i in range(6)] + [("q", f"t{i}", "a" if i < 2 else "b") for i in range(5)]
    got = exact_relabelings(spark.createDataFrame(rows, "st string, sample string, arm string"), "sample", "arm", ["st"]).collect()
    for st, n, k, mirrored in (("p", 6, 3, True), ("q", 5, 2, False)):
        splits = {}
        for r in got:
            if r.st == st:
                splits.setdefault(r.perm_id, {})[r.sample] = r.arm
        assert len(splits) == comb(n, k) // (2 if mirrored else 1) - 1
        assert sorted(splits) == list(range(1, len(splits) + 1))
        seen = {r[1]: r[2] for r in rows if r[0] == st}
        as_sets = {frozenset(s for s, a in d.items() if a == "a") for d in [*splits.values(), seen]}
        if mirrored:
            as_sets = {min(s, frozenset(seen) - s, key=sorted) for s in as_sets}
        assert len(as_sets) == len(splits) + 1
        sizes = sorted(list(seen.values()).count(a) for a in "ab")
        assert all(sorted(list(d.values()).count(a) for a in "ab") == sizes for d in splits.values())


def test_supplied_relabelings(spark, study):
    cells, samples, labels = study
    pairs = bray_curtis(cells, "sample", "feature", "v")
    names = sorted(labels)
    rows = [(k, s, labels[names[(i + k) % 12]]) for k in (1, 2) for i, s in enumerate(names)]
    given = spark.createDataFrame(rows, "perm_id int, sample string, label string")
    local = [(r.sample_a, r.sample_b, round(r.dist, 12)) for r in pairs.collect()]
    want = r_of(local, labels)
    above = sum(r_of(local, {s: lab for k, s, lab in rows if k == p}) >= want - 1e-12 for p in (1, 2))
    assert anosim(pairs, samples, "sample", "label", given).head().p_value == (1 + above) / 3


def test_exact_relabelings_refuse_three_arms(spark):
    rows = [(f"s{i}", "abc"[i % 3]) for i in range(6)]
    with pytest.raises(ValueError):
        exact_relabelings(spark.createDataFrame(rows, "sample string, arm string"), "sample", "arm")


def test_exact_splits_have_no_sample_limit(spark):
    from math import comb

    from assayframe.operators.permutation import exact_relabelings

    rows = [("big", f"s{i:02d}", "a" if i in (3, 17, 29) else "b") for i in range(30)] + [("even", f"t{i}", "ab"[i % 2]) for i in range(6)]
    got = exact_relabelings(spark.createDataFrame(rows, "g string, sample string, arm string"), "sample", "arm", ["g"]).collect()
    seen = {g: {s: arm for gg, s, arm in rows if gg == g} for g in ("big", "even")}
    for g, total in (("big", comb(30, 3) - 1), ("even", comb(6, 3) // 2 - 1)):
        splits = {}
        for r in got:
            if r.g == g:
                splits.setdefault(r.perm_id, {})[r.sample] = r.arm
        assert sorted(splits) == list(range(1, total + 1))
        assert len({tuple(sorted(s.items())) for s in splits.values()}) == total and seen[g] not in splits.values()
        assert all(sorted(s.values()) == sorted(seen[g].values()) for s in splits.values())


def test_relabelings_must_be_complete(spark):
    import pytest

    from assayframe.operators.permutation import anosim

    names = ["a", "b", "c", "d"]
    pairs = spark.createDataFrame([(x, y, 0.1 * i) for i, (x, y) in enumerate((x, y) for x in names for y in names if x < y)], "sample_a string, sample_b string, dist double")
    samples = spark.createDataFrame([(n, n < "c") for n in names] + [("a", True)], "sample string, label boolean")
    whole = [(p, n, (n < "c") ^ (p == 1 and n in "bc")) for p in (1, 2) for n in names]
    assert anosim(pairs, samples, "sample", "label", spark.createDataFrame(whole, "perm_id int, sample string, label boolean")).head().n_perm == 2
    for bad in (whole[1:], [*whole[1:], whole[5]], [(p + 1, *r) for p, *r in whole]):
        with pytest.raises(ValueError):
            anosim(pairs, samples, "sample", "label", spark.createDataFrame(bad, "perm_id int, sample string, label boolean"))
