from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_brute import best_overlap, tokens

from assayframe.llm.decontaminate import WINDOW, drop_overlapping, masks_for, overlaps

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


def bench(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id long, text string, w int")


def test_substitutions_and_brute_force(spark, docs_of):
    words = ITEM.split()

    def change(*at):
        return "Before it: " + " ".join("x" if i in at else w for i, w in enumerate(words)) + ", after it."

    texts = [change(), change(3, 9), change(2, 5, 8, 11, 14), change(1, 12), ITEM.upper().replace(" ", " - "), "one two three four five six seven", None, "", "other words altogether " * 9, ITEM]
    rows = list(enumerate(texts)) + [(9, ITEM), (None, ITEM)]
    items = [(7, ITEM), (3, ITEM), (5, "short text"), (6, None), (8, "alpha beta gamma delta epsilon zeta eta")]
    rows.append((20, "say Alpha beta gamma delta epsilon zeta eta, now"))
    got = sorted(((r.doc_id, r.item_id, r.overlap) for r in overlaps(docs_of(rows), bench(spark, items), F.xxhash64("doc_id", "text")).collect()), key=repr)
    want = set()
    for d, t in rows:
        for i, item in ((3, ITEM), (8, items[4][1])):
            n, size = best_overlap(t, item)
            if n and n >= 0.8 * size:
                want.add((d, i, n))
    assert got == sorted(want, key=repr) and (1, 3, 12) in want and (20, 8, 7) in want and not any(d == 5 for d, *_ in want)


def test_blocks_do_not_matter(spark, docs_of):
    items = [(i, " ".join(f"w{(i * 7 + k) % 53}" for k in range(20))) for i in range(30)]
    rows = [(i, "see " + items[i % 30][1] + " end") for i in range(40)]
    df, b = docs_of(rows), bench(spark, items)
    one = sorted(map(tuple, overlaps(df, b, F.xxhash64("doc_id")).collect()))
    assert one and sorted(map(tuple, overlaps(df, b, F.xxhash64("doc_id"), block=100).collect())) == one


def test_empty_sides_and_stage(spark, docs_of):
    df = docs_of([(1, ITEM), (2, "clean text"), (None, ITEM), (None, "clean"), (2, "clean text")])
    kept = drop_overlapping(df, bench(spark, [(1, ITEM)]))
    assert kept.columns == df.columns and sorted((r.text for r in kept.collect())) == ["clean", "clean text", "clean text"]
    assert drop_overlapping(df, bench(spark, [])).count() == 5
    assert drop_overlapping(docs_of([]), bench(spark, [(1, ITEM)])).count() == 0


def all_diagonals(text, item, window=13):
    """Most agreeing words of a stretch along any diagonal, with or without a seed."""
    w, t = tokens(text), tokens(item)
    size = min(window, len(t))
    return max((sum(t[j + k] == w[i + k] for k in range(size)) for i in range(len(w) - size + 1) for j in range(len(t) - size + 1)), default=0), size


@pytest.mark.parametrize("share", [0.8, 0.6])
def test_short_texts_and_shares_against_all_diagonals(spark, docs_of, share):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 18])]
    rows = []
    for i, item in items:
        words = item.split()
        for e in range(min(len(words), 6)):
            for at in list(combinations(range(len(words)), e))[::max(1, e * e)][:40]:
                rows.append((len(rows), " ".join(["so", *("x" if k in at else w for k, w in enumerate(words)), "on"][rng.integers(0, 2):])))
    got = {(r.doc_id, r.item_id, r.overlap) for r in overlaps(docs_of(rows), bench(spark, items), F.xxhash64("doc_id", "text"), share=share).collect()}
    want = {(d, i, n) for d, t in rows for i, item in items for n, size in [all_diagonals(t, item)] if n >= size * share}
    assert got == want


@pytest.mark.parametrize("share", [1.0, 0.8, 0.7, 0.5, 0.1])
def test_every_admitted_stretch_holds_a_seed(share):
    for size in range(1, WINDOW + 1):
        masks = masks_for(size, share)
        for e in range(size + 1):
            if size - e >= size * share:
                assert all(any(not at & {p + o for o in m} for m in masks for p in range(size - m[-1])) for at in map(set, combinations(range(size), e)))


def test_share_out_of_range(spark, docs_of):
    with pytest.raises(ValueError):
        overlaps(docs_of([]), bench(spark, []), F.col("doc_id"), share=0)
