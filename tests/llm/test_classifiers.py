import zlib

import numpy as np
import pytest

from assayframe.llm import boosting, quality, toxicity

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query,column,least", [(toxicity.op6_toxicity, "toxic", 0.93), (quality.op8_quality, "quality", 0.97)])
def test_held_out_accuracy(spark, query, column, least):
    got = {r.doc_id: r for r in query(spark, D).collect()}
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= (0.7 if column == "toxic" else 0.5)) for r in got.values())
    held = [(got[r.doc_id].predicted, r[column]) for r in spark.read.parquet(f"{D}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) >= least


def test_odd_rows(spark, docs_of):
    rows = [(i, f"you are a {'moron' if i % 2 else 'reader'} number {i}") for i in range(200)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)] + [(5, 0, None), (999, 1, 1), (None, 1, 1), (7, None, 3)], "doc_id long, toxic int, quality int")
    odd = docs_of([(1, None), (2, ""), (3, "!!! ..."), (4, "you are a m0ron now"), (None, "you moron"), (4, "you moron"), (4, "you moron"), (6, "a clean text " * 50_000)])
    tox = toxicity.fit(toxicity.training_rows(docs, labels, "toxic", 100))
    got = toxicity.score(odd, tox.scores, 0.7).collect()
    assert len(got) == 8 and {r.predicted for r in got if r.doc_id in (1, 2, 3, 6)} == {0} and {r.predicted for r in got if r.doc_id in (4, None)} == {1}
    good = quality.fit(toxicity.training_rows(docs, labels, "quality", 100))
    got = toxicity.score(odd, good.scores, 0.5).collect()
    assert len(got) == 8 and {r.predicted for r in got if r.doc_id is None} == {0}
    none = labels.limit(0)
    for fit, column in ((toxicity.fit, "toxic"), (quality.fit, "quality")):
        flat = fit(toxicity.training_rows(docs, none, column, 100))
        assert {r.score for r in toxicity.score(odd, flat.scores, 0.5).collect()} == {0.5}
        assert toxicity.score(docs_of([]), flat.scores, 0.5).collect() == []


def test_trees_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.fit_trees(x[:2000], y[:2000])
    margin = m.margin(x[2000:])
    assert ((margin > 0) == y[2000:]).mean() > 0.95
    iso = boosting.fit_isotonic(margin, y[2000:])
    s = iso(np.sort(margin))
    assert (np.diff(s) >= 0).all() and 0 <= s.min() and s.max() <= 1


def test_isotonic_is_the_least_squares_fit():
    y = np.array([0, 1, 0, 0, 1, 1, 0, 1.0])
    iso = boosting.fit_isotonic(np.arange(8.0), y, prior=0)
    assert np.allclose(iso.share, [0, 1 / 3, 2 / 3, 1]) and np.allclose(iso.at, [0, 2, 5, 7])


@pytest.mark.parametrize("word,plain", [("m0r0n", "moron"), ("id!ot", "idiot"), ("m.o.r.o.n", "moron"), ("$tupid!!", "stupid")])
def test_disguised_words_are_revealed(word, plain):
    assert plain in toxicity.revealed(word)
