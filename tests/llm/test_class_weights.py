import numpy as np
import pytest

from assayframe.llm import boosting, quality, toxicity

PROBES = ["you moron said the reader of this page", "you friend said the reader of this page"]


@pytest.mark.parametrize("fit,column", [(toxicity.fit, "toxic"), (quality.fit, "quality")])
def test_scores_do_not_depend_on_the_bound(spark, docs_of, fit, column):
    rng = np.random.default_rng(6)
    label = rng.random(6000) < 0.1
    sign = rng.random(6000) < np.where(label, 0.8, 0.08)  # a text with the sign is of class 1 by about one half

    def filled(text):  # other words, so that few texts have equal features
        return text + "".join(f" {'day' * rng.integers(1, 4)}{',!?. '[rng.integers(5)]} {'A' if rng.random() < 0.3 else 'a'}{rng.integers(10**6)}" for _ in range(rng.integers(1, 25)))

    docs = docs_of([(i, filled(PROBES[0 if s else 1])) for i, s in enumerate(sign)])
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(label)], f"doc_id long, {column} int")
    probes = [filled(p) for p in PROBES for _ in range(200)]
    above, below = (np.reshape(fit(toxicity.training_rows(docs, labels, column, bound)).scores(probes), (2, 200)).mean(axis=1) for bound in (5000, 350))
    assert abs(above[0] - 0.53) < 0.15 and np.abs(above - below).max() < 0.15, (above, below)


def test_weighted_isotonic_is_the_fit_of_repeated_rows():
    margin, y = np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0])
    weight = np.where(y == 0, 3, 1)
    iso, many = boosting.fit_isotonic(margin, y, weight=weight), boosting.fit_isotonic(margin.repeat(weight), y.repeat(weight))
    grid = np.linspace(-1, 6, 50)
    assert np.allclose(iso(grid), many(grid))
