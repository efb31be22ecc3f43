"""The three classifiers' scores worked out one n-gram, piece and word at a time."""

import math
from collections import Counter

import numpy as np
import pytest

from assayframe.llm import langid, quality, toxicity

MASK = (1 << 64) - 1
TEXTS = ["Der Hund und die Katze, 12 Mal!", "the dog AND the cat sat", "el perro y el gato", "le chien ET le chat ñandú", "und und the the", "ß 漢字 Ärger", "x", "the cat? und!! el", "12345 !!!", "", None,
         "you stupid m0r0n you", "s t u p i d people you know", "what a St*pid, stupid idea!!", "STUPIDLY done by your friend", "A nice day. Really nice day"]


def grams_of(text):
    """Every n-gram of the text's letters, runs of other characters as one blank."""
    plain, last = " ", " "
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            plain += c
        last = c
    plain = plain if plain.endswith(" ") else plain + " "
    return [plain[i:i + n] for n in langid.ORDERS for i in range(len(plain) - n + 1)] if plain.strip() else []


def bucket_of(gram):
    h = len(gram)
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & MASK
        h ^= h >> 29
    return (h >> 7) & (langid.BUCKETS - 1)


def test_language_against_dictionary_counts(docs_of):
    known = [(1, TEXTS[0], "de"), (2, TEXTS[1], "en"), (3, TEXTS[2], "es"), (4, TEXTS[3], "fr"), (5, TEXTS[4], "de"), (6, TEXTS[5], "de"), (None, "the end of it", "en"), (7, None, "en"), (8, "no language", None)]
    counts = {}
    for _, text, lang in known:
        if lang and text is not None:
            counts.setdefault(lang, Counter()).update(map(bucket_of, grams_of(text)))
    model = langid.fit(docs_of(known).where("lang IS NOT NULL"))
    assert model.langs == sorted(counts)
    got = {r.doc_id: r for r in langid.identify(docs_of(list(enumerate(TEXTS))), model, *[langid.F.col("doc_id")]).collect()}
    for i, text in enumerate(TEXTS):
        found = grams_of(text)
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = {lang: sum(math.log((c[bucket_of(g)] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * langid.BUCKETS)) for g in found) for lang, c in counts.items()}
        best = max(logs, key=lambda k: (logs[k], [-ord(x) for x in k]))
        assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-4


def pieces_of(word):
    m = int(quality.MULTIPLIER)
    marked = f"<{word}>"
    sums = [sum(ord(c) * pow(m, k + 1, 1 << 64) for k, c in enumerate(marked))]
    sums += [n + sum(ord(c) * pow(m, k + 1, 1 << 64) for k, c in enumerate(marked[i:i + n])) for n in quality.ORDERS for i in range(len(marked) - n + 1)]
    return [((((h & MASK) ^ ((h & MASK) >> 29)) * m & MASK) >> 40) & (quality.BUCKETS - 1) for h in sums]


def test_quality_against_averages_of_pieces():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=(quality.BUCKETS, 2)), np.array([0.2, -0.3]))
    for text, got in zip(TEXTS, model.scores(TEXTS)):
        words = (text or "").split()
        words = words + [quality.REPEAT for a, b in zip(words, words[1:]) if a == b]
        value = [np.mean([model.piece[b, 1] - model.piece[b, 0] for b in pieces_of(w)]) for w in words]
        assert abs(got - 1 / (1 + math.exp(0.5 - (np.mean(value) if value else 0.0)))) < 1e-9


LEXICON = {"stupid": 2.0, "stup*": 1.5, "moron": 3.0, "idea": 0.5, "people": 0.25}


def match_of(word):
    """(kind of match, weight) of a bare word."""
    starts = [LEXICON[e] for e in LEXICON if e.endswith("*") and word.startswith(e[:-1]) and len(word) > len(e) - 1]
    if word in LEXICON:
        return "word", max([LEXICON[word], *starts])
    return ("start", max(starts)) if starts else (None, 0.0)


def features_of(text):
    raw = (text or "").split()
    if not raw:
        return [0.0] * len(toxicity.FEATURES)
    plain = [toxicity.bare(w) for w in raw]
    kind, weight = [None] * len(raw), [0.0] * len(raw)
    for i, (w, b) in enumerate(zip(raw, plain)):
        kind[i], weight[i] = match_of(b)
        if kind[i] is None and not (b.isalpha() and w.isalpha()):
            for r in sorted(toxicity.revealed(w)):
                if match_of(r)[0]:
                    kind[i], weight[i] = "hidden", match_of(r)[1]
                    break
    spelled, i = 0, 0
    runs = []
    while i < len(raw):
        j = i
        while j < len(raw) and len(plain[j]) == 1:
            j += 1
        if j - i >= 4:
            runs.append((i, j))
        i = max(j, i + 1)
    for i, j in runs:
        spelled += j - i
        if (w := match_of("".join(plain[i:j]))[1]) > 0:
            kind[i], weight[i] = "hidden", w
    hits = [i for i, w in enumerate(weight) if w > 0]
    you = [i for i, b in enumerate(plain) if b in toxicity.ADDRESS]
    near = sum(any(abs(i - k) <= toxicity.NEAR for k in you) for i in hits)
    letters = [c for c in text if c.isalpha()]
    digits, blanks, n = sum(c.isdigit() and not c.isalpha() for c in text), sum(c.isspace() for c in text), len(raw)
    share = lambda flags: sum(map(bool, flags)) / n
    return [share(k in ("word", "hidden") for k in kind), share(k == "start" for k in kind), share(k == "hidden" for k in kind), math.log1p(len(hits)), math.log1p(len({plain[i] for i in hits})), sum(weight) / n, math.log1p(sum(weight)), max(weight),
            near / n, len(you) / n, sum(c.isupper() for c in letters) / max(1, len(letters)), share(len(b) > 1 and w.isupper() for w, b in zip(raw, plain)),
            (len(text) - len(letters) - digits - blanks) / len(text), text.count("!") / n, share(len(b) > 2 and not b.isalpha() for b in plain), digits / len(text), spelled / n,
            sum(a == b for a, b in zip(plain, plain[1:])) / n, math.log1p(n)]


@pytest.mark.parametrize("text", TEXTS)
def test_toxicity_features_one_by_one(text):
    got = toxicity.features([text, "another text you moron"], LEXICON)[0]
    np.testing.assert_allclose(got, features_of(text), atol=1e-12)


def test_toxicity_score_walks_each_tree():
    rng = np.random.default_rng(4)
    x = np.array([features_of(t) for t in TEXTS] * 12)
    y = (x[:, 5] > 0.1).astype(float)
    trees = toxicity.fit_trees(x, np.where(rng.random(len(y)) < 0.1, 1 - y, y), trees=8)
    model = toxicity.Model(LEXICON, trees, toxicity.fit_isotonic(trees.margin(x), y))
    for text, got in zip(TEXTS, model.scores(TEXTS)):
        row, margin = features_of(text), trees.start
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            margin += value[node - len(feature)]
        at, share = model.calibration.at, model.calibration.share
        k = int(np.searchsorted(at, margin))
        want = share[0] if k == 0 else share[-1] if k == len(at) else share[k - 1] + (share[k] - share[k - 1]) * (margin - at[k - 1]) / (at[k] - at[k - 1])
        assert abs(got - min(1.0, max(0.0, want))) < 1e-9
