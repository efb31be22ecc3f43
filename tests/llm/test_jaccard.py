import numpy as np
import pytest

import corpus_pipeline
from assayframe.llm import jaccard, simhash


def slow_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_kept(rows):
    sets, group = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(d for (d, _), g in zip(rows, group) if g == k) for k in set(group))


def edited(rng, base, edits):
    words = list(base)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"x{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [16, 2])
def test_stage_against_brute_force_jaccard(docs_of, crowd):
    rng = np.random.default_rng(8)
    bases = [[f"w{x}" for x in rng.integers(0, 400, rng.integers(4, 160))] for _ in range(15)]
    texts = [edited(rng, bases[i % 15], int(rng.integers(0, 1 + len(bases[i % 15]) // 25))) for i in range(200)]
    line = [f"common{k}" for k in range(12)]
    texts += [edited(rng, bases[0] + line * 2, 3) for _ in range(30)] + [" ".join(line + [f"own{i}_{k}" for k in range(i % 9)]) for i in range(40)]
    texts += [None, "", " ", "one", "One", "one two", "a b c d", "a b c d e"]
    rows = list(enumerate(texts, 1))
    assert sorted(r.doc_id for r in jaccard.keep_first(docs_of(rows), crowd).collect()) == slow_kept(rows)


def test_stage_drops_near_copies_far_apart_in_bits(spark, docs_of):
    words = [f"w{k}" for k in range(60)]
    near = [*words[:30], "other", *words[31:]]  # 51 of 61 shingles agree
    rows = [(4, " ".join(words)), (2, " ".join(near)), (9, "completely other words here"), (2, " ".join(near)), (None, " ".join(words))]
    kept = corpus_pipeline.near_dedup(spark, docs_of(rows), "")
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 9), (True, None)]
    assert jaccard.keep_first(docs_of([])).collect() == []


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n, m = rng.integers(1, 5000, 2)
        pool = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n + m))
        a, b = np.sort(rng.choice(pool, min(n, len(pool)), replace=False)), np.sort(rng.choice(pool, min(m, len(pool)), replace=False))
        differ = len(np.setxor1d(a, b))
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= differ
    assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(a)) == 0 and jaccard.apart(jaccard.sketch(a[:0]), jaccard.sketch(a[:5])) == 5


def test_shortened_and_joined_shingles(docs_of, monkeypatch):
    """The ways for large corpora: whole hashes, and joins in place of what every task holds."""
    rng = np.random.default_rng(10)
    bases = [[f"w{x}" for x in rng.integers(0, 300, 60)] for _ in range(8)]
    rows = [(i, edited(rng, bases[i % 8], int(rng.integers(0, 4)))) for i in range(60)] + [(100, None), (101, "")]
    want = slow_kept(rows)
    for changes in ({"BUCKET": 16, "CHUNK": 50}, {"HELD": 0, "WIDE": 1}):
        for name, value in changes.items():
            monkeypatch.setattr(jaccard, name, value)
        assert sorted(r.doc_id for r in jaccard.keep_first(docs_of(rows)).collect()) == want, changes


def test_fingerprints_propose_and_the_sets_decide(docs_of, monkeypatch):
    """Near copies within two bits are joined by the fingerprints alone; texts of one fingerprint and other sets are not."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
    copies = [" ".join([*base[:k], "other", *base[k + 1:]]) for k in range(40, 560, 40)]
    rows = list(enumerate([" ".join(base), *copies, "a few other words that stand alone in here"], 1))
    monkeypatch.setattr(jaccard, "fingerprint", lambda text: 7)  # candidates that the verification has to sort out
    assert sorted(r.doc_id for r in jaccard.keep_first(docs_of(rows)).collect()) == slow_kept(rows) == [1, len(rows)]
    monkeypatch.undo()
    proposed = []
    alike, empty = jaccard._alike, jaccard._met
    monkeypatch.setattr(jaccard, "_alike", lambda r, crowd: proposed.append(alike(r, crowd)) or proposed[-1])
    monkeypatch.setattr(jaccard, "_met", lambda r: empty(r).limit(0))  # without the prefix filter
    kept = sorted(r.doc_id for r in jaccard.keep_first(docs_of([*rows, (90, " ".join(base) + " "), (91, copies[0])])).collect())
    group = {d: d for d, _ in rows}
    for d, t in rows:
        for e, u in rows:
            if (simhash.fingerprint(t) ^ simhash.fingerprint(u)).bit_count() <= 2:
                low, top = sorted((group[d], group[e]))
                group = {k: low if g == top else g for k, g in group.items()}
    assert kept == sorted(set(group.values())) and 2 < len(kept) < 9 and proposed[0].count() >= len(rows) - len(kept)



def test_crowded_pairs_are_made_once(spark):
    """Sets that share many buckets are paired in one of them; no pair is lost."""
    sets = {s: (s % 3, {k for k in range(200) if (k * s) % 7 != 3}) for s in range(1, 30)}
    met = spark.createDataFrame([(k, s, 100, g) for s, (g, ks) in sets.items() for k in ks], "shingle long, sig long, n int, group long")
    got = [tuple(r) for r in jaccard._all_pairs(met).collect()]
    assert sorted(got) == sorted((a, b) for a in sets for b in sets if a < b and sets[a][0] != sets[b][0])


def versions(rng, n, most):
    """Versions of one text, most of them too far from each other for a link, some with a passage that other texts have too."""
    base, passage = [f"w{x}" for x in rng.integers(0, 500, 120)], " ".join(f"p{k}" for k in range(14))
    texts = [edited(rng, base, int(rng.integers(1, most))) + (" " + passage if i % 9 == 0 else "") for i in range(n)]
    return texts + [f"{passage} " + " ".join(f"v{x}" for x in rng.integers(0, 300, 12)) for _ in range(n // 5)]


def test_many_versions_of_a_text_are_not_compared_pair_by_pair(docs_of, monkeypatch):
    rng = np.random.default_rng(12)
    rows = list(enumerate(versions(rng, 300, 7), 1))
    asked, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *more: asked.append(pairs.distinct().count()) or verified(pairs, *more))
    kept = sorted(r.doc_id for r in jaccard.keep_first(docs_of(rows)).collect())
    assert kept == slow_kept(rows)
    assert len(asked) == 5 and asked[-1] < len(rows) < len(kept) ** 2 // 50


def test_middle_loses_no_pair(spark, docs_of):
    """Certain links and pairs left to verify join all alike sets of a bucket, whatever their groups and sizes are."""
    rng = np.random.default_rng(13)
    for n, most in ((70, 4), (70, 12)):
        texts = [*versions(rng, n, most), *(" ".join(f"w{x}" for x in rng.integers(0, 9, k)) for k in range(5, 30))]
        docs = jaccard._texts(docs_of(list(enumerate(texts))))
        sets = {s.tobytes(): (i, s) for i, s in enumerate(map(jaccard.shingles, texts))}
        sig = {i: k for k, (i, _) in enumerate(sets.values())}
        keys = {r.doc_id: r.key for r in docs.collect()}
        known = spark.createDataFrame([(sig[i], keys[i], len(s)) for i, s in sets.values()], "sig long, key long, n int")
        one = min(sig.values())
        met = spark.createDataFrame([(7, sig[i], len(s), sig[i] % 60, (one,)) for i, s in sets.values()], "shingle long, sig long, n int, group long, _one struct<sig: long>")
        none = spark.createDataFrame([], "a long, b long")
        groups = spark.createDataFrame([(k, k % 60) for k in sig.values() if k >= 60], "a long, b long")
        certain, pairs = jaccard._by_middle(met, none.unionByName(groups), docs, known)
        alike = {(sig[i], sig[j]) for i, s in sets.values() for j, t in sets.values() if i < j and 9 * len(np.intersect1d(s, t)) >= 4 * (len(s) + len(t))}
        certain, pairs = ({tuple(sorted(r)) for r in d.collect()} for d in (certain, pairs))
        assert certain <= alike
        group = {k: k % 60 for k in sig.values()}

        def join(links):
            for a, b in links:
                low, top = sorted((group[a], group[b]))
                group.update({k: low for k, g in group.items() if g == top})

        join(certain)
        join(pairs & alike)
        assert all(group[a] == group[b] for a, b in alike) and (most > 4 or certain)


def test_shared_passages_do_not_crowd_buckets(docs_of, monkeypatch):
    """Unrelated texts with a passage that no sample shows as common do not end in large buckets; pairs among them are found."""
    rng = np.random.default_rng(14)
    passage = [f"p{k}" for k in range(24)]
    texts = [" ".join([f"own{i}_{k}" for k in range(70 + i % 40)] + passage) for i in range(90)]
    texts += [edited(rng, texts[i].split(), 2) for i in range(0, 90, 30)] + [" ".join(passage), edited(rng, [*passage, "other"], 1)]
    rows = list(enumerate(texts, 1))
    met, by_middle = [], jaccard._by_middle
    monkeypatch.setattr(jaccard, "COMMON", 1 << 30)
    monkeypatch.setattr(jaccard, "_by_middle", lambda m, *more: met.append(m.count()) or by_middle(m, *more))
    assert sorted(r.doc_id for r in jaccard.keep_first(docs_of(rows)).collect()) == slow_kept(rows)
    assert sum(met) == 0
