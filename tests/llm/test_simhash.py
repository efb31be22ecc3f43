import re

import numpy as np
import pytest
import xxhash

from assayframe.llm import simhash
from assayframe.llm.components import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps, radius=2):
    ids, seen, out = list(fps), {}, {}
    for i in sorted(ids):
        if i in seen:
            continue
        stack, seen[i] = [i], i
        while stack:
            a = stack.pop()
            for b in ids:
                if b not in seen and (fps[a] ^ fps[b]).bit_count() <= radius:
                    seen[b] = i
                    stack.append(b)
    return seen


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b c D é É", "a  b\x0bc\x1cd e", "x " * 40000, "ab cd ef gh " * 3])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def _check(docs_of, rows, **kw):
    got = [tuple(r) for r in simhash.near_duplicates(docs_of(rows), **kw).select("doc_id", "fingerprint", "component_id").collect()]
    fps = {d: slow_fingerprint(t) for d, t in rows if d is not None}
    comp = slow_components(fps, kw.get("radius", 2))
    assert sorted(g for g in got if g[0] is not None) == sorted((d, f"{fps[d]:016x}", comp[d]) for d, _ in rows if d is not None)
    return got


def test_against_brute_force(docs_of):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 60, 90)) for _ in range(12)]
    rows = [(i, base[i % 12] if i % 3 else base[i % 12].replace(f"w{i % 60} ", "zz ", 1)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "one"), (204, "one"), (204, "one"), (205, "ONE")]
    _check(docs_of, rows)
    _check(docs_of, rows, crowd=2)  # nearly all buckets are crowded


def test_null_ids_and_empty(docs_of):
    got = _check(docs_of, [(1, "a b c"), (None, "a b c"), (None, "q r s")])
    assert [g[2] for g in got if g[0] is None and g[1] == f"{slow_fingerprint('a b c'):016x}"] == [1]
    assert simhash.near_duplicates(docs_of([])).collect() == []


@pytest.mark.parametrize("radius,crowd", [(2, 16), (2, 3), (1, 16), (1, 2), (0, 16)])
def test_search_loses_no_link(spark, radius, crowd):
    rng = np.random.default_rng(9)
    centres = [int(x) for x in rng.integers(0, 2**63, 20)] + [0]
    fps = set()
    while len(fps) < 400:
        f = centres[rng.integers(len(centres))]
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "rep long, fp long")
    got = {r.node: r.component for r in components(simhash.near_links(df, radius, crowd)).collect()}
    assert {i: got.get(i, i) for i in fps} == slow_components(fps, radius)


def test_thresholds_add_up_and_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    x[:, 1] = x[:, 0]
    for n in (10, 10**5, 10**9, 10**12):
        groups, t = simhash.allocate(n, x.T @ x * (n / 500), 2)
        assert sum(t) == 2 - len(t) + 1 and sorted(b for g in groups for b in g) == list(range(64))


def test_components_on_a_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 99), (5, None)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 99: 99, 100: 99}


def test_keep_first(docs_of):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (9, "completely other words here"), (None, "a b c d")]
    kept = simhash.keep_first(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 9] and kept.where("doc_id IS NULL").count() == 1
