import hashlib
import re
from collections import defaultdict

from assayframe.llm.exact_dedup import tree_merge


def brute(rows):
    groups, out = defaultdict(list), []
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc, len(text or "")))
    for plain, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(plain.encode()).hexdigest()
        out += [(doc, keep, len(members), doc == keep, digest) for doc, _ in members]
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted((tuple(r) for r in tree_merge(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_against_brute_force(docs_of):
    rows = [(i, ["a b", "ab", " a\tb ", "é", "", None, "x" * 5000, "\x0b\x0c"][i % 8]) for i in range(60)]
    rows += [(100, "a b"), (101, "AB"), (102, "a b"), (102, "a b"), (None, "a b c"), (None, None)]
    want = brute(rows)
    assert run(docs_of(rows)) == want
    assert run(docs_of(rows), runs=5, fan_in=2) == want


def test_most_code_points_then_smallest_id(docs_of):
    got = {r[0]: r for r in run(docs_of([(5, "ab"), (2, "ab"), (9, "a  b"), (7, "a b "), (-3, "ab")]))}
    assert {r[1] for r in got.values()} == {7} and got[7][3] and not got[9][3] and got[5][2] == 5


def test_hot_group_and_empty(docs_of, spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(50)]
    assert run(docs_of(rows)) == brute(rows)
    assert run(docs_of([])) == []
