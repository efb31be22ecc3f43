import bisect
import hashlib
import zlib

import pytest

from assayframe.llm.sharding import shard


def brute(rows, shards, points):
    """Walk the ring row by row, round by round."""
    nodes = sorted((int(hashlib.md5(f"shard:{s}:{v}".encode()).hexdigest()[:8], 16), s, v) for s in range(shards) for v in range(points))
    places = [n[0] for n in nodes]
    keyed = []
    for doc, text in rows:
        crc = zlib.crc32((text or "").encode())
        h = hashlib.md5(":".join(str(x) for x in (doc, crc) if x is not None).encode()).hexdigest()
        arc = bisect.bisect_left(places, int(h[:8], 16)) % len(nodes)
        keyed.append((arc, h[8], h, doc if doc is not None else -1, crc, len((text or "").encode()) + 1))
    keyed.sort()
    routes = {}
    for arc in {k[0] for k in keyed}:
        seen = []
        for step in range(len(nodes)):
            s = nodes[(arc + step) % len(nodes)][1]
            if s not in seen:
                seen.append(s)
        routes[arc] = seen
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    left, out, taken = keyed, [], {}
    for t in range(shards):
        rest = []
        for k in left:
            s = routes[k[0]][t]
            if room[s] > 0:
                room[s] -= 1
                out.append((k[3], k[5], k[4], s))
                taken.setdefault((s, k[0], t), 0)
            else:
                rest.append(k)
        left = rest
    return sorted(out)


def run(df, **kw):
    return [(r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32, r.shard, r.slot, r.law, r.grown_shard) for r in shard(df, **kw).collect()]


@pytest.mark.parametrize("shards,points", [(8, 16), (3, 5)])
def test_against_brute_force(docs_of, shards, points):
    rows = [(i, f"text {i % 7}é" if i % 5 else None) for i in range(203)] + [(None, "n"), (None, None), (7, ""), (7, "")]
    got = run(docs_of(rows), shards=shards, points=points)
    assert sorted(r[:4] for r in got) == brute(rows, shards, points)
    counts = [sorted(r[4] for r in got if r[3] == s) for s in range(shards)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    assert {r[5] for r in got} == {"rows"} and {r[6] for r in got} == {None}


def test_limited_movement(docs_of):
    rows = [(i, "t") for i in range(2000)]
    a = {r[0]: r[3] for r in run(docs_of(rows))}
    b = {r[0]: r[3] for r in run(docs_of(rows), shards=9)}
    moved = sum(a[k] != b[k] for k in a)
    assert moved < 0.35 * len(a), moved


def test_empty_and_few_rows(docs_of):
    assert run(docs_of([])) == []
    assert sorted(r[3] for r in run(docs_of([(1, "a"), (2, "a")]))) == [0, 1]
