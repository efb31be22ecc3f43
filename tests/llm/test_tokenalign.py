import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from assayframe.llm import tokenalign as ta

A_FILE, B_FILE = ta.tokenizer_folder() / "byte_bpe_50k.json", ta.tokenizer_folder() / "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers straight from their libraries, with the bytes of each token."""
    a = Tokenizer.from_file(str(A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(B_FILE))
    byte_of = ta._byte_of()
    a_bytes = {i: bytes(byte_of[c] for c in w) for w, i in a.get_vocab(with_added_tokens=False).items() if i != 50256}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        ids_a, ids_b, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        pa, pb = [(i, a_bytes[i]) for i in ids_a], [(i, piece(i)) for i in ids_b]
        return (pa, pb) if b"".join(x for _, x in pa) == raw == b"".join(x for _, x in pb) else ([], [])
    return tokens


def slow_groups(pa, pb):
    """Groups and linked pairs by walking over the bytes."""
    def ends(tokens):
        out, at = [], 0
        for i, x in tokens:
            at += len(x)
            out.append((at, i))
        return out
    ea, eb = ends(pa), ends(pb)
    both = sorted({e for e, _ in ea} & {e for e, _ in eb})
    groups, low = [], 0
    for e in both:
        groups.append(([i for p, i in ea if low < p <= e], [i for p, i in eb if low < p <= e]))
        low = e
    return groups, [(i, j) for p, i in ea for q, j in eb if p == q]


def brute(rows, tokens):
    per = [(d, *tokens(t)) for d, t in rows]
    found = [(d, a, b, *slow_groups(a, b)) for d, a, b in per]
    count = Counter(pair for *_, links in found for pair in links)
    top = {}
    for (a, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for d, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["The quick brown fox", "a", " ", "", None, "  two  blanks   three\n\nlines\t tab ", "naïve café — 漢字 и кириллица 🙂🙃", "<|endoftext|> <s> </s> <unk> [CLS]", "a▁b", "it's we'll they've 12345 67.89%",
         "​ ﻿ odd blanks", "x" * 300, "The quick brown fox", "nul\0byte", "\r\n", "ﬁ ligature Å", "é", "ab" * 50 + " " * 40 + "end"]


@pytest.mark.parametrize("frequent", [ta.FREQUENT, 20, 0])
def test_figures_against_brute_force(docs_of, plain, frequent):
    rows = list(enumerate(TEXTS, 1)) + [(None, "The quick brown fox jumps"), (3, "a"), (3, "a")]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in ta.aligned_figures(docs_of(rows), frequent=frequent).collect()), key=repr)
    assert got == sorted(brute(rows, plain), key=repr)


def test_query_on_given_documents(spark, plain):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in ta.op13_token_alignment(spark, folder).collect())
    assert got == sorted(brute(docs, plain))


def test_empty_table(docs_of):
    assert ta.aligned_figures(docs_of([])).collect() == []


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=30))
def test_cuts_of_two_sides(a, b):
    if sum(a) != sum(b):
        (a if sum(a) < sum(b) else b).append(abs(sum(a) - sum(b)))
    ea, eb = np.cumsum(a).astype(np.int64), np.cumsum(b).astype(np.int64)
    first, last = (np.array([0]), np.array([len(ea) - 1])) if len(ea) else (np.zeros(0, dtype=np.int64),) * 2
    assert ta.shared_cuts(ea, eb, first, last).tolist() == np.isin(ea, eb).tolist()


def test_very_long_texts(plain):
    text, proto = A_FILE.read_text(), B_FILE.read_bytes()
    long = "".join("word%d " % (i * 7919 % 1000) for i in range(8_000))
    run = "abc" * 12_000
    for t in (long, run, " " * 25_000 + "x"):
        found = ta.Aligned([t], text, proto)
        a, b = plain(t)
        assert [i for i, _ in a] == found.a.tolist() and [i for i, _ in b] == found.b.tolist()
        assert found.n_groups[0] == np.isin(np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])).sum()
