import numpy as np
import pytest

from assayframe.llm import tokencounts as tc


@pytest.mark.parametrize("width,block", [(2, 2), (2, 6), (2, 4096), (4, 8)])
def test_scan_against_brute_force(spark, tmp_path, width, block):
    rng = np.random.default_rng(width + block)
    want = []
    for k in range(4):
        ids = rng.integers(50250, 50257, [0, 1, 57, 200][k]).astype({2: "<u2", 4: "<u4"}[width])
        (tmp_path / f"f{k}.tokens").write_bytes(ids.tobytes())
        start, ordinal = 0, 0
        for i, x in enumerate(ids):
            if x == tc.END:
                want.append((f"f{k}.tokens", ordinal, start, i - start))
                start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            want.append((f"f{k}.tokens", ordinal, start, len(ids) - start))
    got = tc.count_flat(spark, f"file://{tmp_path}", width=width, block=block)
    assert sorted(tuple(r) for r in got.select("file", "ordinal", "start", "n_tokens").collect()) == sorted(want)


def test_round_trip(spark, docs_of, tmp_path):
    encode = tc.tokenizer(tc.VOCABULARY).encode_ordinary
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|> is text"), (5, "é ü " * 3000), (None, "x"), (1, "hello world")]
    placed = tc.write_flat(docs_of(rows), f"file://{tmp_path}/flat")
    got = placed.join(tc.count_flat(spark, f"file://{tmp_path}/flat", block=64, files=placed), ["file", "ordinal"])
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == sorted(((d, len(encode(t or ""))) for d, t in rows), key=repr)


def test_query(spark):
    encode = tc.tokenizer(tc.VOCABULARY).encode_ordinary
    d = "/root/testdata/sf0.001"
    want = sorted((r.doc_id, len(encode(r.text or ""))) for r in spark.read.parquet(d + "/documents.parquet").collect())
    assert sorted((r.doc_id, r.n_tokens) for r in tc.op10_token_counts(spark, d).collect()) == want


def test_empty_table(spark, tmp_path, docs_of):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert tc.op10_token_counts(spark, str(tmp_path)).collect() == []
