import zlib

import numpy as np

from assayframe.llm import langid


def test_letters_only():
    def s(t):
        return "".join(map(chr, langid.letters_only(t)))

    assert s("Ab, 12cd!") == " ab cd " and s("x") == " x " and s("--É ß") == " é ß "
    assert s(None) == s("") == s("12 !?") == ""


def test_blocks_see_each_gram_once(monkeypatch):
    cp = langid.letters_only("the quick brown fox " * 50)
    whole = np.sort(np.concatenate(list(langid.blocks(cp))))
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.array_equal(np.sort(np.concatenate(list(langid.blocks(cp)))), whole)
    assert len(whole) == sum(len(cp) - n + 1 for n in langid.ORDERS)


def test_held_out_accuracy(spark):
    rows = langid.op3_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(docs_of):
    rows = [(i, f"the rain in spain {i}", "en") for i in range(20)] + [(50 + i, f"der regen fällt über {i}", "de") for i in range(20)]
    docs = docs_of(rows)
    model = langid.fit(docs)
    odd = docs_of([(1, None), (2, ""), (3, "1234 !!"), (4, "der regen"), (None, "the spain"), (4, "der regen"), (5, "the rain " * 200_000)])
    from pyspark.sql import functions as F
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd, model, F.col("doc_id")).collect()), key=repr)
    assert [(g[0], g[1]) for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en"), (None, "en")]
    assert langid.identify(docs_of([]), model, F.col("doc_id")).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(docs_of([])), F.col("doc_id")).collect()} == {"und"}


def test_stage_keeps_columns(docs_of):
    docs = docs_of([(i, f"the rain in spain {i}", "en") for i in range(20)] + [(99, "123", None), (98, None, "en")])
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(20))
