import pytest
from pyspark.sql import functions as F

from assayframe.llm import boosting, common, html, langid


def test_small_shares_are_not_cut(spark):
    n = 1 << 20
    share = 5e-7  # half a millionth: no row under a share of whole millionths
    assert int(share * 1_000_000) == 0 and int(share * common.FINE) == pytest.approx(share * common.FINE)
    assert spark.range(64 * n).where(common.chosen(share, F.col("id"))).count() in range(10, 70)


def test_every_class_is_sampled_with_its_weight(spark):
    rows = spark.range(4_000_000).select("id", (F.col("id") == 7).cast("int").alias("c"))
    got = common.sampled(rows, F.col("c"), [F.col("id")], 3).collect()
    few = [r for r in got if r["_class"] == 0]
    assert few and sum(r["_weight"] for r in few) == pytest.approx(3_999_999) and [(r.id, r["_weight"]) for r in got if r["_class"] == 1] == [(7, 1.0)]


@pytest.mark.parametrize("same", [0, None])
def test_shared_and_null_ids(spark, same):
    """Rows of one id are told apart by their text, and repeated rows count once."""
    rows = spark.range(10_000).select(F.lit(same).cast("long").alias("doc_id"), F.concat(F.lit("der und text "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    got = common.sampled(rows, F.col("lang"), [F.col("doc_id"), F.col("text")], 100).collect()
    assert 50 < len(got) < 200 and sum(r["_weight"] for r in got) == pytest.approx(10_000)
    alike = common.sampled(rows.withColumn("text", F.lit("one")), F.col("lang"), [F.col("doc_id"), F.col("text")], 100).collect()
    assert [r["_weight"] for r in alike] == [10_000.0]
    assert langid.fit(rows, bound=50).langs == ["de"]
    assert common.sampled(rows.limit(0), F.col("lang"), [F.col("doc_id")], 5).collect() == []
    junk = rows.withColumn("lang", F.concat(F.lit("x"), (F.col("text").substr(14, 20).cast("long") % 700).cast("string")))
    assert len({r["_class"] for r in common.sampled(junk, F.col("lang"), [F.col("text")], 2, most=256).collect()}) == 256


def test_pages_of_one_id(spark):
    pages = spark.range(1000).select(F.lit(5).cast("long").alias("page_id"), F.lit("").alias("url"), F.concat(F.lit("<nav><a>menu</a></nav><article><p>some words of page "), F.col("id").cast("string"), F.lit("</p></article>")).alias("html"))
    model = html.fit(pages, 20)
    assert {r.text[:5] for r in html.extract_pages(pages, model).collect()} == {"some "}
    assert isinstance(html.fit(pages.withColumn("html", F.lit("<p>one</p>")), 20), boosting.Trees)
