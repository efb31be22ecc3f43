from pyspark.sql import functions as F

from assayframe.sources.readers import duplicate_keys, read_feature_matrix, read_keyed_matrix, read_table
from assayframe.sources.writers import figure_feed, result_summary, write_mart, write_text

MATRIX = "# made from a biom file\t\t\t\n#OTU ID\tS1\tS2\ttaxonomy\nA\t1.5\t0\tk__B; p__C\nB\t0\t2\tk__D\n"


def test_csv_with_na_and_header_blanks(spark, tmp_path):
    text = "Round ,Day ,T,Chl\n0,1,10:12,NA\n1,2,9:55,3.5\n"
    for name, body in (("lf.csv", text), ("cr.csv", text.replace("\n", "\r"))):
        f = tmp_path / name
        f.write_bytes(body.encode())
        df = read_table(spark, str(f), {"Round": "int", "Day": "int", "Chl": "double"})
        assert df.columns == ["Round", "Day", "T", "Chl"]
        assert [tuple(r) for r in df.collect()] == [(0, 1, "10:12", None), (1, 2, "9:55", 3.5)]


def test_unnamed_row_key(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text('"","a","b"\n"x,1",1,NA\n"y",2,"t, u"\n')
    df = read_table(spark, str(f), {"a": "int"})
    assert [tuple(r) for r in df.collect()] == [("x,1", 1, None), ("y", 2, "t, u")]


def test_feature_matrix(spark, tmp_path):
    for body in (MATRIX, MATRIX.replace("\n", "\r")):
        f = tmp_path / f"m{len(list(tmp_path.iterdir()))}.txt"
        f.write_bytes(body.encode())
        df = read_feature_matrix(spark, str(f))
        assert dict(df.dtypes) == {"feature": "string", "S1": "double", "S2": "double", "taxonomy": "string"}
        assert [tuple(r) for r in df.collect()] == [("A", 1.5, 0.0, "k__B; p__C"), ("B", 0.0, 2.0, "k__D")]


def test_keyed_matrix_and_duplicates(spark, tmp_path):
    f = tmp_path / "k.tsv"
    f.write_text("pathway\tS1\tS2\nP1\t1\t2\nP1\t3\t4\nP2\t5\t6\n")
    df = read_keyed_matrix(spark, str(f))
    assert [tuple(r) for r in duplicate_keys(df, ["feature"]).collect()] == [("P1", 2)]


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1.25), ("c", None)], "k string, v double")
    write_text(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "out"), {"v": "double"}).collect())) == [("a, b", 1.25), ("c", None)]


def test_mart_is_partitioned(spark, tmp_path):
    means = spark.createDataFrame([("x", 1, 5.0, 1.0), ("y", 2, 7.0, None)], "g string, d int, m double, s double")
    for figure in ("f1", "f2"):
        write_mart(figure_feed(means, figure, "p", ["g", "d"], "m", "s", F.col("m") > 5 if figure == "f2" else None), str(tmp_path / "mart"))
    back = spark.read.parquet(str(tmp_path / "mart")).filter("figure = 'f2'")
    assert [(r.g, r["mean"], r.lo, r.hi) for r in back.collect()] == [("y", 7.0, None, None)]
    assert "PartitionFilters: [isnotnull(figure" in back._jdf.queryExecution().executedPlan().toString()


def test_result_summary(spark):
    data = [(5.0, 1.0, 0.001, 0.01), (5.0, -1.0, 0.001, 0.01), (5.0, 2.0, None, None), (1.0, 1.0, 0.3, None), (9.0, 1.0, 0.5, 0.5)]
    df = spark.createDataFrame(data, "baseMean double, log2FoldChange double, pvalue double, padj double")
    assert tuple(result_summary(df, 0.05).head()) == (5, 1, 1, 1, 1)


def test_records_that_do_not_fit_are_kept_apart(spark, tmp_path):
    from assayframe.sources.readers import read_checked

    lines = ["id,name,v", "1,a,2.5", "2,b,oops", "3,c", "4,d,1,9", '5,"e, with comma",7', "6,NA,NA", "x,f,1", '7,"g,h']
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    rows, bad = read_checked(spark, str(tmp_path / "t.csv"), {"id": "long", "v": "double"})
    assert sorted((r.id, r.name, r.v) for r in rows.collect()) == [(1, "a", 2.5), (5, "e, with comma", 7.0), (6, None, None)]
    got = {r.record: r.reason for r in bad.collect()}
    assert got["2,b,oops"] == got["x,f,1"] == "value" and got["3,c"] == "short" and got["4,d,1,9"] == "long"
    assert len(got) + rows.count() == len(lines) - 1 and all(r.file.endswith("t.csv") for r in bad.collect())


def test_a_mart_may_be_written_again(spark, tmp_path):
    path = str(tmp_path / "mart")
    df = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 3)], "figure string, v int")
    write_mart(df, path)
    write_mart(df, path)
    write_mart(df.filter("figure = 'f1' AND v = 2"), path)
    assert sorted((r.figure, r.v) for r in spark.read.parquet(path).collect()) == [("f1", 2), ("f2", 3)]
    write_mart(df.filter("v = 3"), path, mode="append")
    assert spark.read.parquet(path).count() == 3
