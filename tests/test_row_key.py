from assayframe.plans import source_queries

SF = "/root/testdata/sf0.001"


def test_row_key_table_is_written_by_many_tasks(spark, monkeypatch, tmp_path):
    load = source_queries.load
    monkeypatch.setattr(source_queries, "load", lambda *a: load(*a).repartition(4))
    monkeypatch.setattr(source_queries, "_path", lambda *a: f"{tmp_path}/t")
    got = source_queries.scan_row_key(spark, SF)
    parts = [p.read_text().splitlines() for p in tmp_path.glob("t/*.csv")]
    assert len(parts) == 4 and {p[0] for p in parts} == {'"",c_custkey,c_mktsegment'}
    want = load(spark, SF, "customer").select("c_name", "c_custkey", "c_mktsegment")
    assert got.columns == ["row_key", "c_custkey", "c_mktsegment"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
