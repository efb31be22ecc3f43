"""Registered queries against their SQL in DuckDB on the smallest tables. check.py does the same for all of them."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
SLOW = {"nmds_points", "nmds_stress", "anosim_perm", "anosim_exact", "rejections_by_cutoff", "result_summary", "norm_mean"}  # check.py runs these


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def canon(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    order = [rel.columns.index(c) for c in cols]
    assert canon(tuple(r[c] for c in cols) for r in df.collect()) == canon(tuple(r[i] for i in order) for r in rel.fetchall())
