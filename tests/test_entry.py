"""The driver's contract: names, SQL, and agreement of a few queries with their SQL on the small tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(sql) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["bm25_topk", "cln3_remove_noise", "ded_exact_groups", "hyb1_jn3_fusion", "agg7_citation_merge", "top6_flt10_final_cut", "str3_skeleton", "jsn6_bar_points", "src9_status_rollup", "win7_outline_ancestors"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cursor = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    expected = sorted(([row[i] for i in order] for row in cursor.fetchall()), key=str)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(([r[n] for n in names] for r in df.collect()), key=str) == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_smoke(spark):
    assert entry.entry(spark).count() == 20
