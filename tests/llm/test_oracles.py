"""Training-data queries that SQL can express, against their SQL on the small tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from docengine.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
