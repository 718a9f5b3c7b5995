"""Close vectors as pairs, all of them: the query against its SQL, and tiles that leave out far cells against all pairs."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docengine.operators import bands
from tests.test_similar_joins import close, vectors

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_close_vectors_are_pairs(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    want = sorted(con.execute(f"SELECT a, b, cosine FROM ({entry.oracle_sql()['ded6_close_vectors']})").fetchall())
    df = entry.queries()["ded6_close_vectors"](spark, SF)
    assert df.columns == ["a", "b", "cosine"] and want
    assert sorted((r["a"], r["b"], r["cosine"]) for r in df.collect()) == want


@pytest.mark.parametrize("limit", [0.9, 0.99])
def test_far_cells_are_left_out(spark, monkeypatch, limit):
    rows = [*vectors(250, 4, 6), *[(1000 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(60)]]
    df = spark.createDataFrame([r for r in rows if r[1] is not None and r[0] not in (903, 904)], "vec_id long, embedding array<double>")
    unit = df.select("vec_id", F.lit(0).alias("all"), bands.vectors.normalize(F.col("embedding")).alias("embedding")).where(F.size("embedding") == 6)
    for near, tile in ((256, None), (4, None), (4, 60)):
        monkeypatch.setattr(bands, "NEAR", near)
        found = bands.pairs_of_groups(unit, limit, "all", tile=tile)
        assert sorted((r["a"], r["b"]) for r in found.collect()) == close(rows, limit, 6)
