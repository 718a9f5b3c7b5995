"""Queries over documents against their SQL, on texts that the small tables lack: null, empty, white space, punctuation alone."""

import glob
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

TEXTS = [None, "", " ", "\n", " \n\n ", "\t", "\r\n", ".", "。，!", ". . ", "A, b!  c", "a\tb", "\tx", "x\t", "x \r\n", "a\r\n\r\nb", "\n\n\nq\n\n\n", "  lead"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The small tables, each text of TEXTS under ids of all four remainders."""
    folder = tmp_path_factory.mktemp("odd")
    for f in glob.glob(f"{SF}/*.parquet"):
        shutil.copy(f, folder)
    docs = pq.read_table(f"{SF}/documents.parquet")
    rows = [{"doc_id": 10**6 + 4 * i + k, "text": t, "lang": "en", "source": f"src{k}", "n_chars": len(t or "")} for i, t in enumerate(TEXTS) for k in range(4)]
    os.chmod(folder / "documents.parquet", 0o644)
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(rows, schema=docs.schema)]), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["ded2_fingerprint", "ded_exact_groups", "ded3_group_id", "str6_blocks", "str7_anchor_placement"])
def test_query_equals_sql(spark, odd, name):
    con = duckdb.connect()
    for f in glob.glob(f"{odd}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, odd)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
