"""Queries with table functions in SQL, and over JSON of any depth without Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.operators import json_walk, udtfs
from docengine.plans.q_built import _CHUNK, _PIECES, built
from docengine.plans.registry import query, table


@query(
    "chk7_chunk_table_function",
    f"WITH {_PIECES} SELECT {_CHUNK.format(i=0, kind='paragraph', text='one', a='0')} FROM p UNION ALL SELECT {_CHUNK.format(i=1, kind='table', text='grid', a='(length(one) - 10)')} FROM p UNION ALL SELECT {_CHUNK.format(i=2, kind='paragraph', text='two', a='(length(one) + length(grid) - 20)')} FROM p",
)
def chunk_function(spark, sf_dir):
    """Structure-aware chunks by a table function called from SQL."""
    udtfs.register(spark)
    return spark.sql("SELECT p_partkey, chunk_index, chunk_type, content, start_char, end_char, truncated FROM chunk(TABLE(SELECT * FROM {t}), 'structure_aware', 140, 10, 10)", t=built(spark, sf_dir))


def _model(size: str) -> dict | None:
    if int(size) % 3 == 2:
        raise ValueError("no answer")
    return {"is_chart": int(size) % 3 == 0}


@query("jsn16_extract_table_function", "SELECT p_partkey, p_brand, CASE p_size % 3 WHEN 0 THEN 'chart' WHEN 1 THEN 'non_chart' ELSE 'error' END AS status, CASE WHEN p_size % 3 = 2 THEN 'ValueError: no answer' END AS error FROM part")
def extract_function(spark, sf_dir):
    """Extraction by a named model hook, called from SQL for each brand's rows."""
    udtfs.register(spark, {"stub": _model})
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("image"))
    return spark.sql("SELECT p_partkey, p_brand, status, error FROM extract(TABLE(SELECT * FROM {t}) PARTITION BY (p_brand), 'stub')", t=rows)


#: A JSON text for each part of up to sixteen levels: lists in lists around an object with a removed file or another one.
_JSON = """'{"cover": ".\\images\\c' || p_size % 5 || '.png", "n": [1, true, null, 2.5], "deep": ' || repeat('[', p_size % 16) || '{"img": "./images/b' || p_size % 3 || '.png", "t": "' || p_name || '"}' || repeat(']', p_size % 16) || '}'"""


def _json(spark, sf_dir):
    k = F.col("p_size")
    text = F.concat(F.lit('{"cover": ".\\\\images\\\\c'), (k % 5).cast("string"), F.lit('.png", "n": [1, true, null, 2.5], "deep": '), F.expr("repeat('[', p_size % 16)"), F.lit('{"img": "./images/b'), (k % 3).cast("string"), F.lit('.png", "t": "'), F.col("p_name"), F.lit('"}'), F.expr("repeat(']', p_size % 16)"), F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("json"))


@query(
    "jsn1_json_strings",
    """SELECT p_partkey, '$.cover' AS path, '.\\images\\c' || p_size % 5 || '.png' AS value FROM part
    UNION ALL SELECT p_partkey, '$.deep' || repeat('[0]', p_size % 16) || '.img', './images/b' || p_size % 3 || '.png' FROM part
    UNION ALL SELECT p_partkey, '$.deep' || repeat('[0]', p_size % 16) || '.t', p_name FROM part""",
)
def json_strings(spark, sf_dir):
    """Every string in JSON texts up to sixteen levels deep, with its path."""
    return json_walk.strings(_json(spark, sf_dir), "json", "p_partkey")


@query(
    "jn9_json_references",
    """SELECT p_partkey, '$.cover' AS path, 'images/c1.png' AS ref FROM part WHERE p_size % 5 = 1 AND p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, '$.deep' || repeat('[0]', p_size % 16) || '.img', 'images/b2.png' FROM part WHERE p_size % 3 = 2""",
)
def json_references(spark, sf_dir):
    """Strings that name files removed from their document, at any depth: the rows that pruning has to touch."""
    p = table(spark, sf_dir, "part")
    removed = p.where("p_partkey % 2 = 0").select("p_partkey", F.lit("images/c1.png").alias("ref")).unionByName(p.select("p_partkey", F.lit("images/b2.png").alias("ref")))
    return json_walk.references(_json(spark, sf_dir), removed, "json", "p_partkey")
