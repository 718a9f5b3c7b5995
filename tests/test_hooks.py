import json
import random

import pytest

from docengine.operators import chunking, json_walk, udtfs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("strategy", ["structure_aware", "semantic", "sentence", "length"])
def test_the_table_function_chunks_as_the_operator(spark, strategy):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).union(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, " \n", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    udtfs.register(spark)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = chunking.chunk(docs, strategy, size=300, overlap=50, least=40).select("doc_id", "source", "chunk_index", "chunk_type", "content", "start_char", "end_char", "truncated")
    got = spark.sql("SELECT doc_id, source, chunk_index, chunk_type, content, start_char, end_char, truncated FROM chunk(TABLE(SELECT * FROM {t}), '%s', 300, 50, 40)" % strategy, t=docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_arguments_are_checked_before_a_row_is_read(spark):
    udtfs.register(spark, {"m": lambda x: {"is_chart": True}})
    t = spark.createDataFrame([(1, "x")], "id long, image string")
    for sql in ("SELECT * FROM chunk(TABLE(SELECT * FROM {t}))", "SELECT * FROM extract(TABLE(SELECT * FROM {t}), 'other')", "SELECT * FROM chunk(TABLE(SELECT id, image AS text FROM {t}), 'odd')"):
        with pytest.raises(Exception, match="column|unknown"):
            spark.sql(sql, t=t).collect()
    rows = spark.sql("SELECT * FROM extract(TABLE(SELECT * FROM {t}), 'm')", t=t)
    assert rows.columns == ["id", "image", "status", "json", "error"]
    assert tuple(rows.first()) == (1, "x", "chart", '{"is_chart": true}', None)


def value(r, depth):
    kind = r.choice(["s", "n", "b", "null", "list", "object"]) if depth else r.choice(["s", "n"])
    if kind == "list":
        return [value(r, depth - 1) for _ in range(r.randrange(0, 4))]
    if kind == "object":
        return {r.choice(["a", "b", "odd key", "ü"]): value(r, depth - 1) for _ in range(r.randrange(0, 4))}
    return {"s": lambda: r.choice(["x", "", "./images/a.png", "images\\b.png"]), "n": lambda: r.choice([1, 2.5, -3]), "b": lambda: True, "null": lambda: None}[kind]()


def plainly(v, path="$"):
    if isinstance(v, str):
        yield path, v
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from plainly(x, f"{path}[{i}]")
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from plainly(x, f"{path}.{k}" if k.isascii() and k.isidentifier() else f'{path}."{k}"')


def test_strings_of_random_json(spark):
    r = random.Random(1)
    values = [value(r, 6) for _ in range(150)]
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)] + [(900, "{broken"), (901, None), (902, ""), (903, '"alone"')]
    got = json_walk.strings(spark.createDataFrame(rows, "doc_id long, json string"), "json")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(k, p, s) for k, v in enumerate(values) for p, s in plainly(v)] + [(903, "$", "alone")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_references_of_a_document_to_its_own_removed_files(spark):
    text = '{"a": ["./images/a.png", {"b": " images/b.png"}], "c": "images\\\\a.png"}'
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, json string")
    removed = spark.createDataFrame([(1, "images/a.png"), (1, "images/a.png"), (2, "images/b.png"), (3, "images/a.png")], "doc_id long, ref string")
    got = json_walk.references(docs, removed, "json")
    assert sorted(map(tuple, got.collect())) == [(1, "$.a[0]", "images/a.png"), (1, "$.c", "images/a.png"), (2, "$.a[1].b", "images/b.png")]
