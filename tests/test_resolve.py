"""Weak matches and failures, on literal cases."""

from docengine.functions import sequential as S
from docengine.operators import chart_links, cleaning


def test_weak_match_only_without_a_find(spark):
    charts = spark.createDataFrame([(1, "a", "chart_a", "solar hours", "bar", "sun in the south", [], "{}"), (1, "b", "chart_b", "wind", "bar", "towers", [], "{}")], "doc int, stem string, node string, name string, kind string, description string, legend array<string>, data string")
    hits = spark.createDataFrame([(1, 1, 1, "![x](images/lost.png)", None), (1, 2, 1, "no image", None), (2, 1, 1, "![x](images/b.png) [Chart: a] [Chart: b]", "[]"), (3, 1, 2, "![x](images/a.png)", "chart_a, b")], "query_id int, place int, doc_id int, content string, chart_ids string")
    hints = spark.createDataFrame([(1, "Solar  hours in the south"), (2, "wind")], "query_id int, hint string")
    found = sorted(map(tuple, chart_links.resolve(hits, charts, 5, hints).collect()))
    assert found == [(1, 1, "a", "weak", 1, 1), (2, 1, "b", "image", 1, 1), (2, 1, "a", "anchor", 1, 2)] or found == sorted([(1, 1, "a", "weak", 1, 1), (2, 1, "b", "image", 1, 1), (2, 1, "a", "anchor", 1, 2)])
    assert [r["n"] for r in chart_links.resolve(hits, charts, 1).collect()] == [1]


def test_prune_json():
    text = '{"a": ["x.png", {"b": {"c": " ./x.png"}}, {"d": "y.png"}], "e": "x.png", "f": 1}'
    assert S.prune_json(text, {"x.png"}) == ('{"a": [{"d": "y.png"}], "f": 1}', True)
    assert S.prune_json(text, {"z"}) == (text, False) and S.prune_json(None, {"x"}) == (None, False) and S.prune_json("no", {"no"}) == ("no", False)


def test_clean_documents_without_a_model(spark):
    rows = spark.createDataFrame([(1, "a\na", "k"), (2, None, "k"), (3, "", "k")], "id int, text string, key string")
    got = {r["id"]: (r["text"], r["success"], r["error"], r["original_chars"]) for r in cleaning.clean_documents(rows).collect()}
    assert got == {1: ("a", True, None, 3), 2: (None, False, "no text", 0), 3: ("", True, None, 0)}
