"""Charts through the whole plan: summaries in texts, ids on passages, charts behind their passages."""

import json

from docengine.operators import chart_links
from docengine.plans import search


def rows(spark):
    chart = lambda name, yes=True: json.dumps({"is_chart": yes, "chart_type": "bar", "_chart_name": name, "description": f"about {name}", "chart_data": {"series": [{"name": "s"}]}})
    docs = [(1, "Solar power grows in the south and this sentence is long enough.\n\n![p](images/sun.png)\n\nMore about panels on roofs.", "a"), (2, "Wind turbines stand at the coast in long rows of towers.\n![w](./images/none.png)\n[图表] Rotor  Speed", "b"), (3, "Nothing to see here, only words about gardens and flowers.", "c"), (4, None, "d")]
    charts = [(1, "sun", chart("Sun hours")), (1, "photo", chart("Photo", False)), (2, "w1", chart("rotor speed")), (2, "w0", chart("Other")), (3, "lost", "no json")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(charts, "doc_id long, stem string, json string")


def test_summaries(spark):
    docs, charts = rows(spark)
    out = {r["doc_id"]: (r["text"], r["n_injected"]) for r in chart_links.inject_summaries(docs, chart_links.usable(charts)).collect()}
    assert out[1][0] == "Solar power grows in the south and this sentence is long enough.\n\n![p](images/sun.png)\n[图表] Sun hours\ntype: bar\ndescription: about Sun hours\nlegend: s\n\nMore about panels on roofs."
    assert out[1][1] == 1 and out[2][1] == 0 and out[4] == (None, 0) and len(out) == 4


def test_search_brings_charts(spark):
    docs, charts = rows(spark)
    kb = search.knowledge_base(docs, charts=charts)
    assert {(r["node"], r["doc"]) for r in kb.chunks.where("chunk_type = 'chart'").collect()} == {("chart_sun", 1), ("chart_w1", 2), ("chart_w0", 2)}
    assert {(r["source"], r["chart_ids"]) for r in kb.parents.collect()} == {("a", '["chart_sun"]'), ("b", '["chart_w1"]'), ("c", None)}
    asked = spark.createDataFrame([(1, "solar power in the south"), (2, "wind turbines coast")], "query_id int, query string")
    got = sorted((r["query_id"], r["rank"], r["node"], r["is_chart"]) for r in search.search(kb, asked, top_k=1).collect())
    assert [(q, chart) for q, _, _, chart in got] == [(1, False), (1, True), (2, False), (2, True)]
    assert got[1][2] == "chart_sun" and got[3][2] == "chart_w1"
