"""Operators on literal rows: the edge cases that the tables do not have."""

import pytest
from pyspark.sql import functions as F

from docengine.functions import markdown as M
from docengine.functions import text as T
from docengine.operators import charts, chunking, cleaning, fulltext, hybrid, predicates
from docengine.plans import search
from docengine.sources import files
from docengine.sources.tables import kept
from docengine.streaming import events


def values(spark, expression, rows):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [r[0] for r in df.select(expression(F.col("t")).alias("v")).collect()]


def test_tokens(spark):
    got = values(spark, T.tokens, ["Hello 世界 x_1", "möglich", "　、。", "", "___", "ＡＢ"])
    assert got == [["hello", "世", "界", "x_1"], ["m", "glich"], ["、", "。"], [], ["___"], []]


def test_fingerprints(spark):
    same = values(spark, T.fingerprint, ["A, b!  c", "a b\r\nc", "a　b c.", " (A) [b] c "])
    assert len(set(same)) == 1 and len(same[0]) == 16
    assert values(spark, T.fingerprint, ["", " \n", "。，!", None]) == [""] * 4
    marked = spark.createDataFrame([("chart", "X", "t"), ("table", None, "t"), (None, None, "t"), ("chart", " ", "t"), ("x", None, "")], "k string, c string, t string")
    got = [r[0] for r in marked.select(T.dedup_group_id(F.col("t"), F.col("k"), F.col("c"))).collect()]
    assert got[0] == "chart:X" and got[1].startswith("table:") and ":" not in got[2] and got[3].startswith("chart:") and got[4] == ""


def test_noise_and_titles(spark):
    assert values(spark, T.is_noise, ["", "VIP offer", "第 12 页", "-12-", "汇报人：张三", "ordinary words that are long enough"]) == [True, True, True, True, True, False]
    assert values(spark, T.is_bad_title, [None, "  ", "2024", "报告", "abc", "0" * 8 + "-1111-2222-3333-" + "4" * 12, "A fine title"]) == [True] * 6 + [False]


def test_cleaning_keeps_tables_and_headings(spark):
    body = "# Title\nVIP club\nPage 3\ntext line\nTEXT LINE \n| a | VIP |\n| --- | --- |\n| 1 | 2 |\n\n| a | VIP |\n| --- | --- |\n| 1 | 2 |\n版权所有 x\n"
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r["text"] for r in cleaning.rule_clean(df).collect()}
    assert got[1].startswith("# Title\n club\n") or got[1].startswith("# Title\nclub\n")
    assert got[1].count("| a | VIP |\n| --- | --- |\n| 1 | 2 |") == 2 and "Page 3" not in got[1] and got[1].lower().count("text line") == 1 and got[2] == got[3] == ""
    head = "\n".join(["x"] * 79 + ["主讲人: a", "主讲人: b"])
    assert values(spark, T.remove_head_noise, [head]) == ["\n".join(["x"] * 79 + ["", "主讲人: b"])]
    assert values(spark, T.dedup_lines, ["a\n\nA \nb\na"]) == ["a\nb"]
    assert values(spark, lambda c: T.dedup_lines(c, keep_blank=True), ["a\n\nA \nb\n\na"]) == ["a\n\nb\n"]
    failing = lambda s: 1 / 0
    assert [r["text"] for r in cleaning.model_clean(df, failing).orderBy("id").collect()] == [body, None, ""]


def test_outline(spark):
    got = values(spark, M.outline_item, ["    - 2.2.1 Deep", "1) 3 Three", "#### 1.2 Head", "  1.2.3 bare", "plain", "- ", "## two"])
    shown = [None if x is None else (x["number"], x["title"], x["depth"]) for x in got]
    assert shown == [("2.2.1", "Deep", 2), ("3", "Three", 1), ("1.2", "Head", 2), ("1.2.3", "bare", 2), None, None, None]


def test_chart_ids_and_numbers(spark):
    assert values(spark, hybrid.parse_ids, ['["a", "b", "a"]', "a, b,,a", "[]", "", None]) == [["a", "b"], ["a", "b"], [], [], []]
    assert values(spark, charts.to_number, ["1,234.5", "12%", "n/a", None, "-3"]) == [1234.5, 12.0, None, None, -3.0]
    json = '{"is_chart": true, "chart_type": "bar", "chart_data": {"categories": ["x", " ", "y"], "series": [{"name": "s", "values": ["1"]}, {"name": "t"}]}}'
    df = spark.createDataFrame([(1, json), (2, '{"is_chart": false}'), (3, "{broken"), (4, None)], "chart_id int, json string")
    assert [(r["x"], r["y"]) for r in charts.series_points(df).orderBy("i").collect()] == [("x", 1.0), ("y", None)]
    with pytest.raises(Exception, match="is_chart"):
        df.where("chart_id = 3").select(charts.normalized(F.col("json"), strict=True)).collect()
    edges = '{"is_chart": true, "chart_type": "sankey", "description": "d", "chart_data": {"links": [{"source": "a", "target": "b", "value": 1}, {"source": "b", "target": "c"}, {"source": "c", "target": "a"}]}}'
    row = charts.cycles(spark.createDataFrame([(1, edges)], "chart_id int, json string")).first()
    assert (row["render_type"], row["links_count"], row["nodes_count"], row["cycle"]) == ("graph", 3, 3, "a>b>c>a")


def test_fusion_ties_and_single_lists(spark):
    v = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query_id int, node string, rank int")
    t = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], "query_id int, node string, rank int")
    got = {r["node"]: r["score"] for r in hybrid.fuse(v, t).collect()}
    assert got == {"a": 0.5 / 60, "b": 0.5 / 61 + 0.5 / 60, "c": 0.5 / 61}
    empty = v.limit(0)
    assert {r["node"] for r in hybrid.fuse(v, empty).collect()} == {"a", "b"}
    hits = spark.createDataFrame([(n,) for n in (1, 2, 6, 7)], "h int").select(F.round(hybrid.bonus(F.lit("[]"), F.lit("x"), F.col("h")), 6))
    assert [r[0] for r in hits.collect()] == [0.0, 0.01, 0.05, 0.05]


def test_citations_are_capped(spark):
    rows = spark.createDataFrame([(1, f"n{i}", i, "g", f"s{i % 7}") for i in range(9)] + [(1, "x", 9, None, None)], "query_id int, node string, rank int, group_id string, source string")
    got = {r["node"]: list(r["citations"]) for r in hybrid.dedup_groups(rows).collect()}
    assert got == {"n0": ["s0", "s1", "s2", "s3", "s4"], "x": []}


def test_final_cut(spark):
    rows = [(1, "a", 0, 0, 0.9, False, "g"), (1, "c", 0, 1, 0.9, True, None), (1, "b", 1, 0, 0.1, False, None), (1, "d", 2, 0, 0.9, False, "g"), (1, "e", 3, 0, 0.8, False, None), (1, "late", 3, 1, 0.8, True, None), (1, "f", 4, 0, 0.8, False, None)]
    df = spark.createDataFrame(rows, "query_id int, node string, place int, child int, score double, is_chart boolean, group_id string")
    got = [r["node"] for r in hybrid.final_cut(df, 3, 0.5).orderBy("rank").collect()]
    assert got == ["a", "c", "e", "late"]  # b takes a slot, d repeats a group, f has no slot


def test_predicates(spark):
    df = spark.createDataFrame([(1, "x"), (5, "y"), (9, None)], "a int, b string")
    ids = lambda c: [r["a"] for r in df.where(c).collect()]
    assert ids(predicates.compile({"a": {"$gt": 1, "$lt": 9}})) == [5] and ids(predicates.compile(None)) == [1, 5, 9] and ids(predicates.compile({"b": "x", "a": {"$lte": 5}})) == [1]
    assert ids(predicates.equals({"b": "z"})) == [] and ids(predicates.compile({"a": {"$gt": 1, "$eq": 9}}, first_only=True)) == [9]


def test_search_plan_finds_its_own_text(spark):
    docs = spark.createDataFrame([(i, " ".join(f"topic{i} word{i}x{j}" for j in range(80)), f"src{i % 3}") for i in range(12)] + [(20, None, "s"), (21, "", "s")], "doc_id long, text string, source string")
    kb = search.knowledge_base(docs)
    asked = spark.createDataFrame([(1, "topic7 word7x3"), (2, "nothing known"), (3, "")], "query_id int, query string")
    got = search.search(kb, asked, top_k=2).collect()
    first = [r for r in got if r["query_id"] == 1 and r["rank"] == 0][0]
    assert first["node"].startswith("parent_7_") and first["citations"] == "src1"
    assert all(sum(r["query_id"] == q for r in got) <= 2 for q in (1, 2, 3))
    stats = chunking.statistics(chunking.chunk(docs)).first()
    assert stats["total_chunks"] == sum(stats["chunk_type_distribution"].values())
    none = chunking.statistics(chunking.chunk(docs.limit(0))).first()
    assert (none["total_chunks"], none["total_chars"], none["avg_chunk_size"]) == (0, 0, 0.0)


def test_bm25_on_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x")], "query_id int, query string")
    index = fulltext.build(empty)
    assert index.stats.first()["n"] == 0 and fulltext.search(index, asked, 5).count() == 0


def test_parents_like_the_plain_fold(spark):
    from docengine.functions.sequential import pack_parents

    docs = spark.createDataFrame([(i, "\n\n".join("w" * (37 * (i + j) % 900 + 60) + f"{j}" for j in range(12)), "s") for i in range(6)], "doc_id long, text string, source string")
    chunks = chunking.chunk(docs, size=500)
    _, parents = chunking.parents(chunks, 1500)
    got = {(r["doc_id"], r["content"]) for r in parents.collect()}
    by = {}
    for r in chunks.orderBy("doc_id", "chunk_index").collect():
        by.setdefault(r["doc_id"], []).append(r["content"])
    assert got == {(d, t) for d, c in by.items() for t, _ in pack_parents(c, 1500)}


def test_markdown_tree(spark, tmp_path):
    uid = "0a0a0a0a-1111-2222-3333-444444444444"
    for name, body in ((f"{uid}/pic_to_json/a.md", "# A"), ("x/pic_to_json/b.md", "b"), ("x/other/c.md", "c")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = sorted((r["source_id"] or "", r["text"]) for r in files.markdown(spark, str(tmp_path)).collect())
    assert got == [("", "b"), (uid, "# A")]
    assert files.markdown(spark, str(tmp_path), most=1).count() == 1
    (tmp_path / "x/pic_to_json/d.md").write_text("d")
    with pytest.raises(Exception, match="several files"):
        files.markdown(spark, str(tmp_path)).collect()


def test_decode_images_and_drafts(spark, tmp_path):
    (tmp_path / "images").mkdir()
    for name, body in (("u.txt", "é".encode()), ("b.txt", b"\xef\xbb\xbfx"), ("g.txt", "图表".encode("gb18030")), ("images/p.png", b"1"), ("images/p.gif", b"1"), ("q.png", b"1"), ("d.md", b"text\n# Head\n")):
        (tmp_path / name).write_bytes(body)
    assert sorted(r["text"] for r in files.texts(spark, str(tmp_path), "*.txt").collect()) == ["x", "é", "图表"]
    assert [r["path"].rsplit("/", 1)[-1] for r in files.images(spark, str(tmp_path)).collect()] == ["p.png"]
    assert [r["title"] for r in files.drafts(spark, str(tmp_path)).collect()] == ["Head"]
    assert files.safe_path("/r", "a/./b") == "/r/a/b"
    for bad in ("/etc/x", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            files.safe_path("/r", bad)


def test_stream_and_batch_agree(spark, tmp_path):
    spark.sql("SELECT id event_id, timestamp_seconds(1700000000 + id * 300) ts, id % 3 user_id, if(id % 2 = 0, 'a', 'b') event_type, double(id) value FROM range(200)").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = events.windows(stream, "1 hour", late="30 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("w").collect()) == sorted(events.windows(batch, "1 hour").collect())
    assert events.first_seen(batch.unionByName(batch)).count() == 200 and events.sessions(batch, "10 minutes").count() == 200


def test_tables_in_the_shared_folder(spark):
    df = spark.range(5).selectExpr("id", "string(id) s")
    assert sorted(kept(df, "t").collect()) == sorted(df.collect())


def test_line_dedup_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "a\nA\nb"), (1, "a\nA\nb"), (2, None), (3, " \n\n")], "id int, text string")
    assert sorted(map(tuple, cleaning.dedup_lines(rows).collect()), key=str) == sorted([(1, "a\nb", 2), (1, "a\nb", 2), (2, None, 0), (3, "", 0)], key=str)
    many = spark.createDataFrame([("\n".join(f"line {i % 20_000}" for i in range(60_000)),)], "text string")
    assert cleaning.dedup_lines(many).first()["n_lines"] == 20_000


def test_name_match_by_all_pairs(spark):
    import random

    from docengine.operators import relational as R

    r = random.Random(1)
    name = lambda n: "".join(r.choice("ab ") for _ in range(r.randrange(0, n)))
    left, right = [(i, name(6)) for i in range(60)] + [(90, None)], [(i, name(5)) for i in range(25)] + [(40, None)]
    got = {x["id"]: x["match"] for x in R.name_match(spark.createDataFrame(left, "id int, name string"), spark.createDataFrame(right, "k int, name string"), "name", "k").collect()}
    for i, a in left:
        equal = [k for k, b in right if a is not None and a == b]
        part = [k for k, b in right if a and b and (a in b or b in a)]
        assert got[i] == min(equal or part, default=None), a


def test_nearest_by_all_pairs(spark):
    import random

    from docengine.operators import vectors

    r = random.Random(3)
    made = [(i, [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(50)] + [(50, None), (51, []), (52, [1.0]), (53, [0.0] * 3)]
    asked = [(1, [1.0, 0.0, 1.0]), (2, [0.0, 0.0, 0.0]), (3, [2.0]), (4, None)]
    base = spark.createDataFrame(made, "vec_id int, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], round(x["score"], 6)) for x in vectors.nearest(base, spark.createDataFrame(asked, "query_id int, query_vec array<double>"), 5, digits=6, bound=3).collect()}

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else 0.0

    for q, v in asked:
        best = sorted((-cosine(v, x), i) for i, x in made)[:5]
        assert [got[q, n] for n in range(5)] == [(i, -s) for s, i in best]
    assert vectors.nearest(base.limit(0), spark.createDataFrame(asked, "query_id int, query_vec array<double>"), 5).count() == 0


def test_scan_equals_the_index(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "a dog"), (3, None), (4, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "the dog"), (2, "cat unknown"), (3, "")], "query_id int, query string")
    expected = sorted(map(tuple, fulltext.score(fulltext.build(docs), asked, digits=9).collect()))
    assert sorted(map(tuple, fulltext.scan(docs, asked, digits=9).collect())) == expected and len(expected) == 3
    monkeypatch.setattr(fulltext, "MOST_TERMS", 1)
    assert sorted(map(tuple, fulltext.scan(docs, asked, digits=9).collect())) == expected
