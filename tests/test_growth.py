"""Results that stay whole and right on larger tables: order of sums, classes of copies, one shuffle of contents."""

from collections import Counter

from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import bands, fulltext, hybrid, setjoin
from docengine.operators.ivf import InvertedFile
from tests.test_similar_joins import close, vectors


def test_bonuses_are_added_one_after_the_other(spark):
    best = 0.5 / 60 + 0.5 / 69
    rows = [("a", best, '["c"]', "images/", 1), ("b", best, "[]", "images/", 4), ("c", best, '["c"]', "", 3)]
    df = spark.createDataFrame(rows, "node string, best double, ids string, text string, hits long")
    got = {r["node"]: r["s"] for r in df.select("node", hybrid.bonus(F.col("ids"), F.col("text"), F.col("hits"), F.col("best")).alias("s")).collect()}
    assert got == {"a": best + 0.03 + 0.02 + 0.0, "b": best + 0.0 + 0.02 + 0.03, "c": best + 0.03 + 0.0 + 0.02}
    assert got["a"] == got["c"] > got["b"]  # added as one sum, all three tie


def test_strip_looks_at_the_ends_only(spark):
    texts = ["", None, "a", " \t\n\r\x0b\x0c\x85\xa0       　 ", "　a \n b\x85", "​a​", "\x1ca\x1f", " a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s"))
    assert df.where(~F.col("s").eqNullSafe(F.regexp_replace("t", r"(?U)^\s++|(?<!\s)\s++$", ""))).count() == 0
    assert "regexp" not in df._jdf.queryExecution().toString()  # a pattern is tried at every character


def test_copies_of_a_set_make_no_pairs(spark, monkeypatch):
    sets = [["t1", "t2", "t3"], ["t3", "t2", "t1"], ["t1", "t2", "t4"], ["t9"], []]
    rows = [(g, k * 5 + i, t) for g in ("g", "h") for k in range(40) for i, t in enumerate(sets)] + [("g", 900, ["t1", "t2", "t3", "t4"]), (None, 901, ["t9"])]
    df = spark.createDataFrame(rows, "group string, id long, tokens array<string>")
    pairs = []
    similar = setjoin.similar

    def seen(*args, **options):
        found = similar(*args, **options)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(setjoin, "similar", seen)
    for apart in (True, False):
        want = {}
        for g, i, x in rows:
            for h, j, y in rows:
                if g is not None and g == h and x and y and not (apart and i == j):
                    s = round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)
                    if s >= 0.3:
                        want[g, i] = min(want.get((g, i), (0, 0)), (-s, j))
        assert sorted(map(tuple, setjoin.best(df, df, 0.3, apart).collect())) == sorted((g, i, j, -s) for (g, i), (s, j) in want.items())
    assert max(pairs) < 20


def test_links_and_first_of_close_without_pairs(spark, monkeypatch):
    rows = [*vectors(250, 4, 6), *[(1000 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(60)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for part in (1 << 20, 3000):  # all at once, and in several passes
        monkeypatch.setattr(bands, "PART", part)
        near = close(rows, 0.9, 6)
        links = Counter(x for pair in near for x in pair)
        got = {r["vec_id"]: (r["class"], r["links"]) for r in bands.links(df, 0.9).collect()}
        assert {i: n for i, (_, n) in got.items() if n} == links and got[1059][0] == 1000 and {900, 901} & set(got) and 902 not in got
        stays, pairs = [], set(near)
        for i in sorted(i for i, _ in rows):
            if not any((j, i) in pairs for j in stays):
                stays.append(i)
        assert sorted(r["vec_id"] for r in bands.first_of_close(df, 0.9).collect()) == stays


def test_tasks_drop_rows_beyond_k_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, f"common word {i}") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common"), (2, "word 7")], "query_id int, query string")
    found = fulltext.search(fulltext.build(docs), asked, 3)
    assert found._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2  # in part, then finally
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in found.collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 7), (2, 1, 0), (2, 2, 1)]


def test_queries_of_a_stored_inverted_file_come_once(spark, tmp_path):
    base = spark.createDataFrame(vectors(200, 6), "vec_id long, embedding array<double>")
    lists = InvertedFile.build(base, str(tmp_path / "lists"), lists=9)
    asked = base.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    x, names, places = lists._asked(asked, 9)
    assert len(x) == len(names) == asked.where("query_id <> 905").count()  # not once for each list
    few = lists._asked(asked, 3)[2]
    assert sum(map(len, few.values())) == 3 * len(x) and len(places) == 9
