"""Patterns that one odd text must not slow down: the same results as the plain patterns, and a megabyte in seconds."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import documents as D


def texts(n=1500, seed=3):
    r = random.Random(seed)
    signs = ["\n", "\n", " ", "\t", "1", "23", "-", "...", "....", "x", "第", "页", "汇报人", "：", "目", "录", "\r\n", "　", "1. a b", "---"]
    return ["".join(r.choice(signs) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def both(spark, a, b, rows):
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    return [(r["t"], r["a"], r["b"]) for r in df.select("t", a(F.col("t")).alias("a"), b(F.col("t")).alias("b")).collect() if r["a"] != r["b"]]


def plainly(t, patterns=T.NOISE_PATTERNS):
    for p in patterns:
        t = F.regexp_replace(t, f"(?mdU){p}", "")
    return t


def test_noise_as_by_the_plain_patterns(spark):
    assert both(spark, T.remove_noise, plainly, texts()) == []
    assert both(spark, lambda t: T.remove(t, T.HEAD_NOISE_PATTERNS, "mdU"), lambda t: plainly(t, T.HEAD_NOISE_PATTERNS), texts(seed=4)) == []


def test_noise_test_as_by_the_plain_patterns(spark):
    def plain(t):
        s = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
        found = (s == "")
        for p in T.AD_PATTERNS:
            found = found | s.rlike(f"(?iu){p}")
        for p in T.NOISE_PATTERNS:
            found = found | ((F.length(s) < 20) & s.rlike(f"(?mdU){p}")) | s.rlike(f"(?mdU)^(?:{p})$")
        for p in T.HEAD_NOISE_PATTERNS:
            found = found | s.rlike(f"(?mdU){p}")
        return found

    assert both(spark, T.is_noise, plain, texts(seed=5) + [x + "\n" + "long line of words and more words" for x in texts(400, 6)]) == []


def test_strip_as_by_the_plain_pattern(spark):
    assert both(spark, T.strip, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), texts(seed=7)) == []


MEGABYTE = 1 << 20


@pytest.mark.parametrize("piece", ["\n", " ", "\n1x", "1\n", " \n", "...\n", "12  x\n", "1. \n", "<p>", "<p> ", "&nbsp;", "</p>", "<p>.</p>"])
def test_a_megabyte_of_anything(spark, piece):
    long = "<section><div class='section-content'><p>" + piece * (MEGABYTE // len(piece)) + "x</p></div></section>"
    df = spark.createDataFrame([(long,)], "t string")
    began = time.monotonic()
    df.select(F.length(T.remove_noise(F.col("t"))), T.is_noise(F.col("t")), F.length(T.strip(F.col("t"))), F.length(T.normalize_whitespace(F.col("t"))), D.html_quality(F.col("t"))).collect()
    assert time.monotonic() - began < 20


def test_paragraphs_with_and_without_text(spark):
    def places(html):
        r = spark.createDataFrame([(html,)], "t string").select(D.text_at(F.col("t")), D.chart_at(F.col("t"))).first()
        return tuple(r)

    assert places("<p>...</p><P> <b>&nbsp;</b> </p><p>x</p>") == (len("<p>...</p><P> <b>&nbsp;</b> </p>") + 1, 0)
    assert places("a</p><p>one <p>two</p>") == (6, 0)
    assert places("<p>open") == (0, 0) and places("") == (0, 0)
    single, double = "<div class='chart-container'>", '<div class="chart-container">'
    assert places(double + single)[1] == len(double) + 6
    assert places("é😀<p>" + double + "x</p>") == (3, 3 + 3 + 5)


def test_bags_of_candidates_are_read_once(spark, monkeypatch, tmp_path):
    from docengine.operators import blockmax
    from docengine.operators.segments import Segments

    docs = spark.createDataFrame([(i, f"common word{i % 7} other{i % 3} " * (1 + i % 4)) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"common word{q} other{q % 3}") for q in range(6)], "query_id int, query string")
    index = Segments(spark, str(tmp_path / "index"))
    index.append(docs)
    want = None
    for most in (blockmax.MOST_ROWS, 1):  # few candidates, many
        monkeypatch.setattr(blockmax, "MOST_ROWS", most)
        best = index.search(asked, 5, digits=6)[0]
        plan = best._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        at = next(i for i, x in enumerate(plan) if "Generate explode(bag" in x)
        below = plan[at + 1 : next((i for i in range(at + 1, len(plan)) if depth(plan[i]) <= depth(plan[at])), len(plan))]
        assert below and not any("query_id" in x for x in below)  # a bag is not copied for each query
        got = sorted(map(tuple, best.collect()))
        want = got if want is None else want
        assert got == want and len(got) == 30


def test_collapse_and_anchors_take_a_text_apart_once(spark):
    from docengine.operators import anchors as A

    texts = ["", None, " ", "a b", "a  b", "a \t b\n\nc", "\x85a\xa0b　 c", "a\x1cb​c \n", "　a  b  "] + ["x".join(w) for w in zip(T.WHITE, T.WHITE[1:] + " ")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.select(T.collapse(F.col("t")).alias("a"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("b"))
    assert same.where("NOT (a <=> b)").count() == 0
    md = F.concat(F.lit("intro [Chart: c1]\n\n"), "t", F.lit("\n\nlast words \n"))
    some = [A.charts(F.array(F.lit("c1")), F.create_map(F.lit("c1"), F.lit("last words"))), A.charts(F.array(F.lit("c2"), F.lit("c3")))]
    both = df.select(A.place_each(md, some).alias("p"), *[A.place_anchors(md, w).alias(f"p{i}") for i, w in enumerate(some)])
    assert both.where("NOT (p[0] <=> p0 AND p[1] <=> p1)").count() == 0 and both.where("p[0] LIKE '%last words%c1%'").count() == len(texts) - 1
    plan = df.select(A.place_each(md, some).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("#{1,6}") == 1 and "(?U)\\s+" not in plan
