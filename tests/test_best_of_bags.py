"""The k best rows by words from bags of terms: as by joins with postings, and without shuffling all matches or storing texts twice."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import fulltext
from docengine.plans import search


def corpus(spark, n=400, copies=60):
    r = random.Random(3)
    words = [f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(20000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 40))) for _ in range(n)] + ["w1 w2 w3 w1 w0"] * copies
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(q, " ".join(r.choice(words) for _ in range(r.randrange(1, 12)))) for q in range(50)] + [(50, "w1 w2 w3"), (51, "nowhere"), (52, ""), (53, "w0 w0 w59")]
    return docs, spark.createDataFrame(asked, "query_id int, query string")


@pytest.mark.parametrize("k, scores, entries, block", [(7, 1 << 20, 1 << 21, 10_000), (3, 54 * 20, 300, 10_000), (1000, 1 << 20, 1 << 21, 20)])
def test_best_equals_joins(spark, monkeypatch, k, scores, entries, block):
    docs, asked = corpus(spark)
    monkeypatch.setattr(fulltext, "MOST_SCORES", scores)
    monkeypatch.setattr(fulltext, "MOST_ENTRIES", entries)
    monkeypatch.setattr(fulltext, "MOST_QUERIES", block)
    index = fulltext.build(docs)
    plain = fulltext.Index(index.postings, index.lengths, index.terms, index.stats)
    allowed = docs.where("doc_id % 3 != 0")
    for only in (None, allowed):
        got, want = (sorted(map(tuple, fulltext.search(x, asked, k, allowed=only, digits=6).select("query_id", "rank", "doc_id", "score").collect())) for x in (index, plain))
        assert got == want and len(want) > 100
    exact = {(r["query_id"], r["doc_id"]): r["score"] for r in fulltext.score(plain, asked).collect()}
    found = fulltext.search(index, asked, k).collect()
    assert all(abs(exact[r["query_id"], r["doc_id"]] - r["score"]) < 1e-9 for r in found)
    same = [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 50 and 400 <= r["doc_id"] < 460]
    assert same == sorted(same)  # copies have one score to the last bit and come by id


def test_no_match(spark):
    docs, asked = corpus(spark)
    assert fulltext.search(fulltext.build(docs), asked.where("query_id = 51"), 5).collect() == []
    assert fulltext.search(fulltext.build(docs.limit(0)), asked, 5).collect() == []


def test_matches_are_not_shuffled(spark):
    docs, asked = corpus(spark, 2000, 0)
    found = fulltext.search(fulltext.build(docs), asked, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "HashAggregate" not in plan


def test_texts_are_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("docengine.sources.tables.shared_folder", lambda s: str(tmp_path))
    r = random.Random(5)
    docs = spark.createDataFrame([(i, f"s{i % 3}", "\n\n".join(" ".join(f"w{r.randrange(500)}" for _ in range(60)) for _ in range(12))) for i in range(30)], "doc_id long, source string, text string")
    charts = docs.select("doc_id", F.lit("c1").alias("stem"), F.lit('{"is_chart": "yes", "_chart_name": "Chart 1"}').alias("json"))
    for some in (None, charts):
        kb = search.knowledge_base(docs, charts=some)
        best = search.search(kb, spark.createDataFrame([(1, "w1 w2 w3")], "query_id int, query string"), top_k=2)
        assert best.count() >= 2
    left = {f.rsplit("-", 1)[0] for f in os.listdir(tmp_path)}
    assert {"nodes", "passages", "bags"} <= left and not left & {"chunks", "parents", "all-nodes", "postings"}


def test_texts_are_normalized_without_patterns_for_each_character(spark):
    r = random.Random(1)
    letters = "aB é\t\n\r\x0b\x0c\x85\xa0 　，。；：、,.!?:;\"'“”‘’（）()【】[]{}<>\\-^&_中"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(500)] + ["", " ", "。，!"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", T.normalize_for_fingerprint(F.col("t")).alias("n"))
    want = lambda t: re.sub(r"\s+", " ", re.sub("[，。；：、,.!?:;\"'“”‘’（）()【】\\[\\]{}<>]+", " ", re.sub(r"\s+", " ", (t or "").strip().lower()))).strip()
    assert all(x["n"] == want(x["t"]) for x in rows.collect())
    assert "translate" in rows._jdf.queryExecution().executedPlan().toString()
