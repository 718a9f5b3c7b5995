import random

import pytest
from pyspark.sql import functions as F

from docengine.operators import blockmax, fulltext
from docengine.operators.segments import Segments
from docengine.sources.tables import kept

WORDS = [f"w{n}" for n in range(60)]


def documents(spark, n, seed=1, first=0):
    r = random.Random(seed)
    rows = [(first + k, " ".join(r.choice(WORDS[: r.choice([5, 60])]) for _ in range(r.randrange(0, 60)))) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def queries(spark, n=8, seed=2):
    r = random.Random(seed)
    return spark.createDataFrame([(k, " ".join(r.sample(WORDS, r.randrange(1, 6)))) for k in range(n)] + [(99, "nowhere"), (100, ""), (101, "w0")], "query_id long, query string")


def ranked(rows):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect())


def anew(docs, asked, k=5):
    return ranked(fulltext.search(fulltext.build(docs), asked, k, digits=6))


def test_append_delete_compact_and_upsert_rank_as_an_index_built_anew(spark, tmp_path):
    asked = queries(spark)
    index = Segments(spark, f"file://{tmp_path}/index")
    assert index.counts() == (0, 0.0)
    parts = [documents(spark, n, seed, first) for n, seed, first in ((60, 1, 0), (40, 2, 100), (3, 3, 200), (50, 4, 300))]
    held = None
    for part in parts:
        index.append(part, embed=F.array(F.col("doc_id").cast("double"), F.lit(1.0)))
        held = part if held is None else held.unionByName(part)
    assert ranked(index.search(asked, 5, digits=6)[0]) == anew(held, asked)
    gone = held.where("doc_id % 3 = 0")
    assert index.delete(gone) == gone.count()
    assert index.delete(gone) == 0 and index.delete(gone.limit(0)) == 0
    assert index.delete(spark.createDataFrame([(10**9,), (None,)], "doc_id long")) == 0
    left = held.where("doc_id % 3 <> 0")
    assert ranked(index.search(asked, 5, digits=6)[0]) == anew(left, asked)
    changed = left.where("doc_id % 5 = 1").withColumn("text", F.concat(F.lit("w0 w1 "), "text"))
    index.upsert(changed, embed=F.array(F.col("doc_id").cast("double"), F.lit(2.0)))
    left = left.where("doc_id % 5 <> 1").unionByName(changed)
    assert ranked(index.search(asked, 5, digits=6)[0]) == anew(left, asked)
    # another reader sees the same version
    other = Segments(spark, f"file://{tmp_path}/index")
    assert other.manifest == index.manifest and other.counts() == index.counts()
    assert index.counts()[0] == left.count()
    before = len(index.manifest.segments)
    while index.compact(2):
        pass
    assert len(index.manifest.segments) < before
    assert ranked(index.search(asked, 5, digits=6)[0]) == anew(left, asked)
    assert sorted(r["id"] for r in index.live("vectors").collect()) == sorted(r["doc_id"] for r in left.collect())
    near = index.nearest(spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vec array<double>"), 1).first()
    assert near["rank"] == 0
    # a version that exists is not written over
    with pytest.raises(Exception):
        index.append(documents(spark, 1, 9, 900)), other.append(documents(spark, 1, 9, 901))


def test_a_deletion_reads_no_postings_and_a_search_no_other_segment(spark, tmp_path, monkeypatch):
    index = Segments(spark, f"file://{tmp_path}/index")
    index.append(documents(spark, 30))
    read = []
    table = Segments.table
    monkeypatch.setattr(Segments, "table", lambda self, part, names=None: (read.append(part), table(self, part, names))[1])
    assert index.delete(spark.createDataFrame([(3,), (4,)], "doc_id long")) == 2
    assert read == ["bags"]


def test_compaction_drops_tombstones_that_concern_no_segment(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/index")
    for k in range(2):
        index.append(documents(spark, 10, k, 100 * k))
    index.delete(spark.createDataFrame([(1,), (101,)], "doc_id long"))
    assert index.counts()[0] == 18 and index.compact(2) == 1
    assert index.manifest.graves == {} and index.counts()[0] == 18 and list(index.manifest.segments.values())[0][0] == 18
    index.delete(documents(spark, 10).unionByName(documents(spark, 10, 1, 100)))
    assert index.counts() == (0, 0.0)
    assert index.search(queries(spark), 3)[0].count() == 0


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_blocks_that_are_left_out_change_nothing(spark, shard):
    """One hot word, rare words, and small blocks: most blocks of the hot word are not read."""
    r = random.Random(5)
    rows = [(k, " ".join(["hot"] * r.randrange(1, 4) + [f"rare{r.randrange(100)}" for _ in range(r.randrange(1, 30))])) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(k, f"hot rare{k} rare{k + 1}") for k in range(10)], "query_id long, query string")
    index = fulltext.build(docs)
    bags = kept(fulltext.bags(docs), "bags")
    held = kept(blockmax.blocks(bags, index.terms, size=8, shard=shard), "blocks")
    wanted = kept(fulltext._wanted(asked).join(index.terms.select("term", "idf"), "term"), "asked")
    best, counters = blockmax.search(held, bags, wanted, index.stats.first()["avgdl"], 5, digits=6)
    assert ranked(best) == anew(docs, asked)
    for c in counters.collect():
        assert c["read"] < 0.6 * c["blocks"] and c["candidates"] < 800
    if shard < 100:
        assert held.where("term = 'hot'").select("shard").distinct().count() > 10


def test_bags_count_tokens(spark):
    rows = spark.createDataFrame([(1, "b a b 中 a b"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["dl"], [tuple(x) for x in r["bag"]]) for r in fulltext.bags(rows).orderBy("doc_id").collect()] == [(1, 6, [("a", 2), ("b", 3), ("中", 1)]), (2, 0, []), (3, 0, [])]
