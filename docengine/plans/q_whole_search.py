"""The whole search plan over a knowledge base that SQL can say: each document a chunk, each source a parent with charts of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.operators import fulltext
from docengine.plans import search as S
from docengine.plans.q_search import BM25, SCORE, TOKENS, _asked
from docengine.plans.registry import query, table

_DOCS = "(SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"
TOP, DIM = 4, 8


def one_hot(text):
    """Stand-in for an embedding model: the length of a text modulo DIM; cosines are 0 or 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: (i == F.length(text) % DIM).cast("double"))


def knowledge(spark, sf_dir) -> S.KnowledgeBase:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    none = F.lit(None).cast("string")
    chunks = d.select(F.format_string("d%019d", "doc_id").alias("node"), F.col("doc_id").alias("doc"), "source", F.lit("paragraph").alias("chunk_type"), F.col("source").alias("parent"), F.lit("").alias("group_id"), F.col("text").alias("content"))
    sources = d.select("source").distinct()
    charts = sources.select("source", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select(F.concat(F.lit("chart_"), "source", F.lit("_"), "k").alias("node"), F.lit(None).cast("long").alias("doc"), "source", F.lit("chart").alias("chunk_type"), none.alias("parent"), F.lit("").alias("group_id"), F.concat(F.lit("no. "), "k").alias("content"))
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    ids = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.lit("chart_"), "source", F.lit("_"), k.cast("string"))))
    parents = sources.select(F.col("source").alias("parent"), F.concat(F.lit("All of "), "source", F.when(number % 3 == 0, F.lit(" with images/x.png")).otherwise("")).alias("content"), F.when(number % 2 == 0, ids).alias("chart_ids"), F.lit("").alias("group_id"), "source")
    nodes = chunks.unionByName(charts)
    return S.KnowledgeBase(nodes, parents, fulltext.build(chunks, "node", "content"), chunks.select("node", one_hot(F.col("content")).alias("embedding")))


def by_number(rows):
    """Stand-in for a reranker: scores of sources by their number, none for each fifth."""
    number = F.regexp_extract("node", "[0-9]+", 0).cast("double")
    return rows.withColumn("rerank", F.when(number % 5 != 0, (number * 7) % 11))


_WIDE = 3 * TOP


@query(
    "hyb3_hyb4_search_built",
    f"""WITH {BM25.replace("FROM documents", f"FROM {_DOCS}")}, q AS (SELECT item_id AS query_id, text FROM benchmark), t AS (SELECT query_id, unnest(list_distinct({TOKENS})) AS term FROM q),
    scores AS (SELECT query_id, doc_id, {SCORE} AS score FROM postings JOIN t USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id), stats GROUP BY query_id, doc_id),
    words AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS tr FROM scores WHERE score > 0 QUALIFY tr < {2 * _WIDE}),
    near AS (SELECT q.query_id, d.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY length(d.text) % {DIM} = length(q.text) % {DIM} DESC, d.doc_id) - 1 AS vr FROM q, {_DOCS} d QUALIFY vr < {_WIDE}),
    fused AS (SELECT query_id, doc_id, coalesce(0.5::DOUBLE / (60 + vr), 0) + coalesce(0.5::DOUBLE / (60 + tr), 0) AS score FROM near FULL JOIN words USING (query_id, doc_id)),
    hits AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {_WIDE}),
    up AS (SELECT query_id, source AS node, regexp_extract(source, '[0-9]+')::INT AS number, max(score) AS best, count(*) AS hits FROM hits JOIN documents USING (doc_id) GROUP BY ALL),
    rows AS (SELECT *, best + CASE WHEN number % 2 = 0 THEN 0.03 ELSE 0 END + CASE WHEN number % 3 = 0 THEN 0.02 ELSE 0 END + CASE WHEN hits >= 2 THEN least(0.05, 0.01 * (hits - 1)) ELSE 0 END AS score FROM up),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) - 1 AS r, CASE WHEN number % 5 <> 0 THEN (number * 7) % 11 END AS rerank FROM rows),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN r >= {_WIDE} THEN 2 WHEN rerank IS NULL THEN 1 ELSE 0 END, -rerank, r) - 1 AS place FROM ranked),
    named AS (SELECT query_id, 'chart_' || node || '_' || k AS node, place, k AS child, score FROM placed, generate_series(1, 2) g(k) WHERE number % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, k) <= {max(3, TOP)}),
    every AS (SELECT query_id, node, place, 0 AS child, score, hits, node AS citations, length('All of ' || node || CASE WHEN number % 3 = 0 THEN ' with images/x.png' ELSE '' END) AS chars, false AS is_chart FROM placed
      UNION ALL SELECT query_id, node, place, child, score, 0, '', 5, true FROM named),
    cut AS (SELECT *, sum(CASE WHEN is_chart THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY place, child) AS slot FROM every)
    SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY place, child) - 1 AS rank, round(score, 6) AS score, hits, citations, chars, is_chart FROM cut WHERE slot <= {TOP}""",
)
def whole(spark, sf_dir):
    """Vectors, words, fusion, parents, bonuses, reranking, charts and the final cut for each benchmark item."""
    return S.search(knowledge(spark, sf_dir), _asked(spark, sf_dir), top_k=TOP, embed=one_hot, rerank=by_number, digits=6)
