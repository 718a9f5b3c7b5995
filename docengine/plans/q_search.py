"""Queries: BM25, vector search, fusion and the whole hybrid plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import chart_links, fulltext, hybrid, predicates, vectors
from docengine.plans import search as S
from docengine.plans.registry import query, table

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+|[、-〿㐀-䶿一-鿿]')"
BM25 = f"""
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, len({TOKENS}) AS dl FROM documents),
stats AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM lengths),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
"""
SCORE = "round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6)"


@query(
    "bm25_topk",
    f"""WITH {BM25}, scores AS (SELECT doc_id, {SCORE} AS score FROM postings JOIN terms USING (term) JOIN lengths USING (doc_id), stats WHERE term IN ('the', 'and', 'of') GROUP BY doc_id)
    SELECT doc_id, score, round(score / (score + 1), 6) AS score_norm FROM scores WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""",
)
def bm25_topk(spark, sf_dir):
    """The flagship: the 20 best documents for three words."""
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(1, "the and of the")], "query_id int, query string")
    found = fulltext.scan(docs, asked, digits=6)
    return found.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score", F.round(F.col("score") / (F.col("score") + 1), 6).alias("score_norm"))


@query("agg1_term_frequency", f"WITH {BM25} SELECT doc_id, term, tf FROM postings")
def agg1(spark, sf_dir):
    return fulltext.term_frequencies(table(spark, sf_dir, "documents"))


@query("agg2_agg4_terms", f"WITH {BM25} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM terms, stats")
def agg2(spark, sf_dir):
    return fulltext.build(table(spark, sf_dir, "documents")).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query("agg3_stats", f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def agg3(spark, sf_dir):
    return fulltext.build(table(spark, sf_dir, "documents")).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(
    "fts3_benchmark_search",
    f"""WITH {BM25}, q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
    scores AS (SELECT query_id, doc_id, {SCORE} AS score FROM postings JOIN q USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id), stats GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scores WHERE score > 0) WHERE rank < 10""",
)
def fts3(spark, sf_dir):
    """Each benchmark item as a query over all documents."""
    return fulltext.search(fulltext.build(table(spark, sf_dir, "documents")), _asked(spark, sf_dir), 10, digits=6).select("query_id", "doc_id", "score", "rank")


@query(
    "flt3_filtered_bm25",
    f"""WITH {BM25}, scores AS (SELECT doc_id, {SCORE} AS score FROM postings JOIN terms USING (term) JOIN lengths USING (doc_id), stats WHERE term IN ('the', 'of') GROUP BY doc_id)
    SELECT doc_id, score FROM scores JOIN documents d USING (doc_id) WHERE score > 0 AND d.lang = 'en' AND d.source = 'src1' ORDER BY score DESC, doc_id LIMIT 10""",
)
def flt3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(1, "the of")], "query_id int, query string")
    allowed = docs.where(predicates.equals({"lang": "en", "source": "src1"})).select("doc_id")
    return fulltext.search(fulltext.build(docs), asked, 10, allowed=allowed, digits=6).select("doc_id", "score")


_DOT = "list_aggregate(list_transform(generate_series(1, 64), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE), 'sum')"
_NORM = "sqrt(list_aggregate(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum'))"
_COS = f"round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 6)"


@query(
    "vec2_knn_topk",
    f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)
    SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s) WHERE rank < 10""",
)
def vec2(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return vectors.nearest(base, asked, 10, digits=6)


@query(
    "flt1_knn_filtered",
    f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.label >= 2 AND a.label < 5 AND a.vec_id <> 7)
    SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s) WHERE rank < 10""",
)
def flt1(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    where = predicates.compile({"label": {"$gte": 2, "$lt": 5}, "vec_id": {"$ne": 7}})
    return vectors.nearest(base, asked, 10, where=where, digits=6)


@query("flt2_first_operator", "SELECT vec_id FROM embeddings WHERE label > 2")
def flt2(spark, sf_dir):
    """Of several operators on one key only the first counts, where asked."""
    return table(spark, sf_dir, "embeddings").where(predicates.compile({"label": {"$lt": 4, "$gt": 2}}, first_only=True)).select("vec_id")


@query(
    "vec1_normalize",
    f"SELECT a.vec_id, round(list_aggregate(list_transform(a.embedding, lambda x: abs(x::DOUBLE)), 'sum') / {_NORM.format('a')}, 6) AS l1 FROM embeddings a",
)
def vec1(spark, sf_dir):
    unit = vectors.normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


@query("vec3_cosine_edges", "SELECT * FROM (VALUES ('empty', 0.0), ('length', 0.0), ('null', 0.0), ('opposite', -1.0), ('same', 1.0), ('zero', 0.0)) v(kind, score)")
def vec3(spark, sf_dir):
    rows = [("empty", [], []), ("length", [1.0], [1.0, 2.0]), ("null", None, [1.0]), ("opposite", [1.0, 0.0], [-2.0, 0.0]), ("same", [1.0, 2.0], [2.0, 4.0]), ("zero", [0.0, 0.0], [1.0, 1.0])]
    pairs = spark.createDataFrame(rows, "kind string, a array<double>, b array<double>")
    return pairs.select("kind", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query(
    "vec4_auto_merge",
    """WITH h AS (SELECT vec_id AS id, vec_id // 10 AS parent, (vec_id % 7) / 10.0 AS score FROM embeddings WHERE vec_id % 10 < (vec_id // 10) % 6),
    c AS (SELECT parent, count(*) AS n, avg(score) AS mean FROM h GROUP BY parent), s AS (SELECT vec_id // 10 AS parent, count(*) AS size FROM embeddings GROUP BY 1),
    m AS (SELECT parent, mean FROM c JOIN s USING (parent) WHERE n / size > 0.25)
    SELECT CAST(parent AS VARCHAR) AS node, round(mean, 6) AS score, true AS merged FROM m
    UNION ALL SELECT CAST(id AS VARCHAR), round(score, 6), false FROM h WHERE parent NOT IN (SELECT parent FROM m)""",
)
def vec4(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 10").alias("parent"))
    hits = base.where("id % 10 < parent % 6").select(F.lit(1).alias("query_id"), "id", ((F.col("id") % 7) / 10.0).alias("score"))
    return vectors.auto_merge(hits, base).select("node", F.round("score", 6).alias("score"), "merged")


#: Two ranked lists of documents for each benchmark item: by BM25, and by the nearest vectors of the vector of the same number.
LISTS = f"""{BM25}, q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
scores AS (SELECT query_id, doc_id AS node, {SCORE} AS score FROM postings JOIN q USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id), stats GROUP BY query_id, doc_id),
t AS (SELECT query_id, node, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) - 1 AS rank FROM scores WHERE score > 0) WHERE rank < 30),
vs AS (SELECT b.vec_id AS query_id, a.vec_id AS node, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark)),
v AS (SELECT query_id, node, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) - 1 AS rank FROM vs) WHERE rank < 30),
f AS (SELECT query_id, node, v.rank AS vector_rank, t.rank AS text_rank, coalesce(0.5 / (60 + v.rank), 0) + coalesce(0.5 / (60 + t.rank), 0) AS score FROM v FULL JOIN t USING (query_id, node))"""


def lists(spark, sf_dir):
    found = fulltext.search(fulltext.build(table(spark, sf_dir, "documents")), _asked(spark, sf_dir), 30, digits=6)
    base = table(spark, sf_dir, "embeddings")
    asked = base.join(F.broadcast(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))), "vec_id", "left_semi")
    near = vectors.nearest(base, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), 30, digits=6)
    return near.select("query_id", F.col("vec_id").alias("node"), "rank"), found.select("query_id", F.col("doc_id").alias("node"), "rank")


@query("hyb1_jn3_fusion", f"WITH {LISTS} SELECT query_id, node, vector_rank, text_rank, round(score, 9) AS score FROM f")
def hyb1(spark, sf_dir):
    v, t = lists(spark, sf_dir)
    return hybrid.fuse(v, t).select("query_id", "node", "vector_rank", "text_rank", F.round("score", 9).alias("score"))


@query(
    "win1_fused_rank",
    f"WITH {LISTS} SELECT query_id, node, rank FROM (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node) - 1 AS rank FROM f)",
)
def win1(spark, sf_dir):
    v, t = lists(spark, sf_dir)
    return hybrid.ranked(hybrid.fuse(v, t).withColumn("score", F.round("score", 9))).select("query_id", "node", "rank")


@query(
    "set1_ordered_union",
    f"""WITH {LISTS}, a AS (SELECT query_id, node, 0 AS l, rank FROM v UNION ALL SELECT query_id, node, 1, rank FROM t),
    m AS (SELECT query_id, node, min(l * 1000 + rank) AS met FROM a GROUP BY query_id, node)
    SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY met, node) - 1 AS position FROM m""",
)
def set1(spark, sf_dir):
    return hybrid.ordered_union(*lists(spark, sf_dir))


#: Fused hits promoted to parents of eight documents each; every seventh document is a chart.
PROMOTED = f"""{LISTS}, p AS (SELECT query_id, CASE WHEN node // 8 % 5 <> 4 THEN 'p' || CAST(node // 8 AS VARCHAR) ELSE CAST(node AS VARCHAR) END AS node, round(score, 9) AS score FROM f WHERE node % 7 <> 0),
g AS (SELECT query_id, node, max(score) AS score, round(sum(score), 9) AS score_sum, count(*) AS hits FROM p GROUP BY query_id, node)"""


def promoted(spark, sf_dir):
    v, t = lists(spark, sf_dir)
    fused = hybrid.fuse(v, t).select("query_id", F.col("node").cast("string").alias("node"), F.round("score", 9).alias("score"))
    base = table(spark, sf_dir, "documents").select("doc_id").union(table(spark, sf_dir, "embeddings").select("vec_id")).distinct()
    nodes = base.select(F.col("doc_id").cast("string").alias("node"), F.when(F.col("doc_id") % 7 == 0, "chart").alias("chunk_type"), F.concat(F.lit("p"), F.expr("doc_id div 8").cast("string")).alias("parent"))
    parents = base.select(F.expr("doc_id div 8").alias("n")).distinct().where("n % 5 != 4").select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("parent"))
    return hybrid.aggregate(hybrid.promote(fused, nodes, parents))


@query("jn1_agg5_promoted", f"WITH {PROMOTED} SELECT * FROM g")
def jn1(spark, sf_dir):
    return promoted(spark, sf_dir).select("query_id", "node", "score", F.round("score_sum", 9).alias("score_sum"), "hits")


@query(
    "hyb2_bonus",
    f"""WITH {PROMOTED} SELECT query_id, node, round(score + CASE WHEN hits % 2 = 0 THEN 0.03 ELSE 0 END + CASE WHEN node LIKE '%1%' THEN 0.02 ELSE 0 END + CASE WHEN hits >= 2 THEN least(0.05, 0.01 * (hits - 1)) ELSE 0 END, 6) AS score FROM g""",
)
def hyb2(spark, sf_dir):
    g = promoted(spark, sf_dir)
    ids = F.when(F.col("hits") % 2 == 0, '["c1"]').otherwise(" [] ")
    text = F.when(F.col("node").contains("1"), "see images/x.png").otherwise("plain")
    return g.select("query_id", "node", F.round(F.col("score") + hybrid.bonus(ids, text, F.col("hits")), 6).alias("score"))


#: Documents ranked by length within their language, grouped by the first character pair of their text.
RANKED = "r AS (SELECT lang AS query_id, doc_id AS node, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lower(substr(text, 1, 2)) END AS group_id, source FROM documents)"


def ranked_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("node"), F.col("n_chars").alias("score"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.lower(F.substring("text", 1, 2))).alias("group_id"), "source")
    return hybrid.ranked(d)


@query(
    "agg7_citation_merge",
    f"""WITH {RANKED}, k AS (SELECT *, CASE WHEN group_id <> '' THEN group_id ELSE '#' || CAST(node AS VARCHAR) END AS key FROM r),
    m AS (SELECT query_id, key, source, min(rank) AS met FROM k GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY met, source) AS n FROM m),
    s AS (SELECT query_id, key, string_agg(source, ',' ORDER BY met, source) AS citations FROM c WHERE n <= 5 GROUP BY query_id, key),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank) AS n FROM k)
    SELECT query_id, node, rank, citations FROM f JOIN s USING (query_id, key) WHERE n = 1""",
)
def agg7(spark, sf_dir):
    return hybrid.dedup_groups(ranked_docs(spark, sf_dir)).select("query_id", "node", "rank", F.array_join("citations", ",").alias("citations"))


@query(
    "top7_rerank_merge",
    f"""WITH {RANKED}, x AS (SELECT query_id, node, rank, CASE WHEN rank >= 20 THEN 2 WHEN node % 5 = 0 THEN 1 ELSE 0 END AS tier, node % 97 AS rerank FROM r)
    SELECT query_id, node, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 0 THEN -rerank ELSE 0 END, rank) - 1 AS place FROM x) WHERE place < 25""",
)
def top7(spark, sf_dir):
    rows = ranked_docs(spark, sf_dir).withColumn("rerank", F.when(F.col("node") % 5 != 0, F.col("node") % 97))
    return hybrid.rerank_merge(rows, 20, 25).select("query_id", "node", "place")


@query(
    "jn4_jsn9_chart_children",
    f"""WITH {RANKED}, top AS (SELECT query_id, node, rank AS place FROM r WHERE rank < 10),
    e AS (SELECT query_id, place, i AS met, CASE i WHEN 1 THEN node % 13 WHEN 2 THEN node % 7 ELSE node % 3 END AS c FROM top, (VALUES (1), (2), (3)) v(i)),
    d AS (SELECT query_id, place, c, min(met) AS met FROM e GROUP BY ALL), k AS (SELECT * FROM d WHERE c <> 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY place, met) AS n FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY met) AS child FROM o WHERE n = 1),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, child) AS m FROM p WHERE child <= 2)
    SELECT query_id, CAST(node AS VARCHAR) AS node, place, 0 AS child FROM top UNION ALL SELECT query_id, 'c' || CAST(c AS VARCHAR), place, child FROM s WHERE m <= 8""",
)
def jn4(spark, sf_dir):
    top = ranked_docs(spark, sf_dir).where("rank < 10").withColumnRenamed("rank", "place").withColumn("score", F.lit(0.0))
    name = lambda k: F.concat(F.lit("c"), (F.col("node") % k).cast("string"))
    ids = F.when(F.col("node") % 2 == 0, F.concat_ws(" , ", name(13), name(7), name(3))).otherwise(F.to_json(F.array(name(13), name(7), name(3))))
    charts = spark.range(13).where("id != 2").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chart"))
    rows = top.withColumn("chart_ids", ids).withColumn("node", F.col("node").cast("string"))
    return hybrid.expand_charts(rows, charts, 8, 2).select("query_id", "node", "place", "child")


@query(
    "top6_flt10_final_cut",
    f"""WITH {RANKED}, x AS (SELECT query_id, node, rank AS place, node % 4 = 0 AS is_chart, (node % 10) / 10.0 AS score, CASE WHEN group_id <> '' THEN group_id ELSE '#' || CAST(node AS VARCHAR) END AS key FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY place) AS n FROM x), s AS (SELECT *, sum(CASE WHEN is_chart THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY place) AS slot FROM o WHERE n = 1)
    SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS rank FROM s WHERE slot <= 15 AND (is_chart OR score >= 0.3)""",
)
def top6(spark, sf_dir):
    rows = ranked_docs(spark, sf_dir).withColumn("score", (F.col("node") % 10) / 10.0)
    rows = rows.select("query_id", "node", F.col("rank").alias("place"), F.lit(0).alias("child"), "score", (F.col("node") % 4 == 0).alias("is_chart"), "group_id")
    return hybrid.final_cut(rows, 15, 0.3).select("query_id", "node", "rank")


@query("hyb6_chart_caps", "SELECT k, least(12, greatest(3, k)) AS total FROM generate_series(1, 50) t(k)")
def hyb6(spark, sf_dir):
    return spark.range(1, 51).select(F.col("id").alias("k"), hybrid.default_chart_caps(F.col("id")).alias("total"))


@query(
    "win5_unique_documents",
    f"WITH {RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM r) SELECT query_id, node, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM o WHERE n = 1) WHERE k <= 5",
)
def win5(spark, sf_dir):
    return S.pick_unique(ranked_docs(spark, sf_dir), "source", 5).select("query_id", "node", "k")


@query(
    "agg6_best_of_indexes",
    """WITH i AS (SELECT doc_id AS node, 'a' AS name, n_chars % 100 AS score FROM documents UNION ALL SELECT doc_id, 'b', n_chars % 37 FROM documents WHERE doc_id % 2 = 0)
    SELECT node, max(score) AS score, arg_max(name, score * 10 + CASE name WHEN 'a' THEN 1 ELSE 0 END) AS name FROM i GROUP BY node""",
)
def agg6(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("node"), F.lit("a").alias("name"), (F.col("n_chars") % 100).alias("score"))
    b = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("node"), F.lit("b").alias("name"), (F.col("n_chars") % 37).alias("score"))
    return S.best_of([a, b])


@query("hyb4_search")
def hyb4(spark, sf_dir):
    """The whole plan over chunks of the documents and their charts: each benchmark item asks; vectors and reranking come from hooks."""
    docs, charts = with_charts(spark, sf_dir)
    return S.search(S.knowledge_base(docs.withColumnRenamed("body", "text"), charts=charts), _asked(spark, sf_dir), top_k=5)


#: Every document names two charts of its own: one by an image, one by a summary line; charts with numbers 3 of 7 are none.
CHARTS_SQL = """d AS (SELECT doc_id, source, coalesce(text, '') || chr(10) || '![x](./images/c' || doc_id % 7 || '.png) and ![y](other/c1.png)' || chr(10) || '[图表]  CHART  ' || (doc_id * 3) % 5 || ' ' || chr(10) || 'end' AS body FROM documents),
    c AS (SELECT doc_id, 'c' || k AS stem, 'Chart ' || k AS name, k FROM documents, generate_series(0, 6) t(k) WHERE k <> 3)"""


def with_charts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    number = lambda n: (n).cast("string")
    lines = F.concat(F.lit("\n![x](./images/c"), number(F.col("doc_id") % 7), F.lit(".png) and ![y](other/c1.png)\n[图表]  CHART  "), number(F.col("doc_id") * 3 % 5), F.lit(" \nend"))
    docs = d.select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), lines).alias("body"))
    k = F.col("k").cast("string")
    data = F.concat(F.lit('{"series": [{"name": "s'), k, F.lit('"}]}'))
    json = F.to_json(F.struct(F.when(F.col("k") == 3, "no").otherwise("yes").alias("is_chart"), F.lit("bar").alias("chart_type"), F.concat(F.lit("Chart "), k).alias("_chart_name"), F.concat(F.lit("about "), k).alias("description"), data.alias("chart_data")))
    charts = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).select("doc_id", F.concat(F.lit("c"), k).alias("stem"), json.alias("json"))
    return docs, charts


@query(
    "jn5_chart_ids",
    f"""WITH {CHARTS_SQL},
    r AS (SELECT doc_id, unnest(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS ref FROM d),
    s AS (SELECT doc_id, regexp_replace(regexp_extract(ref, '[^/]*$'), '\\.[^.]*$', '') AS key FROM r WHERE regexp_replace(ref, '^(\\./)+', '') LIKE 'images/%'),
    n AS (SELECT doc_id, lower(trim(regexp_replace(unnest(regexp_extract_all(body, '(?m)^\\[图表\\]\\s*(.+?)\\s*$', 1)), '\\s+', ' ', 'g'))) AS key FROM d),
    f AS (SELECT s.doc_id, 'chart_' || stem AS node FROM s JOIN c ON c.doc_id = s.doc_id AND c.stem = s.key UNION SELECT n.doc_id, 'chart_' || stem FROM n JOIN c ON c.doc_id = n.doc_id AND lower(c.name) = n.key)
    SELECT doc_id, string_agg(node, ',' ORDER BY node) AS chart_ids FROM f GROUP BY doc_id""",
)
def jn5(spark, sf_dir):
    """The charts that each document names, by image and by name."""
    docs, charts = with_charts(spark, sf_dir)
    found = chart_links.chart_ids(docs.select(F.col("doc_id").alias("text_id"), "doc_id", "body"), chart_links.usable(charts), "text_id", "body")
    return found.select(F.col("text_id").alias("doc_id"), F.array_join("chart_ids", ",").alias("chart_ids"))


@query(
    "jn6_chart_summaries",
    f"""WITH {CHARTS_SQL} SELECT d.doc_id, CASE WHEN c.stem IS NULL THEN 0 ELSE 1 END AS n_injected,
    md5(CASE WHEN c.stem IS NULL THEN body ELSE replace(replace(body, chr(13) || chr(10), chr(10)), 'c' || d.doc_id % 7 || '.png) and ![y](other/c1.png)', 'c' || d.doc_id % 7 || '.png) and ![y](other/c1.png)' || chr(10) || '[图表] ' || c.name || chr(10) || 'type: bar' || chr(10) || 'description: about ' || c.k || chr(10) || 'legend: s' || c.k) END) AS body
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id AND c.stem = 'c' || d.doc_id % 7""",
)
def jn6(spark, sf_dir):
    """Summaries of charts below their images."""
    docs, charts = with_charts(spark, sf_dir)
    return chart_links.inject_summaries(docs, chart_links.usable(charts), "body").select("doc_id", "n_injected", F.md5("body").alias("body"))


@query("hyb5_vec5_index_tables")
def hyb5(spark, sf_dir):
    """Row counts of the tables of a knowledge base."""
    kb = S.knowledge_base(table(spark, sf_dir, "documents"))
    parts = {"chunks": kb.chunks, "parents": kb.parents, "postings": kb.index.postings, "terms": kb.index.terms, "vectors": kb.vectors}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("vec5_delete_by_source", "SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def vec5(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return S.without(d, d.where(F.col("source").isin("src1", "src2")).select("doc_id"), "doc_id").select("doc_id")


def line_base(spark, sf_dir):
    """A knowledge base whose chunks are whole documents: what it holds, SQL can say."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    nodes = d.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("doc"), "source", F.when(F.col("doc_id") % 9 == 0, "table").otherwise("paragraph").alias("chunk_type"), F.col("source").alias("parent"), F.lit("").alias("group_id"), F.col("text").alias("content"))
    parents = d.select(F.col("source").alias("parent"), "source").distinct()
    return S.KnowledgeBase(nodes, parents, fulltext.build(nodes, "node", "content"), nodes.select("node", S.hashed_embedding(F.col("content")).alias("embedding")))


@query("vec5_collection_info", "SELECT source, CASE WHEN doc_id % 9 = 0 THEN 'table' ELSE 'paragraph' END AS chunk_type, count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(*) AS vectors FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def vec5_info(spark, sf_dir):
    return S.collection_info(line_base(spark, sf_dir))


_LEFT = "(SELECT * FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND source NOT IN ('src1', 'src2'))"


@query("vec5_delete_source_terms", f"WITH {BM25.replace('FROM documents', f'FROM {_LEFT}')} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM terms, stats")
def vec5_delete_terms(spark, sf_dir):
    """Weights of the terms after the chunks of two sources are gone."""
    gone = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return S.delete_by_source(line_base(spark, sf_dir), gone).index.terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(
    "vec5_delete_by_query",
    f"""WITH {BM25.replace('FROM documents', 'FROM (SELECT * FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)')}, scores AS (SELECT doc_id, {SCORE} AS score FROM postings JOIN terms USING (term) JOIN lengths USING (doc_id), stats WHERE term IN ('the', 'of') GROUP BY doc_id),
    gone AS (SELECT doc_id FROM scores WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 1000) SELECT doc_id AS node FROM lengths WHERE doc_id NOT IN (SELECT doc_id FROM gone)""",
)
def vec5_delete_query(spark, sf_dir):
    """Nodes that stay when the thousand best of a query are deleted."""
    asked = spark.createDataFrame([(1, "the of")], "query_id int, query string")
    return S.delete_by_query(line_base(spark, sf_dir), asked).chunks.select("node")


@query(
    "agg16_coverage",
    f"""WITH {BM25}, q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
    scores AS (SELECT query_id, doc_id, {SCORE} AS score FROM postings JOIN q USING (term) JOIN terms USING (term) JOIN lengths USING (doc_id), stats GROUP BY query_id, doc_id),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM scores WHERE score > 0) WHERE n <= 10 AND doc_id % 3 <> 0)
    SELECT item_id AS query_id, count(h.doc_id) AS hits, max(score) AS max_score, coalesce(max(score), 0) < 20 AS uncovered FROM benchmark b LEFT JOIN h ON h.query_id = b.item_id GROUP BY item_id""",
)
def agg16(spark, sf_dir):
    """Hits of each item without documents already used (FLT-11), and whether it is uncovered."""
    found = fulltext.search(fulltext.build(table(spark, sf_dir, "documents")), _asked(spark, sf_dir), 10, digits=6)
    used = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id")
    return S.coverage(_asked(spark, sf_dir).select("query_id"), found.join(used, "doc_id", "left_anti"), 20.0)
