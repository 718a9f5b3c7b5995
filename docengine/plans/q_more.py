"""Queries: single steps of the larger plans, and hooks with deterministic stubs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from docengine.functions import markdown as M
from docengine.functions import sequential as S
from docengine.functions import text as T
from docengine.operators import charts as C
from docengine.operators import chunking, cleaning, fulltext, vectors
from docengine.operators.cleaning import _INT, map_text
from docengine.plans import search
from docengine.plans.q_json import grid_charts
from docengine.plans.q_search import BM25, SCORE, TOKENS
from docengine.plans.registry import query, table
from docengine.sources import files
from docengine.sources.tables import shared_folder

_MIXED = "concat('Heading of ', source, chr(10), chr(10), 'x = `code`', chr(10), chr(10), '| a | b |', chr(10), '| --- | --- |', chr(10), '| 1 | 2 |', chr(10), chr(10), text)"


def mixed(spark, sf_dir):
    """Documents with a heading, inline code and a table before their text."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Heading of "), "source", F.lit("\n\nx = `code`\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n"), "text").alias("text"))


@query("arr1_null_padding", "SELECT n_nationkey, n_regionkey, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS v FROM nation")
def arr1(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.get(F.array(F.lit("a"), F.lit("b")), F.col("n_regionkey")).alias("v"))


@query("chk2_blocks", """SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE 1 END AS code, CASE WHEN text IS NULL THEN 0 ELSE 1 END AS tables FROM documents WHERE text IS NOT NULL""")
def chk2(spark, sf_dir):
    """Code and table blocks of each document."""
    found = map_text(mixed(spark, sf_dir), "text", lambda r: S.blocks(r["text"]), [StructField("kind", StringType())])
    return found.groupBy("doc_id").agg(F.count_if(F.col("kind") == "code").cast("int").alias("code"), F.count_if(F.col("kind") == "table").cast("int").alias("tables"))


@query("chk3_heading_rule", r"SELECT p_partkey, regexp_matches(line, '^(#{1,6}\s+|[\w一-鿿].{0,50}$)') AS heading FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '## ' || repeat(p_name, 9) WHEN 1 THEN repeat(p_name || ' ', 9) ELSE p_name END AS line FROM part)")
def chk3(spark, sf_dir):
    k, n = F.col("p_size") % 3, F.col("p_name")
    line = F.when(k == 0, F.concat(F.lit("## "), F.repeat(n, 9))).when(k == 1, F.repeat(F.concat(n, F.lit(" ")), 9)).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", line.rlike(r"(?U)^(?:#{1,6}\s+|[\w一-鿿].{0,50}$)").alias("heading"))


@query("chk4_merged_blocks")
def chk4(spark, sf_dir):
    found = map_text(mixed(spark, sf_dir), "text", lambda r: S.merge_small(S.blocks(r["text"]), 100), [StructField("kind", StringType())])
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("chk5_chk6_block_chunks")
def chk5(spark, sf_dir):
    """Chunks of unmerged blocks, with nominal offsets."""

    def apply(r: dict) -> list[tuple]:
        return [(c.content, c.index, c.kind, c.start, c.end) for c in S.chunks_of(S.blocks(r["text"]), 600, 100)]

    fields = [StructField("chunk_index", _INT), StructField("kind", StringType()), StructField("start_char", _INT), StructField("end_char", _INT)]
    return map_text(mixed(spark, sf_dir), "text", apply, fields).select("doc_id", "chunk_index", "kind", "start_char", "end_char", F.md5("text").alias("content"))


@query("chk13_batch", "SELECT source, count(*) AS documents FROM documents WHERE length(trim(text, ' ' || chr(10))) > 0 GROUP BY source")
def chk13(spark, sf_dir):
    return chunking.chunk(table(spark, sf_dir, "documents"), "length").groupBy("source").agg(F.countDistinct("doc_id").alias("documents"))


@query("cln7_cln8_table_spans", f"SELECT doc_id, 1 AS n_tables, md5(replace({_MIXED}, concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| 1 | 2 |', chr(10)), '#')) AS text FROM documents")
def cln7(spark, sf_dir):
    """Tables out of the text, a mark in their place."""
    held = map_text(mixed(spark, sf_dir), "text", lambda r: [S.protect_tables(r["text"])], [StructField("tables", StringType())])
    return held.select("doc_id", F.size(F.from_json("tables", "array<string>")).alias("n_tables"), F.md5(F.regexp_replace("text", "\\x00TABLE_BLOCK_\\d+\\x00", "#")).alias("text"))


@query("cln13_segment_hook", "SELECT doc_id, md5(trim(text, ' ' || chr(10)) || chr(10) || chr(10) || '![i](images/x.png)' || chr(10) || chr(10) || 'tail') AS text FROM documents")
def cln13(spark, sf_dir):
    """Text segments through the model hook one by one, stripped, blank ones dropped, order kept."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\n "), "text", F.lit(" \n![i](images/x.png)\n tail \n")).alias("text"))
    apply = lambda r: [("\n\n".join(p for p in (s.strip() for _, s in S.segments(r["text"])) if p),)]
    return map_text(rows, "text", apply, []).select("doc_id", F.md5("text").alias("text"))


@query("cln19_deleted_images", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'see  and ![b](images/keep.png)' ELSE 'see ![a](images/' || doc_id || '.png) and ![b](images/keep.png)' END AS text FROM documents")
def cln19(spark, sf_dir):
    """References to deleted images go; the deleted set is a table."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see ![a](images/"), F.col("doc_id").cast("string"), F.lit(".png) and ![b](images/keep.png)")).alias("text"))
    deleted = d.where("doc_id % 2 = 0").select(F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("ref"))
    return cleaning.remove_images(d, deleted, "text", "doc_id")


@query(
    "cln20_orchestration",
    """SELECT doc_id, text IS NOT NULL AND doc_id % 5 <> 0 AS success, CASE WHEN text IS NULL THEN 'no text' WHEN doc_id % 5 = 0 THEN 'model failed' END AS error,
    CASE WHEN text IS NULL THEN 0 ELSE length('Page ' || doc_id || chr(10) || 'Keep' || chr(10) || 'keep' || chr(10) || 'id ' || doc_id) END AS original_chars, CASE WHEN text IS NOT NULL THEN md5('Keep' || chr(10) || 'id ' || doc_id || CASE WHEN doc_id % 5 <> 0 THEN '!' ELSE '' END) END AS text FROM documents""",
)
def cln20(spark, sf_dir):
    """Rule stage, model stage, statistics; a failing model and a missing text are rows without success."""
    name = F.col("doc_id").cast("string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.concat(F.lit("Page "), name, F.lit("\nKeep\nkeep\nid "), name)).alias("text"))

    def model(text: str) -> str:
        if int(text.rsplit(" ", 1)[1]) % 5 == 0:
            raise ValueError("model failed")
        return f"{text}!"

    return cleaning.clean_documents(d, model).select("doc_id", "success", "error", "original_chars", F.md5("text").alias("text"))


@query("fts2_index", f"WITH {BM25} SELECT (SELECT count(*) FROM postings) AS postings, (SELECT count(*) FROM terms) AS terms, (SELECT CAST(sum(dl) AS BIGINT) FROM lengths) AS tokens")
def fts2(spark, sf_dir):
    index = fulltext.build(table(spark, sf_dir, "documents"))
    return index.postings.agg(F.count("*").alias("postings")).crossJoin(index.terms.agg(F.count("*").alias("terms"))).crossJoin(index.lengths.agg(F.sum("dl").alias("tokens")))


_ONE = f"WITH {BM25}, scores AS (SELECT doc_id, {SCORE} AS score FROM postings JOIN terms USING (term) JOIN lengths USING (doc_id), stats WHERE term IN ('the', 'of') GROUP BY doc_id)"


@query("fts4_fallback_score", f"{_ONE} SELECT doc_id, round(1 / (1 + abs(score)), 6) AS score FROM scores ORDER BY scores.score DESC, doc_id LIMIT 50")
def fts4(spark, sf_dir):
    asked = spark.createDataFrame([(1, "the of")], "query_id int, query string")
    found = fulltext.search(fulltext.build(table(spark, sf_dir, "documents")), asked, 50, digits=6)
    return found.select("doc_id", F.round(1 / (1 + F.abs("score")), 6).alias("score"))


@query("fts5_two_indexes")
def fts5(spark, sf_dir):
    """Two indexes asked at once; the best score of each document counts."""
    d = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(1, "the of")], "query_id int, query string")
    parts = [fulltext.search(fulltext.build(d.where(F.col("doc_id") % 3 != k)), asked, 30, digits=6).select(F.col("doc_id").alias("node"), F.lit(str(k)).alias("name"), "score") for k in (0, 1)]
    return search.best_of(parts)


@query("top1_top2_overfetch", f"{_ONE} SELECT doc_id, score FROM scores WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 60")
def top1(spark, sf_dir):
    """Twice three times the ten that are wanted."""
    asked = spark.createDataFrame([(1, "the of")], "query_id int, query string")
    return fulltext.search(fulltext.build(table(spark, sf_dir, "documents")), asked, 2 * 3 * 10, digits=6).select("doc_id", "score")


@query("top3_vector_topk", "WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, round(list_aggregate(list_transform(generate_series(1, 64), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE), 'sum'), 5) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def top3(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return vectors.nearest(e, asked, 10, digits=5).select("query_id", "vec_id", "score")


@query("hyb3_rerank_hook")
def hyb3(spark, sf_dir):
    """The search plan with a reranker stub: shorter parents first."""
    kb = search.knowledge_base(table(spark, sf_dir, "documents"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search(kb, asked, top_k=3, rerank=lambda rows: rows.withColumn("rerank", -F.length("content").cast("double")))


@query("win4_first_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), k AS (SELECT doc_id, pos, lower(trim(line)) AS k FROM l) SELECT doc_id, min(pos) AS pos FROM k WHERE k <> '' GROUP BY doc_id, k")
def win4(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line")).withColumn("k", F.lower(T.strip(F.col("line")))).where("k != ''")
    first = F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("pos"))
    return lines.withColumn("n", first).where("n = 1").select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"))


@query("set4_token_overlap", f"WITH t AS (SELECT item_id, list_distinct({TOKENS}) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS both, len(list_distinct(list_concat(a.t, b.t))) AS either FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def set4(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    pairs = t.alias("a").join(t.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return pairs.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.size(F.array_intersect("a.t", "b.t")).cast("long").alias("both"), F.size(F.array_union("a.t", "b.t")).cast("long").alias("either"))


@query("num2_clamps", "SELECT event_id, round(sqrt(ln(1 + abs(value))), 6) AS v, least(20.0, greatest(5.0, value)) AS clamped FROM events")
def num2(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sqrt(F.log(1 + F.abs(v))), 6).alias("v"), F.least(F.lit(20.0), F.greatest(F.lit(5.0), v)).alias("clamped"))


@query("prj3_title_override", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '.v2' ELSE 'A good title' END AS title FROM documents")
def prj3(spark, sf_dir):
    """A bad title gives way to the file name's stem."""
    title = F.when(F.col("doc_id") % 2 == 0, "12345").otherwise("A good title")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(T.is_bad_title(title), files.stem(F.concat("source", F.lit(".v2.pdf")))).otherwise(title).alias("title"))


@query("src11_drafts", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Draft ' || item_id END AS title FROM benchmark")
def src11(spark, sf_dir):
    root = f"{shared_folder(spark)}/drafts-{uuid.uuid4().hex}"
    body = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("# Draft "), F.col("item_id").cast("string"))).otherwise("no heading")
    table(spark, sf_dir, "benchmark").select("item_id", body.alias("value")).write.partitionBy("item_id").text(root)
    found = files.drafts(spark, root, "*.txt").select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "title")
    return found.select("item_id", F.when(F.col("title").startswith("Draft "), F.col("title")).alias("title"))


@query(
    "jsn10_layout_captions",
    """SELECT p_partkey, image_path, CASE image_path WHEN 'a.png' THEN 'Figure ' || p_partkey || ' ' || p_name WHEN 'b.png' THEN p_brand END AS caption FROM part, (VALUES ('a.png'), ('b.png'), ('c.png')) v(image_path)""",
)
def jsn10(spark, sf_dir):
    """Captions of images in nested layouts: by group number, repeated texts once, the first block of an image."""
    body = lambda path, group: f'{{"type": "image_body", "group_id": {group}, "lines": [{{"spans": [{{"image_path": "{path}"}}]}}]}}'
    head = '{"pdf_info": [{"preproc_blocks": [{"type": "text"}, {"type": "image", "blocks": [' + body("a.png", 1) + ", " + body("b.png", 2)
    parts = [F.lit(head + ', {"type": "image_caption", "group_id": 1, "lines": [{"spans": [{"content": " Figure "}, {"text": "'), F.col("p_partkey").cast("string"), F.lit('"}]}]}, {"type": "image_title", "group_id": 1, "content": "'), F.col("p_name")]
    parts += [F.lit('"}, {"type": "image_title", "group_id": 1, "content": "'), F.col("p_name"), F.lit('"}, {"type": "image_caption", "group_id": 2, "content": "'), F.col("p_brand"), F.lit('"}]}]}, {}, {"preproc_blocks": [{"type": "image", "blocks": [' + body(" c.png ", "null") + ']}, {"type": "image", "blocks": [' + body("a.png", "null") + ', {"type": "image_caption", "content": "later"}]}]}]}')]
    return C.layout_captions(table(spark, sf_dir, "part").select("p_partkey", F.concat(*parts).alias("layout")), "layout", "p_partkey")


@query(
    "jn9_prune_references",
    """SELECT p_partkey, p_size % 2 = 0 OR p_size % 3 = 0 AS changed, '{' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '"cover": "images/a.png", ' END || '"pages": [' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '{"n": 1, "img": ["./images/b.png"]}, ' END || '{"n": 2, "t": "' || p_name || '"}]}' AS json FROM part""",
)
def jn9_prune(spark, sf_dir):
    """JSON of any depth without references to removed images."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"cover": "images/a.png", "pages": [{"n": 1, "img": ["./images/b.png"]}, {"n": 2, "t": "'), "p_name", F.lit('"}]}'))
    removed = p.where("p_size % 2 = 0").select("p_partkey", F.lit("images/a.png").alias("ref")).unionByName(p.where("p_size % 3 = 0").select("p_partkey", F.lit("images/b.png").alias("ref")))
    return cleaning.prune_references(p.select("p_partkey", text.alias("json")), removed, "json", "p_partkey")


@query("jsn11_chart_names", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN 'alt' ELSE 'chart' END AS name FROM part")
def jsn11(spark, sf_dir):
    k = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select("p_partkey", C.chart_name(F.when(k == 0, F.col("p_name")), F.when(k <= 1, F.col("p_brand")), F.when(k == 2, F.lit(" alt ")), F.lit(None).cast("string"), F.lit("chart")).alias("name"))


@query("jsn15_candidates", "SELECT p_partkey AS id, 'image' AS kind FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'structure' FROM part WHERE p_size % 2 = 0")
def jsn15(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    images = p.where(T.is_chart_image(F.when(F.col("p_size") % 3 == 0, "chart").otherwise("photo"), F.lit("x.png"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    structures = p.where(F.when(F.col("p_size") % 2 == 0, "table").otherwise("text").isin("table", "figure", "chart"))
    return images.select(F.col("p_partkey").alias("id"), F.lit("image").alias("kind")).unionByName(structures.select(F.col("p_partkey").alias("id"), F.lit("structure").alias("kind")))


@query("jsn16_jsn18_extraction_hook", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'chart' WHEN 1 THEN 'non_chart' ELSE 'error' END AS status FROM part")
def jsn16(spark, sf_dir):
    """Each image through a model hook (a stub): chart, non_chart or error."""

    def model(size: str) -> dict | None:
        if int(size) % 3 == 2:
            raise ValueError("no answer")
        return {"is_chart": int(size) % 3 == 0}

    return C.extract(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("image")), model, "image").select("p_partkey", "status")


@query("jsn17_strict_flag", "SELECT p_partkey, p_size % 2 = 0 AS is_chart FROM part")
def jsn17(spark, sf_dir):
    json = F.to_json(F.struct((F.col("p_size") % 2 == 0).alias("is_chart"), F.lit("d").alias("description"), F.lit("bar").alias("chart_type"), F.array().cast("array<string>").alias("chart_data")))
    return table(spark, sf_dir, "part").select("p_partkey", C.normalized(json, strict=True)["is_chart"].alias("is_chart"))


@query("rnd1_chart_options")
def rnd1(spark, sf_dir):
    """Chart options and blocks from series points: labels, series in order, a container for each chart."""
    return C.options(C.series_points(grid_charts(spark, sf_dir, "bar"))).select("chart_id", "option", "block")


@query("ctl7_structured_section", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'plain ' || role END AS content FROM conversations")
def ctl7(spark, sf_dir):
    """A section from a model's JSON, or its text where it is no JSON."""
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"content": "'), "role", F.lit('"}'))).otherwise(F.concat(F.lit("plain "), "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.get_json_object(answer, "$.content"), answer).alias("content"))


@query("str2_all_items")
def str2_all(spark, sf_dir):
    """Items of whole outlines, exploded in order."""
    text = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "p_name"))), "\n").alias("t"))
    return text.select("p_brand", F.posexplode(M.outline_items(F.col("t"))).alias("pos", "i")).select("p_brand", "pos", "i.title", "i.depth")
