"""Queries over built texts whose results SQL can say: chunking, merging, packing, cleaning, outlines, HTML and differences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from docengine.functions import sequential as S
from docengine.operators import charts as C
from docengine.operators import chunking, cleaning, fulltext
from docengine.operators.cleaning import _INT, map_text
from docengine.plans import search
from docengine.plans.q_json import grid_charts
from docengine.plans.q_search import BM25, SCORE
from docengine.plans.registry import query, table

_NL = "chr(10)"
#: A text for each part: two paragraphs and a table between them. SQL names of its pieces: p.one, p.grid, p.two.
_PIECES = f"""p AS (SELECT p_partkey, p_name, 'Intro on ' || p_name || ', which is long enough so that nobody takes this first paragraph for a heading of anything.' AS one,
'| a | b |' || {_NL} || '| --- | --- |' || {_NL} || '| 1 | ' || p_name || ' |' AS grid, 'Last paragraph on ' || p_name || ', which again is long enough so that it is a paragraph and no heading at all.' AS two FROM part)"""


def built(spark, sf_dir):
    n = F.col("p_name")
    one = F.concat(F.lit("Intro on "), n, F.lit(", which is long enough so that nobody takes this first paragraph for a heading of anything."))
    grid = F.concat(F.lit("| a | b |\n| --- | --- |\n| 1 | "), n, F.lit(" |"))
    two = F.concat(F.lit("Last paragraph on "), n, F.lit(", which again is long enough so that it is a paragraph and no heading at all."))
    return table(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("source"), F.concat_ws("\n\n", one, grid, two).alias("text"))


def chunks(df, *args, **options):
    return chunking.chunk(df, *args, id="p_partkey", **options).select("p_partkey", "chunk_index", "chunk_type", "content", "start_char", "end_char", "truncated")


_CHUNK = "p_partkey, CAST({i} AS INTEGER) AS chunk_index, '{kind}' AS chunk_type, {text} AS content, CAST({a} AS INTEGER) AS start_char, CAST({a} + length({text}) AS INTEGER) AS end_char, false AS truncated"


@query(
    "chk1_chk7_built",
    f"WITH {_PIECES} SELECT {_CHUNK.format(i=0, kind='paragraph', text='one', a='0')} FROM p UNION ALL SELECT {_CHUNK.format(i=1, kind='table', text='grid', a='(length(one) - 10)')} FROM p UNION ALL SELECT {_CHUNK.format(i=2, kind='paragraph', text='two', a='(length(one) + length(grid) - 20)')} FROM p",
)
def chk1(spark, sf_dir):
    """Structure-aware chunks: a table stands alone where the whole is too long."""
    return chunks(built(spark, sf_dir), "structure_aware", size=140, overlap=10, least=10)


@query("chk1_one_chunk", f"WITH {_PIECES}, w AS (SELECT p_partkey, concat_ws({_NL} || {_NL}, one, grid, two) AS t FROM p) SELECT {_CHUNK.format(i=0, kind='paragraph', text='t', a='0')} FROM w")
def chk1_one(spark, sf_dir):
    return chunks(built(spark, sf_dir), "structure_aware")


@query("chk2_blocks_built", f"WITH {_PIECES} SELECT p_partkey, one AS text, 'paragraph' AS kind FROM p UNION ALL SELECT p_partkey, grid, 'table' FROM p UNION ALL SELECT p_partkey, two, 'paragraph' FROM p")
def chk2(spark, sf_dir):
    return map_text(built(spark, sf_dir).select("p_partkey", "text"), "text", lambda r: S.blocks(r["text"]), [StructField("kind", StringType())])


@query("chk4_merged_built", f"WITH {_PIECES} SELECT p_partkey, one AS text, 'paragraph' AS kind FROM p UNION ALL SELECT p_partkey, grid || {_NL} || {_NL} || two, 'paragraph' FROM p")
def chk4(spark, sf_dir):
    """The short table joins the paragraph behind it."""
    return map_text(built(spark, sf_dir).select("p_partkey", "text"), "text", lambda r: S.merge_small(S.blocks(r["text"]), 100), [StructField("kind", StringType())])


@query(
    "chk5_chk6_built",
    f"""WITH {_PIECES}, c AS (SELECT p_partkey, 0 AS i, 'paragraph' AS kind, one AS t, 0 AS a FROM p UNION ALL SELECT p_partkey, 1, 'table', grid, length(one) - 20 FROM p UNION ALL SELECT p_partkey, 2, 'paragraph', substr(two, 1, 70), length(one) + length(grid) - 40 FROM p WHERE length(two) > 140)
    SELECT p_partkey, count(*) AS n, md5(string_agg(kind || ':' || a || ':' || t, '|' ORDER BY i)) AS listed FROM c WHERE i < 2 GROUP BY p_partkey""",
)
def chk5(spark, sf_dir):
    """Chunks of unmerged blocks with nominal offsets: the first two of each text."""

    def apply(r: dict) -> list[tuple]:
        return [(c.content, c.index, c.kind, c.start) for c in S.chunks_of(S.blocks(r["text"]), 140, 20)]

    fields = [StructField("i", _INT), StructField("kind", StringType()), StructField("a", _INT)]
    rows = map_text(built(spark, sf_dir).select("p_partkey", "text"), "text", apply, fields).where("i < 2")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat_ws(":", "kind", "a", "text").alias("s")))), lambda x: x["s"]), "|")
    return rows.groupBy("p_partkey").agg(F.count("*").alias("n"), F.md5(listed).alias("listed"))


@query(
    "chk8_semantic_built",
    "SELECT p_partkey, CAST(0 AS INTEGER) AS chunk_index, 'alpha ' || p_name || '. alpha ' || p_name || '.' AS content FROM part UNION ALL SELECT p_partkey, 1, 'omega omega. omega omega.' FROM part",
)
def chk8(spark, sf_dir):
    """A cut where neighbouring sentences share no word."""
    n = F.col("p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("source"), F.concat(F.lit("alpha "), n, F.lit(". alpha "), n, F.lit(". omega omega. omega omega.")).alias("text"))
    return chunking.chunk(rows, "semantic", id="p_partkey").select("p_partkey", "chunk_index", "content")


@query(
    "chk9_sentence_built",
    """WITH s AS (SELECT p_partkey, 'First sentence on ' || p_name || '.' AS a, 'Second sentence on ' || p_name || '! Third one here?' AS b FROM part)
    SELECT p_partkey, CAST(0 AS INTEGER) AS chunk_index, a AS content, CAST(0 AS INTEGER) AS start_char, CAST(length(a) AS INTEGER) AS end_char FROM s UNION ALL SELECT p_partkey, 1, b, CAST(length(a) + 1 AS INTEGER), CAST(length(a) + 1 + length(b) AS INTEGER) FROM s""",
)
def chk9(spark, sf_dir):
    n = F.col("p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("source"), F.concat(F.lit("First sentence on "), n, F.lit(". Second sentence on "), n, F.lit("! Third one here?")).alias("text"))
    return chunking.chunk(rows, "sentence", size=52, id="p_partkey").select("p_partkey", "chunk_index", "content", "start_char", "end_char")


@query(
    "chk10_length_built",
    "WITH t AS (SELECT p_partkey, repeat('abcdefghij', 3) || p_partkey AS t FROM part) SELECT p_partkey, CAST(i AS INTEGER) AS chunk_index, substr(t, i * 10 + 1, 12) AS content FROM t, generate_series(0, 3) g(i) WHERE i = 0 OR i * 10 + 2 < length(t)",
)
def chk10(spark, sf_dir):
    """Length chunks without a boundary to cut at: fixed windows that overlap by two."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("x").alias("source"), F.concat(F.lit("abcdefghij" * 3), F.col("p_partkey").cast("string")).alias("text"))
    return chunking.chunk(rows, "length", size=12, overlap=2, id="p_partkey").select("p_partkey", "chunk_index", "content")


@query(
    "chk14_parents_built",
    "SELECT 'parent_' || p_partkey || '_' || g AS parent, p_partkey AS doc_id, CAST(2 AS INTEGER) AS n_chunks, md5(repeat('x', 1000) || chr(10) || chr(10) || repeat('x', 1000)) AS content FROM part, generate_series(0, 2) t(g)",
)
def chk14(spark, sf_dir):
    """Six chunks of a thousand characters make three parents; a chart and a blank chunk between them have none."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("chunk_index"))
    content = F.when(F.col("chunk_index") == 3, "  ").otherwise(F.repeat(F.lit("x"), 1000))
    made = rows.select("doc_id", "chunk_index", F.when(F.col("chunk_index") == 5, "chart").otherwise("paragraph").alias("chunk_type"), content.alias("content"), F.lit("s").alias("source"))
    return chunking.parents(made)[1].select("parent", "doc_id", "n_chunks", F.md5("content").alias("content"))


@query("agg11_statistics_built", """SELECT 3 * count(*) AS total_chunks, CAST(sum(10 + 2 * length(p_name)) AS BIGINT) AS total_chars, round(sum(10 + 2 * length(p_name)) / (3 * count(*)), 6) AS avg_chunk_size, '{"chart":' || count(*) || ',"table":' || 2 * count(*) || '}' AS types FROM part""")
def agg11(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kinds = p.select(F.lit("chart").alias("chunk_type"), F.repeat(F.lit("y"), 10).alias("content")).unionByName(p.select(F.explode(F.array(F.lit("table"), F.lit("table"))).alias("chunk_type"), F.col("p_name").alias("content")))
    return chunking.statistics(kinds).select("total_chunks", F.col("total_chars").cast("long").alias("total_chars"), F.round("avg_chunk_size", 6).alias("avg_chunk_size"), F.to_json("chunk_type_distribution").alias("types"))


@query("chk11_merge_built", "SELECT p_partkey, CAST(0 AS INTEGER) AS part, 'One ' || p_name || '.' AS piece FROM part UNION ALL SELECT p_partkey, 1, ' Two ' || p_name || '.' FROM part UNION ALL SELECT p_partkey, 2, ' Three ' || p_name || '.' FROM part")
def cln11(spark, sf_dir):
    """Sentences that do not fit together in 15 characters."""
    n = F.col("p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("One "), n, F.lit(". Two "), n, F.lit(". Three "), n, F.lit(".")).alias("t"))
    return cleaning.pack(rows, "t", 15).select("p_partkey", "part", "piece")


@query(
    "cln9_segments_built",
    f"""SELECT p_partkey, CAST(i AS INTEGER) AS position, ['text', 'image', 'text', 'table', 'text', 'chart', 'text'][i + 1] AS kind, ['Start ' || p_name || {_NL}, '![x](images/' || p_partkey || '.png)', {_NL}, '| a | b |' || {_NL} || '| --- | --- |' || {_NL} || '| 1 | 2 |' || {_NL}, {_NL}, '```mermaid' || {_NL} || 'x' || {_NL} || '```', {_NL} || 'end'][i + 1] AS segment FROM part, generate_series(0, 6) t(i)""",
)
def cln9(spark, sf_dir):
    t = F.concat(F.lit("Start "), "p_name", F.lit("\n![x](images/"), F.col("p_partkey").cast("string"), F.lit(".png)\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```mermaid\nx\n```\nend"))
    return cleaning.segments(table(spark, sf_dir, "part").select("p_partkey", t.alias("text"))).select("p_partkey", "position", "kind", "segment")


@query("cln1_rule_clean_built", f"SELECT p_partkey, 'Keep ' || p_name || {_NL} || '| a | b |' || {_NL} || '| --- | --- |' || {_NL} || '| VIP | VIP |' || {_NL} || '| VIP | VIP |' || {_NL} || {_NL} || 'end' AS text FROM part")
def cln1(spark, sf_dir):
    """Page numbers, repeated and blank lines go; a table stays as it is, repeated rows and adverts in it too."""
    t = F.concat(F.lit("Keep "), "p_name", F.lit("\n\n\n\nPage 3\nkeep  "), "p_name", F.lit("\n| a | b |\n| --- | --- |\n| VIP | VIP |\n| VIP | VIP |\n\nend"))
    return cleaning.rule_clean(table(spark, sf_dir, "part").select("p_partkey", t.alias("text")))


@query("cln17_orphan_items_built", f"SELECT doc_id, md5('# One' || {_NL} || text || {_NL} || '- Two' || {_NL} || '    inside') AS body, CAST(1 AS INTEGER) AS removed FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?m)^\\s*(#|[-*] |[0-9])')")
def cln17(spark, sf_dir):
    """Whole texts below a heading whose list item is an orphan."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").where(~F.col("text").rlike(r"(?m)^\s*(?:#|[-*] |[0-9])"))
    rows = rows.select("doc_id", F.concat(F.lit("- One\n\n# One\n"), "text", F.lit("\n- Two\n    inside")).alias("body"), F.lit("- One\n- Two").alias("skeleton"))
    return cleaning.strip_outline_items(rows, "body", "skeleton", orphans=True).select("doc_id", F.md5("body").alias("body"), "removed")


@query("cln18_empty_items_built", f"SELECT p_partkey, '- Two' || {_NL} || '    ' || p_name AS body, CAST(2 AS INTEGER) AS removed FROM part")
def cln18(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("- One\n\n- Two\n    "), "p_name", F.lit("\n- Three\n\n")).alias("body"), F.lit("- One\n- Two\n- Three").alias("skeleton"))
    return cleaning.strip_outline_items(rows, "body", "skeleton", orphans=False).select("p_partkey", "body", "removed")


@query(
    "str8_markdown_html_built",
    f"""SELECT p_partkey, '<h2>' || p_name || ' &amp; co</h2>' || {_NL} || '<p><strong>bold</strong> &amp; <em>it</em></p>' || {_NL} || '<ul>' || {_NL} || '<li>one</li>' || {_NL} || '<li>' || p_brand || '</li>' || {_NL} || '</ul>' || {_NL} || '<table class=' || chr(39) || 'md-table' || chr(39) || '><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>&lt;2&gt;</td></tr></tbody></table>' || {_NL} || '<p>plain ' || p_type || '</p>' AS html FROM part""",
)
def str8(spark, sf_dir):
    md = F.concat(F.lit("## "), "p_name", F.lit(" & co\n\n**bold** & *it*\n- one\n- "), "p_brand", F.lit("\n\n| a | b |\n| --- | --- |\n| 1 | <2> |\n\nplain "), "p_type")
    return map_text(table(spark, sf_dir, "part").select("p_partkey", md.alias("html")), "html", lambda r: [(S.markdown_to_html(r["html"]),)], [])


@query("str15_diff_built", f"SELECT p_partkey, CASE WHEN p_name = p_brand THEN '' ELSE '--- a' || {_NL} || '+++ b' || {_NL} || '@@ -1,3 +1,3 @@' || {_NL} || ' first' || {_NL} || '-' || p_name || {_NL} || '+' || p_brand || {_NL} || ' last' END AS text FROM part")
def str15(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("first\n"), "p_brand", F.lit("\nlast")).alias("text"), F.concat(F.lit("first\n"), "p_name", F.lit("\nlast")).alias("before"))
    return map_text(rows, "text", lambda r: [(S.unified_diff(r["before"], r["text"]),)], [], ["before"]).select("p_partkey", "text")


@query(
    "rnd1_option_built",
    """WITH o AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
    SELECT n_regionkey AS chart_id, '{"title":{"text":"d"},"xAxis":{"data":[' || string_agg('"' || n_name || '"', ',' ORDER BY i) || ']},"series":[{"name":"key","type":"bar","data":[' || string_agg(CAST(n_nationkey AS VARCHAR) || '.0', ',' ORDER BY i) || ']},{"name":"系列","type":"bar","data":[' || string_agg(CASE WHEN i <= 2 THEN '100' || n_nationkey || '.0' ELSE 'null' END, ',' ORDER BY i) || ']}]}' AS option FROM o GROUP BY n_regionkey""",
)
def rnd1(spark, sf_dir):
    return C.options(C.series_points(grid_charts(spark, sf_dir, "bar"))).select("chart_id", "option")


def _two(k: int) -> str:
    part = BM25.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE doc_id % 3 <> {k})")
    return f"SELECT * FROM (WITH {part}, scores AS (SELECT doc_id, {SCORE} AS score FROM postings JOIN terms USING (term) JOIN lengths USING (doc_id), stats WHERE term IN ('the', 'of') GROUP BY doc_id) SELECT CAST(doc_id AS BIGINT) AS node, '{k}' AS name, score FROM scores WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30)"


@query("fts5_two_indexes_best", f"WITH u AS ({_two(0)} UNION ALL {_two(1)}) SELECT node, max(score) AS score, arg_max(name, (score, -CAST(name AS INTEGER))) AS name FROM u GROUP BY node")
def fts5(spark, sf_dir):
    """Two indexes asked at once; the best score of each document counts."""
    d = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(1, "the of")], "query_id int, query string")
    parts = [fulltext.search(fulltext.build(d.where(F.col("doc_id") % 3 != k)), asked, 30, digits=6).select(F.col("doc_id").alias("node"), F.lit(str(k)).alias("name"), "score") for k in (0, 1)]
    return search.best_of(parts)
