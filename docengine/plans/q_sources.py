"""Queries: files written to the shared folder and read back by the sources; streams over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import fulltext
from docengine.plans.registry import query, table
from docengine.sources import files
from docengine.sources.tables import shared_folder
from docengine.streaming import events as E


def _place(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("src1_markdown_scan", "SELECT item_id, md5(text) AS text FROM benchmark")
def src1(spark, sf_dir):
    """One text file for each item, found by folder."""
    root = _place(spark, "markdown")
    table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(root, lineSep="\n")
    found = files.markdown(spark, root, glob="*.txt", within=None)
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.md5(F.regexp_replace("text", r"\n\z", "")).alias("text"))


@query("src2_path_ids", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '0000000' || doc_id % 10 || '-1111-2222-3333-444444444444' END AS id FROM documents")
def src2(spark, sf_dir):
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/root/0000000"), (F.col("doc_id") % 10).cast("string"), F.lit("-1111-2222-3333-444444444444/pic_to_json/a.md"))).otherwise("/root/x/a.md")
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.regexp_extract(path, files.UUID, 0), F.lit("")).alias("id"))


@query("src3_tolerant_decode", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE '图表' END) AS text FROM documents")
def src3(spark, sf_dir):
    chinese = F.unhex(F.lit("CDBCB1ED"))  # two characters in GBK
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(chinese)
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("b")).select("doc_id", F.md5(files.decoded(F.col("b"))).alias("text"))


@query("src4_chart_json", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def src4(spark, sf_dir):
    root = _place(spark, "charts")
    n = table(spark, sf_dir, "nation")
    body = F.when(F.col("n_nationkey") % 3 == 1, F.when(F.col("n_nationkey") % 2 == 1, "{broken").otherwise(F.to_json(F.struct(F.lit(True).alias("is_chart"), "n_name"))))
    body = F.coalesce(body, F.to_json(F.struct((F.col("n_nationkey") % 2 == 0).alias("is_chart"), "n_name")))
    n.select(F.col("n_nationkey").alias("k"), body.alias("value")).write.partitionBy("k").text(root)
    found = files.chart_json(spark, root, "*.txt")
    return found.select(F.regexp_extract("path", r"k=(\d+)", 1).cast("int").alias("n_nationkey"), F.get_json_object("json", "$.n_name").alias("n_name"))


@query("src6_state_log", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def src6_log(spark, sf_dir):
    root = _place(spark, "state")
    table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("offset")).write.json(root)
    return files.state_log(spark, root, "user_id", "user_id long, status string, offset long").select("user_id", "status")


@query("src8_batch_ingest", "SELECT doc_id, n_chars <= 3000 AS ok FROM documents")
def src8(spark, sf_dir):
    def work(size: int) -> None:
        if size > 3000:
            raise ValueError("too long")

    return files.ingest(table(spark, sf_dir, "documents"), work, "doc_id", "n_chars").select("doc_id", "ok")


@query("src12_template_types", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'custom' WHEN 1 THEN 'system' END AS kind FROM part")
def src12(spark, sf_dir):
    name = F.when(F.col("p_size") % 3 == 0, "a.b.MD").when(F.col("p_size") % 3 == 1, "x.docx").otherwise("x.exe")
    return table(spark, sf_dir, "part").select("p_partkey", files.template_type(name).alias("kind"))


@query("snk1_index_round_trip", "SELECT doc_id, term, tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) GROUP BY ALL) WHERE term = 'the'")
def snk1(spark, sf_dir):
    path = _place(spark, "bm25")
    fulltext.build(table(spark, sf_dir, "documents")).write(path)
    return fulltext.Index.read(spark, path).postings.where("term = 'the'").select("doc_id", "term", "tf")


@query("snk2_vector_batches", "SELECT label AS collection, count(*) AS n FROM embeddings GROUP BY label")
def snk2(spark, sf_dir):
    path = _place(spark, "vectors")
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "collection")
    for part in range(2):
        files.write_vectors(e.where(F.col("vec_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("collection").agg(F.count("*").alias("n"))


@query("snk3_cleaned_artifact", "SELECT doc_id, lang, length(text) AS chars FROM documents")
def snk3(spark, sf_dir):
    path = _place(spark, "cleaned")
    files.write_cleaned(table(spark, sf_dir, "documents"), path)
    return spark.read.parquet(f"{path}/documents").join(spark.read.parquet(f"{path}/meta"), "doc_id").select("doc_id", "lang", F.length("text").alias("chars"))


@query("snk4_json_artifact", "SELECT n_nationkey, n_name FROM nation")
def snk4(spark, sf_dir):
    path = _place(spark, "json")
    files.write_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string").json(path)


@query("snk6_html_text", "SELECT doc_id, md5('<p>' || source || '</p>') AS html FROM documents")
def snk6(spark, sf_dir):
    path = _place(spark, "html")
    d = table(spark, sf_dir, "documents")
    d.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t<p>"), "source", F.lit("</p>")).alias("value")).write.text(path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).cast("long").alias("doc_id"), F.md5(F.get(parts, F.lit(1))).alias("html"))


@query("jsn20_upsert", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM documents UNION ALL SELECT 1000000, 2")
def jsn20(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("version"))
    new = old.where("doc_id % 4 = 0").select("doc_id", F.lit(2).alias("version")).unionByName(spark.range(1).select((F.col("id") + 1000000).alias("doc_id"), F.lit(2).alias("version")))
    return files.upsert(old, new, "doc_id")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Beyond the reference: tumbling windows, as a batch."""
    return E.windows(table(spark, sf_dir, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, sf_dir):
    """Beyond the reference: sessions with a gap of six hours."""
    return E.sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", "start", "n")


@query("cln12_model_hook", "SELECT doc_id, md5(replace(text, 'a', 'A')) AS text FROM documents")
def cln12(spark, sf_dir):
    """The model hook with a stub that changes one letter."""
    from docengine.operators import cleaning

    return cleaning.model_clean(table(spark, sf_dir, "documents"), lambda t: t.replace("a", "A")).select("doc_id", F.md5("text").alias("text"))


@query("cln10_qr_images", "SELECT doc_id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS qr FROM documents")
def cln10(spark, sf_dir):
    alt = F.when(F.col("doc_id") % 3 == 0, "扫一扫").otherwise("plot")
    name = F.when(F.col("doc_id") % 5 == 0, "my_QR.png").otherwise("a.png")
    return table(spark, sf_dir, "documents").select("doc_id", T.is_qr(alt, F.lit("around"), name).alias("qr"))
