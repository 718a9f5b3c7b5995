"""Queries: joins, aggregates, windows, top-k and set operations on the star tables and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.operators import documents
from docengine.operators import relational as R
from docengine.plans.registry import query, table


@query("flt4_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def flt4(spark, sf_dir):
    cond = (F.col("o_orderstatus") == "F") & F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp"))
    return table(spark, sf_dir, "orders").where(cond).select("o_orderkey")


@query("flt5_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%' AND p_type LIKE '%A%'")
def flt5(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%an%") & F.col("p_type").contains("A")).select("p_partkey", "p_name")


@query("flt7_referenced_only", "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_returnflag = 'R') AND p_size > 10")
def flt7(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey")
    return table(spark, sf_dir, "part").where("p_size > 10").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query(
    "flt7_content_list",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a.png,' ELSE '' END || 'words' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',b.png' END AS kept FROM documents""",
)
def flt7_content_list(spark, sf_dir):
    """Items of a content list: images in use and not QR codes, texts that are no noise, nothing discarded."""
    k = F.col("doc_id")
    items = """[{"type": "image", "img_path": "images/a.png"}, {"type": "text", "text": "words"}, {"type": "text", "text": "第 3 页"}, {"type": "discarded", "text": "gone"}, {"type": "image", "img_path": "images/my_qr.png"}, {"type": "table", "img_path": "t/b.png", "image_caption": ["about", "%s"]}, {"type": "image", "img_path": "x/c.png", "image_caption": ["扫一扫"]}]"""
    cleaned = F.concat(F.coalesce("text", F.lit("")), F.when(k % 3 == 0, "![x](images/a.png)").otherwise(""), F.when(k % 2 == 0, "").otherwise(" ![](deep/b.png)"), F.lit(" ![](images/my_qr.png) ![](c.png)"))
    left = F.transform(documents.filter_content_list(F.lit(items), cleaned), lambda x: F.coalesce(F.regexp_extract(x["img_path"], "[^/]*$", 0), x["text"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(left, ",").alias("kept"))


@query("flt11_jn9_unused", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def flt11(spark, sf_dir):
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("flt13_work_selection", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'ocr' WHEN 'F' THEN 'clean' ELSE 'chart' END AS work FROM orders ORDER BY o_orderkey LIMIT 1000")
def flt13(spark, sf_dir):
    work = F.when(F.col("o_orderstatus") == "O", "ocr").when(F.col("o_orderstatus") == "F", "clean").otherwise("chart")
    return R.page(table(spark, sf_dir, "orders"), [F.col("o_orderkey")], 1000).select("o_orderkey", work.alias("work"))


@query("jn2_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def jn2(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("jn11_jn13_left", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def jn11(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey != 2")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("jn12_sections_to_charts", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS charts FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY n_regionkey")
def jn12(spark, sf_dir):
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("charts"))


@query("jn14_requested_ids", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) ORDER BY o_orderkey LIMIT 1000")
def jn14(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(asked, "o_orderkey", "left_semi")
    return R.page(rows, [F.col("o_orderkey")], 1000).select("o_orderkey")


@query(
    "jn7_name_match",
    """WITH l AS (SELECT p_partkey, lower(p_name) AS name FROM part UNION ALL SELECT -p_partkey, lower(p_type || ' ' || p_name) FROM part WHERE p_size > 20),
    k AS (SELECT lower(string_split(p_name, ' ')[2]) AS name, min(p_partkey) AS k FROM part GROUP BY 1 UNION ALL SELECT lower(p_name), min(-p_partkey) FROM part WHERE p_size <= 20 GROUP BY 1)
    SELECT p_partkey, l.name, coalesce(min(CASE WHEN k.name = l.name THEN k END), min(k)) AS match FROM l LEFT JOIN k ON contains(k.name, l.name) OR contains(l.name, k.name) GROUP BY p_partkey, l.name""",
)
def jn7(spark, sf_dir):
    """Whole names of all parts against the last words and the whole names of parts."""
    p = table(spark, sf_dir, "part")
    left = p.select("p_partkey", F.lower("p_name").alias("name")).unionByName(p.where("p_size > 20").select(-F.col("p_partkey").alias("p_partkey"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("name")).toDF("p_partkey", "name"))
    words = p.groupBy(F.lower(F.split("p_name", " ")[1]).alias("name")).agg(F.min("p_partkey").alias("k"))
    right = words.unionByName(p.where("p_size <= 20").groupBy(F.lower("p_name").alias("name")).agg(F.min(-F.col("p_partkey")).alias("k")))
    return R.name_match(left, right, "name", "k")


@query(
    "jn8_weak_match",
    """WITH g AS (SELECT p_partkey, list_distinct(list_transform(generate_series(1, length(p_name) - 1), lambda i: lower(substr(p_name, i, 2)))) AS x, p_size, p_name FROM part),
    s AS (SELECT a.p_partkey, b.p_partkey AS match, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 6) AS jaccard FROM g a JOIN g b ON a.p_size = b.p_size AND a.p_partkey <> b.p_partkey)
    SELECT p_partkey, match, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY jaccard DESC, match) AS n FROM s) WHERE n = 1 AND jaccard >= 0.22""",
)
def jn8(spark, sf_dir):
    """The best bigram match of each part among parts of its size, if good enough."""
    from docengine.operators import setjoin

    p = table(spark, sf_dir, "part")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("p_name") - 1), lambda i: F.lower(F.substring(F.col("p_name"), i, F.lit(2)))))
    x = p.select(F.col("p_size").alias("group"), F.col("p_partkey").alias("id"), pairs.alias("tokens"))
    return setjoin.best(x, x, 0.22, apart=True).select(F.col("a").alias("p_partkey"), F.col("b").alias("match"), "jaccard")


@query("agg8_version_rollup", "SELECT conv_id, max(turn) AS latest_version, max(CASE WHEN role = 'user' THEN turn END) AS active_version, count(*) AS versions, max(length(text)) AS updated FROM conversations GROUP BY conv_id")
def agg8(spark, sf_dir):
    return R.version_rollup(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", F.length("text"))


@query("agg9_distinct_scopes", "SELECT count(DISTINCT conv_id) AS scopes FROM conversations")
def agg9(spark, sf_dir):
    return table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("scopes"))


@query("agg10_status_histogram", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def agg10(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("agg15_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY event_type")
def agg15(spark, sf_dir):
    return R.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query(
    "agg17_job_rollup",
    "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'success' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'failed' ELSE 'partial' END AS state, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed, CAST(sum(o_orderkey % 10) AS BIGINT) AS images FROM orders GROUP BY o_custkey",
)
def agg17(spark, sf_dir):
    return R.job_rollup(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderkey") % 10)


@query("agg18_images_per_source", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def agg18(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("agg19_ctl6_effective_limit", "SELECT p_partkey, least(coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, 4), CASE WHEN p_size % 2 = 0 THEN 7 END) AS most FROM part")
def agg19(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", R.effective_limit(F.when(size % 3 != 0, size), F.when(size % 2 == 0, F.lit(7)), 4).alias("most"))


@query(
    "src9_status_rollup",
    """WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'pending' END END AS status, o_orderkey % 101 AS progress FROM orders)
    SELECT o_custkey, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'processing') THEN 'processing' ELSE 'pending' END AS status, CAST(floor(avg(progress)) AS BIGINT) AS progress FROM s GROUP BY o_custkey""",
)
def src9(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderkey") % 2 == 0, "processing").otherwise("pending")
    rows = table(spark, sf_dir, "orders").select("o_custkey", status.alias("status"), (F.col("o_orderkey") % 101).alias("progress"))
    return R.status_rollup(rows, "o_custkey", "status", "progress")


@query("win2_latest_version", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant') WHERE n = 1")
def win2(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "role")


@query(
    "win3_first_in_document",
    """WITH d AS (SELECT doc_id, source, lower(substr(text, 1, 2)) AS gid, doc_id % 9 = 0 AS chart FROM documents)
    SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, gid ORDER BY doc_id) AS n FROM d) WHERE n = 1 OR chart""",
)
def win3(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.substring("text", 1, 2)).alias("gid"), (F.col("doc_id") % 9 == 0).alias("chart"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("source", "gid").orderBy("doc_id"))).where("n = 1 OR chart").select("doc_id")


@query("win6_latest_success", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS build FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def win6(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return done.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("build"))


_OUTLINE = "SELECT user_id AS doc, event_id AS pos, 1 + CAST(floor(value * 10) AS BIGINT) % 4 AS depth FROM events"


@query(
    "win7_outline_ancestors",
    f"WITH i AS ({_OUTLINE}) SELECT a.doc, a.pos, a.depth, max(b.pos) AS parent FROM i a LEFT JOIN i b ON a.doc = b.doc AND b.pos < a.pos AND b.depth < a.depth GROUP BY ALL",
)
def win7(spark, sf_dir):
    i = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), (1 + F.floor(F.col("value") * 10) % 4).alias("depth"))
    return R.ancestors(i, "doc", "pos", "depth")


@query(
    "win9_preceding_heading",
    """WITH i AS (SELECT user_id AS doc, event_id AS pos, CASE WHEN event_type = 'click' OR event_id % 5 = 0 THEN event_id * 2 END AS h, event_id % 2 = 0 AS image FROM events)
    SELECT a.doc, a.pos, (SELECT arg_max(b.h, b.pos) FROM i b WHERE b.doc = a.doc AND b.pos < a.pos AND b.h IS NOT NULL) AS heading FROM i a WHERE a.image""",
)
def win9(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), "event_type", (F.col("event_id") % 2 == 0).alias("image"))
    heading = F.when((F.col("event_type") == "click") | (F.col("pos") % 5 == 0), F.col("pos") * 2)
    return R.preceding_heading(rows, "doc", "pos", heading, F.col("image")).select("doc", "pos", "heading")


@query("top4_ctl5_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200")
def top4(spark, sf_dir):
    return R.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 100, 200)


@query("top5_two_keys", "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn DESC LIMIT 50")
def top5(spark, sf_dir):
    return R.page(table(spark, sf_dir, "conversations").select("conv_id", "turn"), [F.asc("conv_id"), F.desc("turn")], 50)


@query("set2_append", "SELECT doc_id AS id, 'text' AS kind, lang FROM documents UNION ALL SELECT page_id, 'page', NULL FROM pages")
def set2(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), "lang")
    return d.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")), allowMissingColumns=True)


@query(
    "set3_ordered_distinct",
    "WITH w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM benchmark), f AS (SELECT item_id, w, min(i) AS i FROM w GROUP BY ALL) SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY item_id",
)
def set3(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


@query("set5_except", "SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set5(spark, sf_dir):
    gone = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")).subtract(gone)


@query(
    "src6_resume",
    """WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS done FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
    now AS (SELECT user_id, arg_max(event_type, event_id) AS sig FROM events GROUP BY user_id)
    SELECT user_id, sig FROM now LEFT JOIN last USING (user_id) WHERE done IS NULL OR done <> sig""",
)
def src6(spark, sf_dir):
    """Users whose last event differs from the last one in the state."""
    e = table(spark, sf_dir, "events")
    now = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("sig"))
    state = e.where("event_id % 2 = 0").select("user_id", F.col("event_type").alias("sig"), F.col("event_id").alias("offset"))
    return R.resume(now, state, "user_id", "sig")


@query("src10_unique_content", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)")
def src10(spark, sf_dir):
    """First document of each content hash; the others are refused."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query("dat1_ranges", "SELECT event_id, strftime(ts, '%Y%m%d') AS batch FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20'")
def dat1(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").where(ts.between(F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))).select("event_id", F.date_format(ts, "yyyyMMdd").alias("batch"))
