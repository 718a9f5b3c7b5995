"""Queries over streams that stop and start again, and over the Python data sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docengine.plans.registry import query, table
from docengine.sources import datasource
from docengine.sources.tables import shared_folder
from docengine.streaming import resume


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_STAGES = 3


def _status(image: str, signature: str) -> str:
    if signature == "error":
        raise ValueError("no answer")
    return "chart" if signature == "purchase" else "non_chart"


@query(
    "src6_stream_resume",
    """WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) AS before FROM events WHERE user_id IS NOT NULL)
    SELECT CAST(user_id AS VARCHAR) AS image, event_id AS seq, event_type AS signature, CASE event_type WHEN 'purchase' THEN 'chart' WHEN 'error' THEN 'error' ELSE 'non_chart' END AS status FROM e WHERE before IS NULL OR before <> event_type""",
)
def stream_resume(spark, sf_dir):
    """Events as images that change: they arrive in three batches, and the stream is stopped and started again after each."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("image"), F.col("event_id").alias("seq"), F.col("event_type").alias("signature"), F.lit(None).cast("string").alias("status"))
    came, out, checkpoint = _folder(spark, "came"), _folder(spark, "results"), _folder(spark, "checkpoint")
    for stage in range(_STAGES):
        e.where(F.pmod("seq", F.lit(_STAGES)) == stage).write.mode("append").parquet(came)
        resume.run_once(spark.readStream.schema(e.schema).parquet(came), _status, out, checkpoint)
    return spark.read.parquet(out).select("image", "seq", "signature", "status")


def _log(spark, sf_dir, folder: str) -> None:
    """A log of the events as JSON lines, every seventh of them broken."""
    k = F.col("event_id")
    record = F.to_json(F.struct(F.col("user_id").cast("string").alias("source_image"), F.col("event_type").alias("status"), k.alias("n")))
    line = F.when(k % 7 == 0, F.concat(record, F.lit("}{"))).when(k % 7 == 1, F.lit("[1, 2]")).otherwise(record)
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)


def _named(spark, folder: str) -> str:
    """The folder with its files as *.jsonl."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(path(folder)):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(f.getPath(), path(f"{folder}/{name[:-4]}.jsonl"))
    return folder


_LOG = "SELECT CAST(user_id AS VARCHAR) AS source_image, event_type AS status, event_id AS n FROM events WHERE event_id % 7 > 1"


@query("src6_jsonl_source", f"SELECT status, count(*) AS n, count(DISTINCT source_image) AS images FROM ({_LOG}) WHERE status IN ('click', 'purchase') GROUP BY status")
def jsonl_source(spark, sf_dir):
    """A log with broken lines through the data source, two statuses asked for."""
    folder = _folder(spark, "log")
    _log(spark, sf_dir, folder)
    datasource.register(spark)
    rows = spark.read.format("jsonl_log").option("keys", "source_image,status").option("range_bytes", 1 << 20).load(_named(spark, folder))
    return rows.where(F.col("status").isin("click", "purchase")).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("source_image").alias("images"))


@query("src6_jsonl_stream", f"SELECT source_image, status, n FROM ({_LOG})")
def jsonl_stream(spark, sf_dir):
    """The same log as a stream into a table."""
    folder, out, checkpoint = _folder(spark, "log"), _folder(spark, "rows"), _folder(spark, "checkpoint")
    _log(spark, sf_dir, folder)
    datasource.register(spark)
    rows = spark.readStream.format("jsonl_log").option("keys", "source_image,status,n").load(_named(spark, folder))
    written = rows.select("source_image", "status", F.col("n").cast("long").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    written.start().awaitTermination()
    return spark.read.parquet(out)


@query("src4_snk4_chart_folder", "SELECT 'c' || p_partkey AS chart_id, p_brand AS chart_type, 'images/' || p_partkey || '.png' AS source_image FROM part WHERE p_size % 3 = 0")
def chart_folder(spark, sf_dir):
    """Charts written as a file each, read by the data source; parts of other sizes are no charts."""
    folder = _folder(spark, "charts")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")

    def write(rows):
        import json
        import os

        made = None
        for r in rows:
            at = f"{datasource.local(folder)}/{r.p_partkey // 1000}"  # a folder of a million files is slow to list, and one task's
            if at != made:
                os.makedirs(at, exist_ok=True)
                made = at
            with open(f"{at}/c{r.p_partkey}.json", "w") as f:
                json.dump({"is_chart": r.p_size % 3 == 0, "chart_type": r.p_brand, "_source_image": f"images/{r.p_partkey}.png"}, f)

    # a table of one file would be written by one task
    p.repartition(4 * spark.sparkContext.defaultParallelism, F.floor(F.col("p_partkey") / 1000)).foreachPartition(write)
    datasource.register(spark)
    return spark.read.format("chart_folder").load(folder).select("chart_id", "chart_type", "source_image")
