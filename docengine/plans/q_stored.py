"""Queries over stored summaries, observed writes and a stored inverted file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import sketches
from docengine.operators.ivf import InvertedFile
from docengine.plans.q_search import _COS
from docengine.plans.q_text import NOISY_SQL, _fold, noisy
from docengine.plans.registry import query, table
from docengine.sources.observed import write_observed
from docengine.sources.tables import kept, shared_folder


@query("agg9_agg15_sketches", "SELECT event_type, count(*) AS n, true AS distinct_within, true AS median_within, true AS p95_within FROM events GROUP BY event_type")
def sketched(spark, sf_dir):
    """Users and values of each kind of event from summaries of each day: merged, within their stated errors of the exact figures."""
    e = table(spark, sf_dir, "events")
    found = sketches.report(kept(sketches.summarize(e, F.to_date("ts"), ["event_type"], "user_id", "value"), "summaries"), ["event_type"])
    low = lambda q: max(0.0, q - sketches.RANK)
    high = lambda q: min(1.0, q + sketches.RANK)
    p = lambda q: F.expr(f"percentile(value, {q})")
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("d"), *[p(f(q)).alias(n) for n, f, q in (("m0", low, 0.5), ("m1", high, 0.5), ("q0", low, 0.95), ("q1", high, 0.95))])
    met = found.join(exact, "event_type")
    near = F.abs(F.col("distinct") - F.col("d")) <= sketches.distinct_error() * F.col("d") + 1
    return met.select("event_type", "n", near.alias("distinct_within"), F.get("quantiles", F.lit(0)).between(F.col("m0"), F.col("m1")).alias("median_within"), F.get("quantiles", F.lit(1)).between(F.col("q0"), F.col("q1")).alias("p95_within"))


@query("agg12_observed_write", f"SELECT count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS original_chars, CAST(sum(length(c)) AS BIGINT) AS cleaned_chars, CAST(sum(CASE WHEN c <> body THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM (SELECT body, {_fold('body', T.AD_PATTERNS, 'i')} AS c FROM ({NOISY_SQL}))")
def observed(spark, sf_dir):
    """Statistics of a cleaning, counted while its result is written."""
    rows = noisy(spark, sf_dir).select("doc_id", "body", T.remove_ads(F.col("body")).alias("cleaned"))
    path = f"{shared_folder(spark)}/cleaned-{uuid.uuid4().hex}"
    one = F.lit(1).cast("long")
    seen = write_observed(rows, lambda df: df.select("doc_id", "cleaned").write.parquet(path), n=F.count(one), original_chars=F.sum(F.length("body").cast("long")), cleaned_chars=F.sum(F.length("cleaned").cast("long")), changed=F.sum((F.col("cleaned") != F.col("body")).cast("long")))
    return spark.createDataFrame([tuple(seen[k] for k in ("n", "original_chars", "cleaned_chars", "changed"))], "n long, original_chars long, cleaned_chars long, changed long")


@query(
    "vec2_snk2_stored_lists",
    f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.label >= 2 AND a.label < 5)
    SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s) WHERE rank < 10""",
)
def stored_lists(spark, sf_dir):
    """Half of the vectors in a stored inverted file, the others appended; all lists probed, labels by predicate: exact."""
    base = table(spark, sf_dir, "embeddings")
    lists = InvertedFile.build(base.where("vec_id % 2 = 0"), f"{shared_folder(spark)}/lists-{uuid.uuid4().hex}", columns=["label"])
    lists.append(base.where("vec_id % 2 <> 0"), columns=["label"])
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return lists.search(asked, 10, probes=len(lists.centroids), where=(F.col("label") >= 2) & (F.col("label") < 5), digits=6)
