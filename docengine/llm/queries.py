"""The registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, decoded again: their number and digests."""
    import public_tokenizers

    from docengine.llm import bpe

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels that are not held out."""
    from docengine.llm import toxicity
    from docengine.llm.common import held_out

    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    found = toxicity.score(documents, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts and notices in every document."""
    from docengine.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for each vector whose id 20 divides."""
    from docengine.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents: each item found in each document, at its best window."""
    from docengine.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    from docengine.llm import language
    from docengine.llm.common import held_out

    documents = table(spark, sf_dir, "documents")
    found = language.predict(documents, language.train(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from docengine.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credentials of every document."""
    from docengine.llm import secrets

    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier."""
    from docengine.llm import lines

    left = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "lang", "source", "n_chars", "text")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from docengine.llm import pages

    return pages.extract(table(spark, sf_dir, "pages"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a two-word model learnt from the documents that are not held out."""
    from docengine.llm import lm
    from docengine.llm.common import held_out

    documents = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), of=7)
    found = lm.score_texts(documents, ~out)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector, its distance, the inertia and the digest of its centroid."""
    from docengine.llm import kmeans

    found = kmeans.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", kmeans.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes, in each part and order of the five filters."""
    from docengine.llm import audit

    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_nearest": op4_nearest,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_line_dedup": op9_line_dedup,
    "op10_main_text": op10_main_text,
    "op11_lm_score": op11_lm_score,
    "op12_sort_means": op12_sort_means,
    "op13_filter_audit": op13_filter_audit,
}


def _oracles() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    from docengine.llm import audit, kmeans, licenses, secrets

    return {"op3_licenses": licenses.scan_sql(), "op8_secrets": secrets.report_sql(), "op12_sort_means": kmeans.cluster_sql(), "op13_filter_audit": audit.interactions_sql()}


ORACLES: dict[str, str] = _oracles()
