"""A corpus pipeline over `documents`: language, repeated lines, near-duplicates, benchmark items, tokens.

Each stage is a function of (spark, docs, sf_dir). It works on all that the stage before kept; all but the last
return the columns of documents. Written as Parquet and read again between stages, no stage runs twice.

Nulls, empty texts, repeated rows and other columns are handled as the operators' docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bpe, decontaminate, language, lines, similar
from docengine.llm.common import stored, unused


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined (no letter); a missing lang takes the predicted one."""
    named, score = unused(docs.columns, "lang_pred", "score")
    found = language.annotate(docs, language.train(docs), names=(named, score))
    return found.where(F.col(named) != language.UNDETERMINED).withColumn("lang", F.coalesce("lang", named)).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines that stand earlier; documents stay."""
    return lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, a verified similarity of 0.8 or more."""
    return similar.one_of_each_similar(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document, and the digest of the bytes that they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", languages),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_items),
    ("byte-level BPE", tokens),
]

#: SQL can't express the language model, the SimHash groups or the merges; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
