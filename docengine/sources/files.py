"""File sources and sinks: Markdown trees, tolerant text decoding, chart JSON, images, state logs, drafts, artifacts.

Paths go to Spark's readers as they are, so any file system that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# Encodings in order of trial, image and office endings.
ENCODINGS = ["utf-8-sig", "gb18030", "gbk"]
IMAGES = ["jpg", "jpeg", "png", "webp"]
OFFICE = ["doc", "docx", "ppt", "pptx", "xls", "xlsx"]


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def markdown(spark: SparkSession, root: str, glob: str = "*.md", within: str | None = "pic_to_json", most: int | None = None) -> DataFrame:
    """path, source_id (the UUID in the path, or null), text of one file for each folder; several in a folder fail the query.

    within: only folders of that name. most: the first files by path."""
    rows = spark.read.text(root, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if within is not None:
        rows = rows.where(F.element_at(F.split(folder(F.col("path")), "/"), -1) == within)
    n = F.count("*").over(Window.partitionBy(folder(F.col("path"))))
    rows = rows.withColumn("n", n).withColumn("text", F.when(F.col("n") == 1, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("several files in "), folder(F.col("path"))))))
    rows = rows.select("path", F.nullif(F.regexp_extract("path", UUID, 0), F.lit("")).alias("source_id"), "text")
    return rows if most is None else rows.orderBy("path").limit(most)


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 (a byte-order mark goes), GB18030, GBK, else UTF-8 with replacements.

    Valid UTF-8 stays on the JVM; only other bytes go through Python."""

    @F.pandas_udf("string")
    def tolerant(values: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            for e in ENCODINGS:
                try:
                    return bytes(b).decode(e)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("utf-8", "replace")

        return values.map(one)

    valid = F.try_validate_utf8(content.cast("string"))
    return F.when(valid.isNotNull(), F.regexp_replace(valid, "^﻿", "")).otherwise(tolerant(F.when(valid.isNull(), content)))


def texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, text of files in any of the known encodings."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return rows.select("path", decoded(F.col("content")).alias("text"))


def chart_json(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """path, chart_id (the file's stem), json of the files that parse and are charts."""
    rows = spark.read.text(root, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    return rows.where(F.get_json_object("json", "$.is_chart") == "true").select("path", stem(F.col("path")).alias("chart_id"), "json")


def images(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """path, length, modified of image files below a folder named images."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(IMAGES) + "}").option("recursiveFileLookup", True).load(root)
    rows = rows.where(F.col("path").contains("/images/")).select("path", "length", F.col("modificationTime").alias("modified"))
    return rows if most is None else rows.orderBy("path").limit(most)


def state_log(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last record of each key of a JSON-lines log with an increasing `offset`; bad lines are skipped."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED").where(F.col(key).isNotNull())
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("offset")))).where("__n = 1").drop("__n")


def drafts(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path, title (first heading, else the stem), length, modified of draft files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    head = F.regexp_extract(F.col("content").cast("string"), r"(?m)^#\s+(.+)$", 1)
    return rows.select("path", F.coalesce(F.nullif(F.trim(head), F.lit("")), stem(F.col("path"))).alias("title"), "length", F.col("modificationTime").alias("modified"))


def template_type(filename: Column) -> Column:
    """custom for Markdown, system for office documents, null for others."""
    ending = F.lower(F.element_at(F.split(filename, r"\."), -1))
    return F.when(ending.isin("md", "markdown"), "custom").when(ending.isin(*OFFICE), "system")


def ingest(df: DataFrame, work, key: str, payload: str, parts: int = 5) -> DataFrame:
    """key, ok, error of `work(payload)` for each row, `parts` at a time; a failure becomes a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for value in pdf[payload]:
                try:
                    work(value)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  (the row carries it)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "ok": [e is None for e in errors], "error": errors})

    return df.select(key, payload).repartition(parts).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, ok boolean, error string")


def write_cleaned(df: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> None:
    """Cleaned documents and their metadata, one Parquet table each."""
    df.select(id, text).write.mode("overwrite").parquet(f"{path}/documents")
    df.drop(text).write.mode("overwrite").parquet(f"{path}/meta")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, collection: str = "collection") -> None:
    """Append, one folder for each collection."""
    df.write.mode("append").partitionBy(collection).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def safe_path(root: str, relative: str) -> str:
    """Path below the root; absolute paths and parent folders are refused."""
    parts = relative.replace("\\", "/").split("/")
    if relative.startswith(("/", "\\")) or ".." in parts or (parts[0].endswith(":")):
        raise ValueError(f"unsafe path: {relative}")
    return f"{root.rstrip('/')}/{'/'.join(p for p in parts if p not in ('', '.'))}"
