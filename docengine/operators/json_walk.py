"""JSON of any depth as rows, without Python: values are variants, and each level is one explode of the level above.

The levels are a loop over the depth of the deepest value, not over rows; a level is written before the next one is made from it, so
nothing runs twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.sources.tables import kept

_PLAIN = "^[A-Za-z_][A-Za-z0-9_]*$"


def _kind(value: Column) -> Column:
    """The variant's type without the types inside it: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def nodes(df: DataFrame, json: str, id: str = "doc_id") -> DataFrame:
    """id, depth, path, key, at (place in its array or object), kind, value (variant) of every value in the JSON text; none if it is no JSON.

    Paths are as in $.pages[0].img; keys that are no plain name stand in double quotes."""
    level = df.select(F.col(id).alias("id"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("at"), F.try_parse_json(F.col(json)).alias("value")).where("value is not null")
    found, depth = [], 0
    while True:
        held = kept(level.withColumn("kind", _kind(F.col("value"))).withColumn("depth", F.lit(depth)), "json-level")
        found.append(held)
        inner = held.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            break
        spark = df.sparkSession
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "k", "v"))
        step = F.when(F.col("k").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).when(F.col("k").rlike(_PLAIN), F.concat(F.lit("."), "k")).otherwise(F.concat(F.lit('."'), "k", F.lit('"')))
        level = below.select("id", F.concat("path", step).alias("path"), F.col("k").alias("key"), F.col("pos").cast("int").alias("at"), F.col("v").alias("value")).where("value is not null")
        depth += 1
    return reduce(DataFrame.unionByName, found).select(F.col("id").alias(id), "depth", "path", "key", "at", "kind", "value")


def strings(df: DataFrame, json: str, id: str = "doc_id") -> DataFrame:
    """id, path, value of every string in the JSON text."""
    return nodes(df, json, id).where("kind = 'STRING'").select(id, "path", F.variant_get("value", "$", "string").alias("value"))


def reference(value: Column) -> Column:
    """A string as a relative path: forward slashes, no ./ in front."""
    return F.regexp_replace(F.replace(T.strip(value), F.lit("\\"), F.lit("/")), r"^\./", "")


def references(df: DataFrame, removed: DataFrame, json: str, id: str = "doc_id") -> DataFrame:
    """id, path, ref of the strings that name one of the files removed from their document (removed: id, ref).

    An equal join: no document gathers what was removed from it."""
    held = strings(df, json, id).withColumn("ref", reference(F.col("value")))
    return held.join(removed.select(id, "ref").distinct(), [id, "ref"]).select(id, "path", "ref")
