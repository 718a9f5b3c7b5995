"""Vector expressions and exact nearest neighbours with metadata predicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import let
from docengine.operators.fulltext import first_of_each


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(a, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """0 for null or empty vectors, different lengths and zero norms."""
    bad = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b))
    scale = norm(a) * norm(b)
    return F.when(bad, F.lit(0.0)).when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def _unit(rows: list, dim: int) -> np.ndarray:
    """Vectors of `dim` components as rows of length one; null, other lengths, null components and zero vectors are zero rows."""
    m = np.array([v if v is not None and len(v) == dim and None not in v else [0.0] * dim for v in rows], np.float64).reshape(len(rows), dim)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def nearest(base: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", where: Column | None = None, digits: int | None = None, bound: int = 10_000) -> DataFrame:
    """query_id, id, score, rank (from 0): the k rows of largest cosine for each query (query_id, query_vec).

    Exact; ties go to the smaller id, and what has no cosine scores 0. The queries come to each task as a matrix, after a
    check that there are at most `bound` of them; more are taken in blocks of that size. A task multiplies it with one
    Arrow batch of rows at a time and passes on the k best of the batch for each query; a window picks the k best of all."""
    spark = base.sparkSession
    rows = (base if where is None else base.where(where)).select(id, F.col(vector).cast("array<double>").alias("vec"))
    n = queries.count()
    blocks = max(1, -(-n // bound))
    key, of = queries.schema["query_id"].dataType.simpleString(), rows.schema[id].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        asked = part.select("query_id", F.col("query_vec").cast("array<double>").alias("q")).toArrow()
        by_length: dict[int, list[int]] = {}
        vectors = asked.column("q").to_pylist()
        for at, v in enumerate(vectors):
            by_length.setdefault(len(v) if v is not None else 0, []).append(at)
        held = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks(), {dim: (at, _unit([vectors[i] for i in at], dim)) for dim, at in by_length.items()}))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, groups = held.value
            for whole in batches:
                for begin in range(0, whole.num_rows, 2048):
                    batch = whole.slice(begin, 2048)
                    batch = batch.take(pc.sort_indices(batch.column(0)))  # places are then in the order of the ids
                    given = batch.column(1).to_pylist()
                    for dim, (at, matrix) in groups.items():
                        unit = _unit(given, dim)
                        for first in range(0, len(at), 512):
                            score = matrix[first : first + 512] @ unit.T
                            score = np.round(score, digits) + 0.0 if digits is not None else score
                            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                            of_query = np.repeat(np.array(at[first : first + 512]), best.shape[1])
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(of_query)), batch.column(0).take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, axis=1).ravel())], ["query_id", id, "score"])

        found = rows.mapInArrow(run, f"query_id {key}, `{id}` {of}, score double")
        found = first_of_each(found, [F.desc("score"), id], k)
        out = found if out is None else out.unionByName(found)
    return out


def auto_merge(hits: DataFrame, children: DataFrame, ratio: float = 0.25) -> DataFrame:
    """Hits of a parent become the parent where they are more than `ratio` of its children.

    hits: query_id, id, score; children: id, parent. Out: query_id, node, score (the mean of those merged), merged."""
    sizes = children.groupBy("parent").agg(F.count("*").alias("size"))
    found = hits.join(children, "id", "left")
    counted = found.where("parent IS NOT NULL").groupBy("query_id", "parent").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).join(sizes, "parent")
    merged = counted.where(F.col("n") / F.col("size") > ratio)
    up = merged.select("query_id", F.col("parent").cast("string").alias("node"), F.col("mean").alias("score"), F.lit(True).alias("merged"))
    rest = found.join(merged.select("query_id", "parent"), ["query_id", "parent"], "left_anti")
    return up.unionByName(rest.select("query_id", F.col("id").cast("string").alias("node"), "score", F.lit(False).alias("merged")))
