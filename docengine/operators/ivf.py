"""A stored inverted file of vectors: lists by centroid as folders, pruned by partition, with columns for predicates.

    lists = InvertedFile.build(df, path, columns=["label"])
    lists.append(more)
    lists.search(queries, k=10, probes=8, where=F.col("label") == 3)

A search reads the folders of the lists that some query probes, and in them the files' rows that `where` lets through (the scan
gets the predicate). Centroids come from k-means on a bounded sample; every row is in the list of its nearest centroid.
With as many probes as lists the search is exact.

Vectors are compared by cosine. Null, zero and non-finite vectors, and those of another length than the centroids, are in no list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import vectors
from docengine.operators.fulltext import first_of_each

#: Rows that the centroids are fit on at most, about; rounds; queries of a pass, and their probes together.
SAMPLE, ROUNDS, QUERIES, PLACES = 20_000, 8, 10_000, 1 << 22


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from rows far apart."""
    k = min(k, len(x))
    r = np.random.default_rng(0)
    picked = [int(r.integers(len(x)))]
    near = x @ x[picked[0]]
    for _ in range(k - 1):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(ROUNDS):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (vectors.norm(F.col(vector)) > 0)


class InvertedFile:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()  # one for each list
        self.centroids = np.array([r["v"] for r in rows], np.float64)

    @classmethod
    def build(cls, df: DataFrame, path: str, lists: int | None = None, id: str = "vec_id", vector: str = "embedding", columns: list[str] = []) -> InvertedFile:  # noqa: B006
        """The inverted file of df in a new folder. lists: about the square root of the rows by default."""
        spark, rows = df.sparkSession, df.where(_usable(vector)).select(F.size(vector).alias("n"), vectors.normalize(F.col(vector)).alias("v"), F.xxhash64(id).alias("h"))
        sizes = rows.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("n")).first()
        if sizes is None:
            raise ValueError("no vectors to build lists of")
        part = max(1, sizes["m"] // SAMPLE)
        sample = rows.where((F.col("n") == sizes["n"]) & (F.pmod("h", F.lit(part)) == 0)).orderBy("h").limit(2 * SAMPLE).select("v").toArrow()
        x = sample.column(0).combine_chunks().flatten().to_numpy().reshape(-1, sizes["n"])
        centroids = _fit(x, lists or max(1, int(sizes["m"] ** 0.5)))
        spark.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(centroids)], "list int, v array<double>").write.parquet(f"{path.rstrip('/')}/centroids")
        made = cls(spark, path)
        made.append(df, id, vector, columns)
        return made

    def placed(self, df: DataFrame, vector: str, probes: int = 1) -> DataFrame:
        """df with v (unit vector) and list; `probes` rows for each, by the nearest centroids."""
        centroids, names = self.centroids, df.columns
        rows = df.where(_usable(vector) & (F.size(vector) == centroids.shape[1])).withColumn("v", vectors.normalize(F.col(vector)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, 1024):
                    batch = whole.slice(begin, 1024)
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    best = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
                    taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1])))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(best.ravel().astype(np.int32))], [*names, "v", "list"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", list int"
        return rows.mapInArrow(run, schema)

    def append(self, df: DataFrame, id: str = "vec_id", vector: str = "embedding", columns: list[str] = []) -> None:  # noqa: B006
        rows = self.placed(df.select(F.col(id).alias("id"), F.col(vector).alias("x"), *columns), "x").drop("x")
        rows.repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    def scan(self, lists: list[int], where: Column | None = None) -> DataFrame:
        """Rows (id, v, columns, list) of the lists: other folders are not read."""
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("list").isin(lists))
        return rows if where is None else rows.where(where)

    def search(self, queries: DataFrame, k: int, probes: int = 8, where: Column | None = None, id: str = "vec_id", digits: int | None = None) -> DataFrame:
        """query_id, id, score, rank (from 0) of the k nearest rows in the probed lists of each query (query_id, query_vec); ties to the smaller id.

        Queries are taken in passes of QUERIES, fewer if they probe more than PLACES lists together; a pass holds each vector once."""
        probes = min(probes, len(self.centroids))
        each = max(1, min(QUERIES, PLACES // probes))
        n, out = queries.count(), None
        parts = max(1, -(-n // each))
        for part in range(parts):
            some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
            x, names, places = self._asked(some, probes)
            held = self.spark.sparkContext.broadcast((names, places, x))
            found = self._met(self.scan(sorted(places), where).select("id", "v", "list"), held, k, queries.schema["query_id"].dataType.simpleString(), digits)
            out = found if out is None else out.unionByName(found)
        return first_of_each(out, [F.desc("score"), "id"], k).select("query_id", F.col("id").alias(id), "score", "rank")

    def _asked(self, queries: DataFrame, probes: int) -> tuple[np.ndarray, pa.Array, dict[int, np.ndarray]]:
        """Unit vectors of the usable queries, their ids, and the places of those that probe each list."""
        usable = queries.where(_usable("query_vec") & (F.size("query_vec") == self.centroids.shape[1]))
        asked = usable.select("query_id", vectors.normalize(F.col("query_vec")).alias("v")).toArrow()
        x = asked.column("v").combine_chunks().flatten().to_numpy().reshape(asked.num_rows, -1) if asked.num_rows else np.zeros((0, self.centroids.shape[1]))
        every = np.arange(len(x), dtype=np.int32)
        if probes >= len(self.centroids):
            return x, asked.column("query_id").combine_chunks(), {c: every for c in range(len(self.centroids))} if len(x) else {}
        best = np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        order = np.argsort(best, axis=None, kind="stable")
        cuts = np.flatnonzero(np.diff(best.ravel()[order])) + 1
        return x, asked.column("query_id").combine_chunks(), {int(best.ravel()[p[0]]): (p // probes).astype(np.int32) for p in np.split(order, cuts) if len(p)}

    @staticmethod
    def _met(rows: DataFrame, held, k: int, key: str, digits: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, places, x = held.value
            for whole in batches:
                for begin in range(0, whole.num_rows, 2048):
                    batch = whole.slice(begin, 2048)
                    lists = batch.column("list").to_numpy()
                    for c in np.unique(lists).tolist():
                        own = batch.filter(pa.array(lists == c)).sort_by("id")
                        v = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                        for first in range(0, len(places[c]), 512):
                            at = places[c][first : first + 512]
                            score = x[at] @ v.T
                            score = np.round(score, digits) + 0.0 if digits is not None else score
                            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(at, best.shape[1]))), own.column("id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, axis=1).ravel())], ["query_id", "id", "score"])

        return rows.mapInArrow(run, f"query_id {key}, id {rows.schema['id'].dataType.simpleString()}, score double")
