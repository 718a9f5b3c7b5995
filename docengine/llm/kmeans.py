"""Centroid clustering by sort-means (operator 12): exact k-means over whole-number vectors.

Each round sorts, for every centroid, the other centroids by their distance from it. A vector starts at the
centroid of its previous assignment and tries the others in that order; it stops at the first that lies strictly
beyond twice the distance to its previous centroid, because no later one can be as near. Ties go to the smaller number.

A round is one pass over a table in the shared folder that holds the vectors with their assignments. The pass writes
the next such table, and in it one row for each task and centroid with the sums of the vectors assigned; only
those rows are added up, so the driver gets k times `dim` sums, whatever the number of vectors. A table is deleted
when the next one is there.

Components are floor(scale * x), x as double. Distances are squared and exact: products of floats where all whole
numbers stay below 2^53, 64-bit integers otherwise; vectors with a component of 2^27 or more in size take no part, as their
squared distances need not fit a long. Vectors that are null, of another length than `dim`, or hold null or
non-finite components take no part. A null id counts as the text "null" where the first centroids are drawn, and stays in the
result; rows that repeat an id are vectors of their own (equal draws: the lesser vector first). With fewer than k
vectors each is a centroid; an empty table gives no rows. Other columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import discard, stored

DIM, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Components at most, so that squared distances fit a long; and so that sums of products of floats are exact.
MOST, EXACT = 1 << 27, 1 << 22
#: Vectors that a task holds as arrays at a time.
ROWS = 8192

_ROW = "id long, v array<long>, cluster int, distance long, n long, sums boolean"


def whole(df: DataFrame, vector: str = "embedding", id: str = "vec_id", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id, v: the vectors that take part, as whole numbers."""
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    usable = (F.size(vector) == dim) & F.forall(F.col(vector), lambda c: F.coalesce(F.abs(F.floor(F.lit(float(scale)) * c.cast("double"))) < MOST, F.lit(False)) & ~F.isnan(c))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id).cast("long").alias("id"), x.alias("v"))


def first_centroids(points: DataFrame, draw: Column, k: int) -> np.ndarray:
    """The k vectors that come first by `draw`, in that order."""
    rows = points.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from c (or from the same row of c)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


class Centroids:
    """Centroids of a round, and for each the others sorted by their squared distance from it (itself first; ties: smaller number)."""

    def __init__(self, places: np.ndarray):
        self.places = places
        k = len(places)
        between = np.array([squared(places, c) for c in places], np.int64).reshape(k, k)
        np.fill_diagonal(between, -1)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.reach = np.take_along_axis(between, self.order, axis=1)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row of x, from its centroid before; and how many distances that took."""
        if max(np.abs(x).max(initial=0), np.abs(self.places).max(initial=0)) <= EXACT:
            x, places = x.astype(np.float64), self.places.astype(np.float64)
        else:
            places = self.places
        best, cluster, took = squared(x, places[before]), before.copy(), len(x)
        tries = np.array([np.searchsorted(self.reach[b], 4 * d, side="right") for b, d in zip(before.tolist(), best.tolist())], np.int64)
        by_start = np.lexsort((-tries, before))
        for start in np.split(by_start, np.flatnonzero(np.diff(before[by_start])) + 1) if len(x) else ():
            near, others = x[start], self.order[before[start[0]]]
            for j in range(1, int(tries[start[0]])):
                active = start[: np.count_nonzero(tries[start] > j)]
                other = int(others[j])
                d = squared(near[: len(active)], places[other])
                took += len(active)
                closer = (d < best[active]) | (d == best[active]) & (other < cluster[active])
                best[active[closer]], cluster[active[closer]] = d[closer], other
        return cluster, best, took


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def assigned(points: DataFrame, places: np.ndarray) -> DataFrame:
    """A pass: points (id, v, cluster) with their new cluster and distance, and a row of sums for each task and centroid that has any."""
    k, dim = places.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(places)
        total, count, far = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for piece in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                x = vectors(piece.column("v"), dim)
                cluster, distance, _ = centroids.assign(x, piece.column("cluster").to_numpy().astype(np.int64))
                np.add.at(total, cluster, x)
                np.add.at(count, cluster, 1)
                np.add.at(far, cluster, distance)
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("v"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, bool))], ["id", "v", "cluster", "distance", "n", "sums"])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array(some, pa.int32()), pa.array(far[some]), pa.array(count[some]), pa.array(np.ones(len(some), bool))], ["id", "v", "cluster", "distance", "n", "sums"])

    return points.select("id", "v", "cluster").mapInArrow(run, _ROW)


def added_up(passed: DataFrame) -> tuple[dict[int, dict[int, int]], dict[int, tuple[int, int]]]:
    """Of a stored pass, for each centroid: the sum of each component, and (vectors, sum of distances)."""
    sums = passed.where("sums")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("decimal(38,0)").alias(c)
    of_all = {r.cluster: (int(r.n), int(r.distance)) for r in sums.groupBy("cluster").agg(exact("n"), exact("distance")).collect()}
    totals: dict[int, dict[int, int]] = {}
    for r in sums.select("cluster", F.posexplode("v").alias("at", "x")).groupBy("cluster", "at").agg(exact("x")).collect():
        totals.setdefault(r.cluster, {})[r.at] = int(r.x)
    return totals, of_all


def cluster(df: DataFrame, draw: Callable[[Column], Column] | None = None, vector: str = "embedding", id: str = "vec_id", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long> of every vector that takes part.

    draw: from the id's text to what the first centroids are drawn by (default: the SHA-256 of "2:" and the id)."""
    draw = draw or (lambda text: F.sha2(F.concat(F.lit("2:"), text), 256))
    spark = df.sparkSession
    points = whole(df, vector, id, dim, scale)
    places = first_centroids(points, draw(F.coalesce(F.col("id").cast("string"), F.lit("null"))), k)
    if not len(places):
        return spark.createDataFrame([], f"`{id}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    now, before = points.withColumn("cluster", F.lit(0)), None
    for left in range(rounds, -1, -1):
        passed, path = stored(assigned(now, places), "sort-means", by="sums")
        if before:
            discard(spark, before)
        now, before = passed.where("not sums"), path
        if left:
            totals, of_all = added_up(passed)
            places = np.array([[totals[c][at] // of_all[c][0] for at in range(dim)] if c in totals else old.tolist() for c, old in enumerate(places)], np.int64)
    _, of_all = added_up(passed)
    inertia = sum(far for _, far in of_all.values())
    kept = spark.createDataFrame([(c, of_all[c][1], places[c].tolist()) for c in sorted(of_all)], "cluster int, cluster_inertia long, centroid array<long>")
    found = now.join(F.broadcast(kept), "cluster")  # k rows at most
    return found.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid")


def digest(centroid: Column) -> Column:
    """SHA-256 of the components as decimal integers joined by commas."""
    return F.sha2(F.concat_ws(",", F.transform(centroid, lambda c: c.cast("string"))), 256)


def cluster_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> str:
    """DuckDB SQL of the clustering over `embeddings`, each distance worked out."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || COALESCE(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept, c{n}) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""s{n + 1} AS MATERIALIZED (SELECT c, pos, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.c, unnest(v) AS x, unnest(range({dim})) AS pos FROM kept JOIN a{n} a USING (r)) GROUP BY c, pos)),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, COALESCE(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN (SELECT c, list(x ORDER BY pos) AS v FROM s{n + 1} GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p.v, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (r) JOIN c{rounds} p ON p.c = a.c"""
