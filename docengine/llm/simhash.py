"""SimHash near-duplicates (operator 7): exact tiled comparison of fingerprints, then components.

1. Fingerprints: every whole text, lower-cased A-Z, words split at ASCII white space, 4-word shingles
   with repeats, XXH64 (seed 42) of each; a bit is set where over half of the hashes have it.
2. Equal fingerprints collapse to one row with their least doc_id (a partial aggregate, so a third of
   all rows with one fingerprint is no burden).
3. The distinct fingerprints are dealt into groups by their population counts; each pair of groups whose counts
   lie within the radius is one task (no other is shuffled). In it both sides are sorted by the population counts of their four 16-bit parts and cut into tiles. A pair of tiles whose counts differ
   by more than the radius is skipped; for the others numpy takes exclusive-or and bit counts of all pairs.
   This loses no link. Each task returns the least member for each member of its local components
   (at most one row for each fingerprint it read), never its pairs.
4. Labels spread along these rows until nothing changes; each round is stored in the shared folder.

Null texts and texts without words have the fingerprint zero and link like any other. Rows with a null
doc_id get no class (component_id null) and link nothing; repeated doc_ids count as one node with
several fingerprints, which joins their components.
An empty table gives an empty result; other columns are not carried over by `near_duplicates` and stay in `one_of_each`.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import discard, map_slices, meet, stored, unused

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in one tile, and about as many in one group (there are MIN_GROUPS groups at least).
TILE, GROUP, MIN_GROUPS = 256, 65_536, 8


def shingle_hashes(content: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles of a text's bytes, in order, repeats included."""
    words = content.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), np.uint64, n - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit; ties and no hashes at all give 0."""
    n = len(hashes)
    if not n:
        return 0
    if n == 1:
        return int(hashes[0])
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", id: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """id, bits long (the fingerprint's 64 bits) of every row."""

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(shingle_hashes(x or b"", width)) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["key", "bits"])

        return apply

    rows = df.select(F.col(id).alias("key"), F.col(text).cast("binary").alias("body"))
    return map_slices(rows, make, f"key {rows.schema['key'].dataType.simpleString()}, bits long", "body").withColumnRenamed("key", id)


class Forest:
    """Union-find over positions; the root is the least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        parent = self.parent
        up = parent[at]
        while True:
            upper = parent[up]
            if np.array_equal(upper, up):
                parent[at] = up
                return up
            up = upper

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if len(a):
                np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def _sorted_tiles(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the fingerprints by the counts of their parts; the tiles' least and greatest counts (parts and total)."""
    parts = np.bitwise_count(bits.view("<u2").reshape(-1, 4)).astype(np.int16)
    order = np.lexsort((parts[:, 3], parts[:, 2], parts[:, 1], parts[:, 0], parts.sum(axis=1)))
    counts = np.column_stack([parts, parts.sum(axis=1)])[order]
    at = np.arange(0, len(bits), TILE)
    return order, np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def linked_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs at `radius` or fewer differing bits between a and b (within a, if b is None), tile by tile."""
    order_a, low_a, high_a = _sorted_tiles(a)
    order_b, low_b, high_b = (order_a, low_a, high_a) if b is None else _sorted_tiles(b)
    left, right = a[order_a], (a if b is None else b)[order_b]
    for t in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_b - high_a[t], low_a[t] - high_b))
        near = np.flatnonzero((gap[:, 4] <= radius) & (gap[:, :4].sum(axis=1) <= radius))
        x = left[t * TILE : (t + 1) * TILE]
        for u in near.tolist():
            if b is None and u < t:
                continue
            hit = np.flatnonzero(np.bitwise_count(x[:, None] ^ right[None, u * TILE : (u + 1) * TILE]) <= radius)
            if len(hit):
                width = min(TILE, len(right) - u * TILE)
                yield order_a[t * TILE + hit // width], order_b[u * TILE + hit % width]


def _tile_task(radius: int) -> Callable:
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        """Both groups of one pair (the right one is empty for a group with itself): least linked node of each."""
        a, nodes = left.column("bits").to_numpy().view(np.uint64), left.column("node").to_numpy()
        b, more = right.column("bits").to_numpy().view(np.uint64), right.column("node").to_numpy()
        within = len(b) == 0
        every = np.concatenate([nodes, more])
        rank = np.argsort(np.argsort(every, kind="stable"), kind="stable")  # roots are then least nodes
        by_rank = np.sort(every, kind="stable")
        forest = Forest(len(every))
        if len(a):
            for p, q in linked_pairs(a, None if within else b, radius):
                forest.link(rank[p], rank[q if within else q + len(a)])
        roots = forest.roots(np.arange(len(every)))
        moved = np.flatnonzero(roots != np.arange(len(every)))
        return pa.table({"node": by_rank[moved], "near": by_rank[roots[moved]]})

    return task


def dealt_by_band(rows: DataFrame, reach: int, key: str, most: int = GROUP, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (with a column `band`, an integer of few values) for the tasks (i, j), i <= j: the left and the right side of each.

    Rows are dealt into groups of neighbouring bands, a band of over `most` rows (or of that sum of `weight`) into several by a hash of `key`. A
    group meets only the groups that hold a band at most `reach` away, so other pairs are never shuffled. The driver
    holds a count for each band and two numbers for each group.
    """
    spark = rows.sparkSession
    counts = sorted((r["band"], r["count"]) for r in rows.groupBy("band").agg((F.sum(weight) if weight else F.count("*")).alias("count")).collect())
    most = max(1, min(most, -(-sum(n for _, n in counts) // MIN_GROUPS)))
    bands, groups, held = [], [], most  # groups: least and greatest band
    for band, n in counts:
        parts = -(-n // most)
        if parts > 1 or held + n > most:
            bands.append((band, len(groups), parts))
            groups += [[band, band]] * parts if parts > 1 else [[band, band]]
            held = most if parts > 1 else n
        else:
            bands.append((band, len(groups) - 1, 1))
            groups[-1] = [groups[-1][0], band]
            held += n
    low, high = [g[0] for g in groups], [g[1] for g in groups]
    meets = [(g, bisect.bisect_left(high, low[g] - reach), bisect.bisect_right(low, high[g] + reach) - 1) for g in range(len(groups))]
    placed = rows.join(F.broadcast(spark.createDataFrame(bands, "band int, base int, parts int")), "band").withColumn("g", (F.col("base") + F.pmod(F.xxhash64(key), F.col("parts"))).cast("int"))
    placed = placed.join(F.broadcast(spark.createDataFrame(meets, "g int, first int, last int")), "g").drop("band", "base", "parts")
    left = placed.withColumn("h", F.explode(F.sequence("g", "last"))).withColumnsRenamed({"g": "i", "h": "j"}).drop("first", "last")
    right = placed.where("first < g").withColumn("h", F.explode(F.sequence(F.col("first"), F.col("g") - 1))).withColumnsRenamed({"h": "i", "g": "j"}).drop("first", "last")
    return left, right.select([F.col(c).alias(c) for c in left.columns])  # columns of its own, for the cogroup


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """node, near: rows that connect exactly what links of `radius` bits connect, from distinct (node long, bits long)."""
    left, right = dealt_by_band(distinct.withColumn("band", F.bit_count("bits")), radius, "bits")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_pair_of_groups(radius), "node long, near long")


def _pair_of_groups(radius: int) -> Callable:
    task = _tile_task(radius)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        side = left if left.num_rows else right
        if not left.num_rows or (not right.num_rows and side.column("i")[0].as_py() != side.column("j")[0].as_py()):
            return pa.table({"node": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        return task(left, right)

    return run


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the least node that each node of the edges (node, near) reaches.

    Each round a node takes the least label among its neighbours and its label's own label (pointer jumping);
    the table of labels is written to the shared folder, so no round runs twice and none holds all links.
    """
    spark = edges.sparkSession
    ways = F.array(F.struct("node", "near"), F.struct(F.col("near").alias("node"), F.col("node").alias("near")))
    both = edges.select(F.explode(ways).alias("way")).select("way.node", "way.near").distinct()
    both, kept = stored(both, "edges")
    labels, path = stored(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component")), "labels")
    for _ in range(rounds):
        there = labels.select(F.col("node").alias("near"), F.col("component").alias("offered"))
        offered = both.join(there, "near").groupBy("node").agg(F.min("offered").alias("offered"))
        nearer = labels.join(offered, "node").select("node", F.col("component").alias("old"), F.least("component", "offered").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = nearer.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component"))
        step, new = stored(jumped, "labels")
        discard(spark, path)
        labels, path = step.select("node", "component"), new
        if step.where(F.col("old") != F.col("component")).isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    discard(spark, kept)
    return labels


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, bits long, component_id long for each row of df (integer ids): the least id that its fingerprint's links reach."""
    marks, _ = stored(fingerprints(df.withColumn(id, F.col(id).cast("long")), text, id, width), "fingerprints")
    known = marks.where(F.col(id).isNotNull())
    distinct, _ = stored(known.groupBy("bits").agg(F.min(id).alias("node"), F.count("*").alias("n")), "distinct")
    edges = links(distinct.select("node", "bits"), radius)
    # Rows of one id with several fingerprints join them: the id is then a link between their nodes.
    several = known.groupBy(F.col(id).alias("same")).agg(F.min("bits").alias("low"), F.max("bits").alias("high")).where("low != high").select("same")
    shared = marks.join(several, F.col(id) == F.col("same"), "left_semi").join(distinct, "bits").select(F.col("node"), F.col(id).alias("near"))
    found = components(edges.unionByName(shared).where("node != near"))
    mapped, _ = stored(distinct.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"), "n"), "mapped")
    # A fingerprint that a large part of all rows has is broadcast, so its rows stay where they are.
    none = marks.where(F.col(id).isNull()).select(id, "bits", F.lit(None).cast("long").alias("component_id"))
    return meet(known, mapped, "bits").select(id, "bits", "component_id").unionByName(none)


def one_of_each(df: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of df without near-duplicates: of each component the row with the least id (and least text, should the id repeat).

    Rows with a null id belong to no component and stay. All columns stay.
    """
    found = near_duplicates(df, text, id, **options)
    k, n = unused(df.columns, "kept", "n")
    kept = found.where(F.col(id) == F.col("component_id")).select(F.col(id).alias(k)).distinct()
    first = F.row_number().over(Window.partitionBy(id).orderBy(text))
    rows = df.where(F.col(id).isNotNull()).join(kept, F.col(id) == F.col(k), "left_semi")
    return rows.withColumn(n, first).where(F.col(n) == 1).select(*df.columns).unionByName(df.where(F.col(id).isNull()))
