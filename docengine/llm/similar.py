"""Near-duplicates by shingle similarity through SimHash (operator 7 at five words and a similarity of 0.8).

Words are the lower-cased text split at white space; a text is its set of five-word shingles (fewer words: the
whole sequence). Two texts are alike if the Jaccard similarity of their sets is `similarity` or more; classes are
what such links connect. Fingerprints only find candidates, every link is verified on the shingles.

1. Texts with equal words collapse to one node (a partial aggregate) before anything is compared.
2. Each node has a 128-bit SimHash. At a similarity of 0.8 two fingerprints differ in 19 bits on average
   (deviation 4); RADIUS is three deviations above, unrelated texts differ in 64 (deviation 6).
3. Nodes are dealt out by the number of their shingles: only groups whose numbers can reach the similarity meet.
   Tiles of a pair of groups are compared whole by exclusive-or and bit counts; a pair of tiles is skipped where
   their population counts differ beyond the radius or their numbers of shingles can't reach the similarity.
4. Each node takes its closest candidate, the pair is verified, the links found join classes: near copies are then
   mostly in one class with their original.
5. Nodes that still have another candidate in another class meet in tiles again, this time with their shingles: all
   candidate pairs of a pair of tiles that are not in one class yet are verified by one matrix product. A task
   returns a forest, one row for each node at most, never its pairs.

Null texts and texts without words count as equal texts. Rows with a null id have no class and stay; rows that
repeat id and text are one node. Ids are integers. Other columns, whatever their names, stay as they are.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import discard, fits, map_slices, meet, stored, trimmed, unused
from docengine.llm.decontaminate import _HASHES, bits_of, forget, shingle_hashes
from docengine.llm.simhash import TILE, Forest, components, dealt_by_band

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 32
#: Numbers of shingles fall into classes of this ratio.
STEP = 1.02
#: Shingles of one group of a task that verifies in tiles, about, and of one matrix product.
GROUP_SHINGLES, COLUMNS = 1 << 21, 8192
#: Candidates of one text that are verified in one task, about.
SHARE = 500


def shingle_set(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, bytes]:
    """Sorted different shingle hashes of a text and the digest of its words."""
    words = (text or "").lower().split()
    digest = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    return np.unique(shingle_hashes(h, min(width, max(1, len(words))))), digest


def simhash128(shingles: np.ndarray) -> np.ndarray:
    """Two words of 64 bits: the sign of the sum over the shingles (ties and no shingle: 0)."""
    total = np.zeros(128, np.float64)
    for at in range(0, len(shingles), 1 << 13):
        total += bits_of(shingles[at : at + (1 << 13)]).sum(axis=0)
    return np.packbits(total > 0, bitorder="little").view("<u8")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def marks(df: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """key, row (hash of id and text), digest, size, low, high of every row with an id."""
    rows = df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("key"), F.xxhash64(F.col(id).cast("long"), F.col(text)).alias("row"), F.col(text).alias("body"))

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(x, width) for x in batch.column(2).to_pylist()]
            prints = np.array([simhash128(s) for s, _ in found], np.uint64).view(np.int64)
            sizes = pa.array([len(s) for s, _ in found], pa.int32())
            digests = pa.array([d for _, d in found], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, sizes, pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["key", "row", "digest", "size", "low", "high"])

        return apply

    return map_slices(rows, make, "key long, row long, digest binary, size int, low long, high long", "body", finish=forget)


class Side:
    """Nodes of one group in the order of their tiles."""

    def __init__(self, table: pa.Table):
        get = lambda name: table.column(name).to_numpy()
        low, high = get("low").view(np.uint64), get("high").view(np.uint64)
        weight = (np.bitwise_count(low) + np.bitwise_count(high)).astype(np.int64)
        size = get("size").astype(np.int64)
        order = np.lexsort((weight, size))
        self.node, self.label, self.size = get("node")[order], get("label")[order], size[order]
        self.low, self.high, weight = low[order], high[order], weight[order]
        self.tested = get("tested").astype(np.int64)[order], get("after")[order]
        self.order, self.best = order, (np.full(len(order), 255), np.zeros(len(order), np.int64))
        at = np.arange(0, len(order), TILE)
        self.least_size, self.most_size = self.size[at], np.maximum.reduceat(self.size, at)
        self.least, self.most = np.minimum.reduceat(weight, at), np.maximum.reduceat(weight, at)

    def offer(self, at: np.ndarray, distance: np.ndarray, other: np.ndarray) -> None:
        """Keep for each node the closest candidate (distance, node) beyond what was tested."""
        tested, after = self.tested[0][at], self.tested[1][at]
        new = (distance > tested) | (distance == tested) & (other > after)
        at, distance, other = at[new], distance[new], other[new]
        order = np.lexsort((other, distance, at))
        at, distance, other = at[order], distance[order], other[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        at, distance, other = at[first], distance[first], other[first]
        closer = (distance < self.best[0][at]) | (distance == self.best[0][at]) & (other < self.best[1][at])
        self.best[0][at[closer]], self.best[1][at[closer]] = distance[closer], other[closer]


def candidate_pairs(left: Side, right: Side | None, radius: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances of the candidates of the two groups (of the left one alone) in different classes, tile by tile."""
    other = right or left
    for t in range(len(left.least)):
        apart = np.maximum(other.least - left.most[t], left.least[t] - other.most)
        near = (apart <= radius) & (other.least_size * least <= left.most_size[t]) & (left.least_size[t] * least <= other.most_size)
        x = slice(t * TILE, (t + 1) * TILE)
        for u in np.flatnonzero(near).tolist():
            if right is None and u < t:
                continue
            y = slice(u * TILE, (u + 1) * TILE)
            distance = np.bitwise_count(left.low[x, None] ^ other.low[None, y]) + np.bitwise_count(left.high[x, None] ^ other.high[None, y])
            p, q = np.nonzero(distance <= radius)
            if not len(p):
                continue
            d = distance[p, q].astype(np.int64)
            p, q = p + t * TILE, q + u * TILE
            small, large = np.minimum(left.size[p], other.size[q]), np.maximum(left.size[p], other.size[q])
            open_ = (left.label[p] != other.label[q]) & (small >= least * large - 1e-9)
            if open_.any():
                yield p[open_], q[open_], d[open_]


def _sides(left: pa.Table, right: pa.Table) -> list[Side]:
    """Both groups of a task, one for a group with itself, none if there is nothing to compare."""
    side = left if left.num_rows else right
    alone = side.column("i")[0].as_py() == side.column("j")[0].as_py()
    return [Side(x) for x in ([left] if alone else [left, right])] if left.num_rows and (alone or right.num_rows) else []


def _dealt(nodes: DataFrame, least: float, **options):
    """The nodes dealt by their number of shingles, as co-groups of two sides."""
    band = F.floor(F.log(F.col("size")) / float(np.log(STEP))).cast("int")
    left, right = dealt_by_band(nodes.withColumn("band", band), int(np.ceil(np.log(1 / least) / np.log(STEP))) + 1, "node", **options)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def candidates(nodes: DataFrame, radius: int, least: float) -> DataFrame:
    """node, distance, near: the closest candidate of another class beyond the tested one, of nodes (node, size, low, high, label, tested, after)."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = _sides(left, right)
        for p, q, d in candidate_pairs(sides[0], (sides + [None])[1], radius, least) if sides else ():
            sides[0].offer(p, d, sides[-1].node[q])
            sides[-1].offer(q, d, sides[0].node[p])
        at = [np.flatnonzero(s.best[0] < 255) for s in sides]
        out = [[s.node[a] for s, a in zip(sides, at)], [s.best[0][a] for s, a in zip(sides, at)], [s.best[1][a] for s, a in zip(sides, at)]]
        return pa.table({n: pa.array(np.concatenate(x) if x else [], t) for n, x, t in zip(("node", "distance", "near"), out, (pa.int64(), pa.int32(), pa.int64()))})

    found = _dealt(nodes, least).applyInArrow(trimmed(task), "node long, distance int, near long")
    return found.groupBy("node").agg(F.min(F.struct("distance", "near")).alias("c")).select("node", "c.distance", "c.near")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each set of a with each of b (sorted arrays)."""
    out = np.zeros((len(a), len(b)), np.float32)
    common = np.intersect1d(np.concatenate(a), np.concatenate(b))
    for begin in range(0, len(common), COLUMNS):
        part = common[begin : begin + COLUMNS]
        sides = []
        for sets in (a, b):
            m = np.zeros((len(sets), len(part)), np.float32)
            for r, x in enumerate(sets):
                at = np.searchsorted(part, x)
                m[r, at[part[np.minimum(at, len(part) - 1)] == x]] = 1.0
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def verified_in_tiles(nodes: DataFrame, radius: int, least: float) -> DataFrame:
    """node, near: rows that connect what verified pairs and the labels of nodes (node, size, low, high, label, tested, after, shingles) connect."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = _sides(left, right)
        if not sides:
            return pa.table({"node": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        sets = [t.column("shingles") for t in (left, right)[: len(sides)]]
        get = lambda side, n, place: np.frombuffer(sets[n][int(side.order[place])].as_py(), "<u8")
        nodes_ = np.concatenate([s.node for s in sides])
        order = np.argsort(nodes_, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))  # roots are then least nodes
        forest = Forest(len(order))
        _, first, inverse = np.unique(np.concatenate([s.label for s in sides]), return_index=True, return_inverse=True)
        forest.link(rank, rank[first[inverse]])
        shift = len(sides[0].node) if len(sides) > 1 else 0
        for p, q, _ in candidate_pairs(sides[0], (sides + [None])[1], radius, least):
            apart = forest.roots(rank[p]) != forest.roots(rank[q + shift])
            p, q = p[apart], q[apart]
            if not len(p):
                continue
            (rows, r), (columns, c) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
            both = overlaps([get(sides[0], 0, x) for x in rows], [get(sides[-1], len(sides) - 1, x) for x in columns])[r, c]
            alike = both >= least * (sides[0].size[p] + sides[-1].size[q] - both) - 1e-6
            forest.link(rank[p[alike]], rank[q[alike] + shift])
        roots = forest.roots(np.arange(len(order)))
        moved = np.flatnonzero(roots != np.arange(len(order)))
        least_first = nodes_[order]
        return pa.table({"node": least_first[moved], "near": least_first[roots[moved]]})

    return _dealt(nodes, least, most=GROUP_SHINGLES, weight="size").applyInArrow(trimmed(task), "node long, near long")


def with_shingles(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """nodes and their packed shingle sets, from texts (node, body)."""

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(x, width)[0].astype("<u8").tobytes() for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

        return apply

    return nodes.join(map_slices(texts.select("node", "body"), make, "node long, shingles binary", "body", finish=forget), "node")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (node, near) whose texts are alike. A text that is near to many is copied to SHARE of them at a time."""
    total = pairs.count()
    often = F.broadcast(pairs.groupBy("near").agg(F.count("*").alias("n")).where(F.col("n") > max(SHARE, total // 1000)))  # fewer than 1000
    salted = pairs.join(often, "near", "left").withColumn("salt", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SHARE))).cast("int")).drop("n")
    targets = texts.select(F.col("node").alias("near"), F.col("body").alias("other")).join(often, "near", "left")
    targets = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.ceil(F.col("n") / SHARE).cast("int") - 1, F.lit(0))))).drop("n")
    both = salted.join(texts, "node").join(targets, ["near", "salt"]).select("node", "near", "body", "other")

    def make() -> Callable:
        seen: dict[int, np.ndarray] = {}

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            alike = []
            for near, body, other in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if near not in seen:
                    if len(seen) >= 64:
                        seen.clear()
                    seen[near] = shingle_set(other, width)[0]
                alike.append(similarity(shingle_set(body, width)[0], seen[near]) >= least)
            return batch.select(["node", "near"]).filter(pa.array(alike, pa.bool_()))

        return apply

    return map_slices(both, make, "node long, near long", "body", most=1 << 20, finish=forget)


def classes(df: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(marks of the rows, nodes: digest, key and row of its first text, n rows, component: the first row of its class)."""
    spark = df.sparkSession
    found, _ = stored(marks(df, text, id, width), "marks")
    first = F.min(F.struct("key", "row"))
    nodes, _ = stored(found.groupBy("digest").agg(first.alias("first"), F.first("size").alias("size"), F.first("low").alias("low"), F.first("high").alias("high")).select("digest", "first.key", F.col("first.row").alias("node"), "size", "low", "high"), "nodes")
    open_ = nodes.where("size > 0").select("node", "size", "low", "high", F.col("node").alias("label"), F.lit(-1).alias("tested"), F.lit(0).cast("long").alias("after"))
    near, held = stored(candidates(open_, radius, least), "candidates")
    if near.isEmpty():
        return found, nodes.select("digest", "key", "node", F.struct("key", F.col("node").alias("row")).alias("component"))
    active, _ = stored(near.select("node").unionByName(near.select(F.col("near").alias("node"))).distinct(), "active")
    place = df.where(F.col(id).isNotNull()).select(F.xxhash64(F.col(id).cast("long"), F.col(text)).alias("node"), F.col(text).alias("body"))
    texts, _ = stored(place.join(fits(active), "node", "left_semi").groupBy("node").agg(F.min("body").alias("body")), "texts")
    links, _ = stored(verified(near.select("node", "near"), texts, width, least), "links")
    labels = components(links)
    tested = near.select("node", F.col("distance").alias("tested"), F.col("near").alias("after"))
    open_, _ = stored(nodes.select("node", "size", "low", "high").join(tested, "node").join(labels, "node", "left").select("node", "size", "low", "high", F.coalesce("component", "node").alias("label"), "tested", "after"), "open")
    more, _ = stored(candidates(open_, radius, least), "candidates")
    if not more.isEmpty():
        left = open_.join(more.select("node").unionByName(more.select(F.col("near").alias("node"))).distinct(), "node", "left_semi")
        rest, _ = stored(verified_in_tiles(with_shingles(left, texts, width), radius, least), "links")
        labels = components(links.unionByName(rest))
    discard(spark, held)
    placed = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).select("digest", "key", "node", "label")
    heads = placed.groupBy("label").agg(F.min(F.struct("key", F.col("node").alias("row"))).alias("component"), F.count("*").alias("n"))
    out, _ = stored(meet(placed, heads, "label").select("digest", "key", "node", "component"), "classes")
    return found, out


def similar(df: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """id, component_id long of each row: the least id that verified links reach (null for a null id)."""
    found, nodes = classes(df, text, id, **options)
    counts = found.groupBy("digest").agg(F.count("*").alias("n"))
    mapped = meet(found.select("key", "digest"), nodes.select("digest", "component.key").withColumnRenamed("key", "component_id").join(counts, "digest"), "digest")
    none = df.where(F.col(id).isNull()).select(F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("component_id"))
    return mapped.select("key", "component_id").unionByName(none).withColumnRenamed("key", id)


def one_of_each_similar(df: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of df without near-duplicates: of each class the row with the least id (and least hash, should the id repeat). All columns stay."""
    found, nodes = classes(df, text, id, **options)
    kept = nodes.where((F.col("component.key") == F.col("key")) & (F.col("component.row") == F.col("node"))).select("key", F.col("node").alias("row"))
    gone, _ = stored(found.groupBy("key", "row").agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), ["key", "row"], "left").where("stays is null or n > 1"), "gone")
    k, r, n = unused(df.columns, "key", "row", "n")
    place = {k: F.col(id).cast("long"), r: F.when(F.col(id).isNotNull(), F.xxhash64(F.col(id).cast("long"), F.col(text)))}
    rows = df.withColumns(place)
    drop = gone.select(F.col("key").alias(k), F.col("row").alias(r))
    repeated = gone.where("stays").select(F.col("key").alias(k), F.col("row").alias(r))
    left = rows.join(fits(drop), [k, r], "left_anti").select(*df.columns)
    if repeated.isEmpty():
        return left
    first = F.row_number().over(Window.partitionBy(k, r).orderBy(F.lit(0)))
    again = rows.join(repeated, [k, r], "left_semi").withColumn(n, first).where(F.col(n) == 1).select(*df.columns)
    return left.unionByName(again)
