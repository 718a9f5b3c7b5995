"""Approximate nearest neighbours by an inverted multi-index (operator 4).

Each half of a vector is quantised on its own; a pair of centroids is a cell of the index. For a query the
cells are visited in order of the summed inner products of its halves with the centroids: a heap over the two
sorted lists yields the next pairs, a block at a time (multi-sequence). The visit ends when the cells hold the wanted number of
rows. Only the entries of visited cells are scored, by the exact inner product in double precision.

The codebooks are fit on one half of a bounded sample (`sample` vectors, chosen by a hash of the id). The wanted
number is calibrated on the other half, which the codebooks have not seen: the least at which `target` of its
true neighbours are found, where a neighbour's rank is scaled from the table to the sample. Every row is indexed.

How much that prunes depends on the vectors: clustered ones need a few per cent of the rows, isotropic ones (no
structure at all) a third at 50 000 rows and 64 components, less as rows grow.

Cells are packed into bins of about equal size; a cell larger than a bin is split by a hash of the id, so no
task holds more than a bin of entries and QUERY_ROWS probes. Entries are copied only for bins with more probes.
The driver holds only the codebooks, the sample and a count for each cell (at most MAX_CENTROIDS squared) and bin.

Vectors that are null, zero, of another length than the commonest (`dim`; ties: the longer) or that hold null or
non-finite components take no part, nor do null ids. Of rows with one id the least vector takes part. With fewer
candidates than k all of them return. Other columns are not carried over.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import stored

SAMPLE, SAMPLE_QUERIES, TARGET = 40_000, 600, 0.95
#: Rows of a cell on average, centroids of a half at most, and vectors that a centroid is fit on at least.
OCCUPANCY, MAX_CENTROIDS, FIT_ROWS = 4, 1024, 20
#: Centroids of a half that the heap takes at a time; bins at least; entries of a bin and probes of a task at most (about); scores that wait in a task.
STEP, MIN_BINS, BIN_ROWS, QUERY_ROWS, WAITING = 16, 12, 32_768, 8_192, 1 << 20


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of x (k at most, fewer if x has fewer rows), from rows drawn with a fixed seed."""
    k = min(k, len(x))
    c = x[np.random.default_rng(11).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        size = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c * c).sum(axis=1)[None]
    return np.concatenate([np.argmin(size - 2 * x[at : at + 8192] @ c.T, axis=1) for at in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


class Index:
    """Codebooks of both halves and the share of rows that a query visits."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, target: float = TARGET):
        self.half = sample.shape[1] // 2
        fit, unseen = (sample[::2], sample[1::2]) if len(sample) > 2 * FIT_ROWS * k else (sample, sample)
        size = int(np.clip(np.ceil(np.sqrt(rows / OCCUPANCY)), 2, min(MAX_CENTROIDS, max(2, len(fit) // FIT_ROWS))))
        self.first, self.second = kmeans(fit[:, : self.half], size), kmeans(fit[:, self.half :], size)
        self.share = self.calibrated(unseen, max(1, round(k * len(unseen) / rows)), target)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def calibrated(self, sample: np.ndarray, k: int, target: float) -> float:
        """Least share of the sample that must be visited to find `target` of its true neighbours."""
        cell = self.cells(sample)
        at = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
        needed = []
        for q in at.tolist():
            true = sample @ sample[q]
            true[q] = -np.inf
            top = np.argsort(-true, kind="stable")[: min(k, len(sample) - 1)]
            order = ((self.first @ sample[q, : self.half])[:, None] + (self.second @ sample[q, self.half :])[None]).ravel()[cell]
            needed += [(order > order[t]).mean() for t in top.tolist()]
        return float(np.quantile(needed, target)) if needed else 1.0

    def visit(self, q: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
        """Cells that hold rows, nearest first, until they hold `wanted` rows.

        The heap holds blocks of STEP by STEP pairs of the two sorted lists by their best sum; cells count once no
        block left can hold a better one.
        """
        u, v = self.first @ q[: self.half], self.second @ q[self.half :]
        iu, iv = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
        su, sv, width = u[iu], v[iv], len(self.second)
        rows, columns = -(-len(su) // STEP), -(-len(sv) // STEP)
        heap, reach = [(-(su[0] + sv[0]), 0, 0)], [0] * rows  # reach: blocks of a row that were pushed
        reach[0] = 1
        sums, cells, held = [], [], 0
        while heap:
            _, a, b = heapq.heappop(heap)
            x, y = slice(a * STEP, (a + 1) * STEP), slice(b * STEP, (b + 1) * STEP)
            cell = (iu[x, None] * width + iv[None, y]).ravel()
            filled = counts[cell] > 0
            cells.append(cell[filled])
            sums.append((su[x, None] + sv[None, y]).ravel()[filled])
            held += int(counts[cell].sum())
            if b + 1 < columns and reach[a] == b + 1 and (a == 0 or reach[a - 1] > b + 1):
                reach[a] = b + 2
                heapq.heappush(heap, (-(su[a * STEP] + sv[(b + 1) * STEP]), a, b + 1))
            if a + 1 < rows and reach[a + 1] == b and (b == 0 or reach[a + 1] >= b):
                reach[a + 1] = b + 1
                heapq.heappush(heap, (-(su[(a + 1) * STEP] + sv[b * STEP]), a + 1, b))
            if held >= wanted and heap:
                cells, sums = [np.concatenate(cells)], [np.concatenate(sums)]
                if counts[cells[0][sums[0] >= -heap[0][0]]].sum() >= wanted:
                    break
        cell, total = np.concatenate(cells), np.concatenate(sums)
        cell = cell[np.argsort(-total, kind="stable")]
        return cell[: np.searchsorted(np.cumsum(counts[cell]), wanted) + 1]


def usable(df: DataFrame, vector: str = "embedding", id: str = "vec_id", dim: int | None = None) -> DataFrame:
    """id long, vec array<double>: the rows that take part."""
    rows = df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    if dim is None:
        lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        dim = lengths["dim"] if lengths else 0
    return rows.where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


class Best:
    """The k best entries of each query so far (ties: smaller id); scores wait until there are enough to sort."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.waiting = k, [], 0
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, entry: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, entry, score))
        self.waiting += len(query)
        if self.waiting > WAITING:
            self.held = [self.sorted()]

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, entry, score = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((entry, -score, query))
        query, entry, score = query[order], entry[order], score[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        kept = rank < self.k
        self.waiting = int(kept.sum())
        return query[kept], entry[kept], score[kept]


def top_of_bin(entries: np.ndarray, ids: np.ndarray, cells: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, visited: list[np.ndarray], k: int):
    """query, entry, score of the k best entries of the bin in each query's visited cells (ties: smaller id), and the pairs that were scored."""
    order = np.argsort(cells, kind="stable")
    entries, ids, cells = entries[order], ids[order], cells[order]
    known, begin = np.unique(cells, return_index=True)
    end = np.append(begin[1:], len(cells))
    cell, query = np.concatenate(visited), np.repeat(np.arange(len(visited)), [len(v) for v in visited])
    by_cell = np.argsort(cell, kind="stable")
    cell, query = cell[by_cell], query[by_cell]
    low, high = np.searchsorted(cell, known), np.searchsorted(cell, known, "right")
    best, scored = Best(len(queries), k), 0
    for a, b, x, y in zip(begin.tolist(), end.tolist(), low.tolist(), high.tolist()):
        if x == y:
            continue
        asking = query[x:y]
        for at in range(a, b, 1024):
            these = slice(at, min(b, at + 1024))
            about = queries[asking] @ entries[these].T
            scored += about.size
            # The matrix product may differ in the last bits; what may be among the best is scored alike everywhere.
            p, q = np.nonzero(about >= (best.least[asking] - 1e-9 * np.maximum(1.0, np.abs(best.least[asking])))[:, None])
            p = asking[p]
            other = ids[these][q] != query_ids[p]
            p, q = p[other], q[other]
            for part in range(0, len(p), 1 << 16):
                pp, qq = p[part : part + (1 << 16)], q[part : part + (1 << 16)]
                best.add(pp, ids[these][qq], (entries[these][qq] * queries[pp]).sum(axis=1))
    at, e, s = best.sorted()
    return query_ids[at], e, s, scored


def fit(rows: DataFrame, total: int, k: int = 20, sample: int = SAMPLE, target: float = TARGET) -> Index:
    """Index fit on at most about `sample` of the usable rows (a share of the hash range of the ids)."""
    drawn = rows
    if total > sample:
        drawn = rows.where((F.xxhash64("id") % (1 << 30) + (1 << 30)) % (1 << 30) < int(sample / total * (1 << 30)))
    found = drawn.toArrow().sort_by("id")
    return Index(_matrix(found.column("vec")), total, k, target)


def search(df: DataFrame, queries: DataFrame | None = None, k: int = 20, vector: str = "embedding", id: str = "vec_id", every: int = 20, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. By default the rows whose id `every` divides."""
    spark = df.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows, _ = stored(usable(df, vector, id), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], empty)
    asked = rows.where(F.col("id") % every == 0) if queries is None else usable(queries, vector, id)
    index = fit(rows, total, k, sample, target)
    held = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.cells(_matrix(batch.column(1))).astype(np.int32))], ["id", "vec", "cell"])

    placed, _ = stored(rows.mapInArrow(assign, "id long, vec array<double>, cell int"), "cells")
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MAX_CENTROIDS squared
        counts[r["cell"]] = r["count"]
    # Bins: cells one after another until a bin is full; a cell over the size of a bin gets several of its own.
    most = max(1, -(-total // max(MIN_BINS, -(-total // BIN_ROWS))))
    first_bin, bins_of, now, held_rows = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for c in np.flatnonzero(counts).tolist():
        if held_rows and held_rows + counts[c] > most:
            now, held_rows = now + 1, 0
        parts = -(-int(counts[c]) // most)
        first_bin[c], bins_of[c] = now, parts
        if parts > 1:
            now, held_rows = now + parts, 0
        else:
            held_rows += int(counts[c])
    layout = spark.sparkContext.broadcast((counts, first_bin, bins_of))
    wanted = max(k + 1, int(np.ceil(index.share * total)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = layout.value
        for batch in batches:
            cell, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            salt = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % parts[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((first[cell] + salt.astype(np.int32)).astype(np.int32))], ["id", "vec", "cell", "bin"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, parts = layout.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                batch = whole.slice(begin, 64)
                picked, bins, lists = [], [], []
                for r, q in enumerate(_matrix(batch.column(1))):
                    cell = held.value.visit(q, sizes, wanted)
                    n = parts[cell]
                    cell, bin = np.repeat(cell, n), np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    order = np.argsort(bin, kind="stable")
                    of, starts = np.unique(bin[order], return_index=True)
                    picked += [r] * len(of)
                    bins += of.tolist()
                    lists += [x.astype("<i4").tobytes() for x in np.split(cell[order], starts[1:])]
                if picked:
                    taken = batch.take(pa.array(picked))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bins, pa.int32()), pa.array(lists, pa.binary())], ["query", "qvec", "bin", "visited"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            q, e, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            visited = [np.frombuffer(x.as_py(), "<i4") for x in right.column("visited")]
            q, e, s, _ = top_of_bin(_matrix(left.column("vec")), left.column("id").to_numpy(), left.column("cell").to_numpy(), _matrix(right.column("qvec")), right.column("query").to_numpy(), visited, k)
        return pa.table({"query_id": q, "vec_id": e, "score": s})

    probes, _ = stored(asked.mapInArrow(probe, "query long, qvec array<double>, bin int, visited binary"), "probes")
    often = F.broadcast(probes.groupBy("bin").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks")).where("chunks > 1"))  # one row for each bin at most
    chunks = F.coalesce("chunks", F.lit(1))
    entries = placed.mapInArrow(enter, "id long, vec array<double>, cell int, bin int").join(often, "bin", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    probes = probes.join(often, "bin", "left").withColumn("chunk", F.pmod(F.xxhash64("query"), chunks).cast("int")).select("query", "qvec", "bin", "visited", "chunk")
    entries = entries.select("id", "vec", "cell", "bin", "chunk")
    found = entries.groupBy("bin", "chunk").cogroup(probes.groupBy("bin", "chunk")).applyInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
