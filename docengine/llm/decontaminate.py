"""Benchmark decontamination (operator 5): SimHash of item-sized windows, multi-index blocks, exact check.

Words are runs of letters, digits and underscores of the lower-cased text; shingles are five words, repeats
included (an item of fewer words is one shingle). A window of a text has as many words as the item (the whole
text, if that is shorter). An item is found in a text where some window's weighted-shingle similarity

    sum of w(s) * min(count in window, count in item) / sum of w(s) * max(...)

is at least 0.8. w(s) is 1 over the number of different item texts that hold s, counted over the whole benchmark, so
phrases that many items share weigh less; shingles that the item does not hold weigh as its own do on average.

Fingerprints are taken where they can matter: a window without any shingle of an item has similarity zero, so
only windows around known shingles are fingerprinted (this loses nothing). The 128-bit SimHash of a window
meets those of the items of its length through BLOCKS blocks of 16 bits: two fingerprints within RADIUS bits
agree in some block up to RADIUS // BLOCKS bits, so the neighbourhoods of all blocks hold every item within
the radius. Candidates are then verified on the words themselves. At similarity 0.8 a pair differs in 19 bits
on average (deviation 4); RADIUS is four deviations above.

Texts stay where they are: no shuffle, so hot sources, repeated passages and very long texts are no burden
(a text is worked on in regions). The benchmark is broadcast in parts of at most PART_ITEMS items and
PART_BYTES bytes; more parts take more passes over the texts.

An item of fewer than five words matches wherever its words stand in a row, so a one-word item is found in every text
with that word: leave such items out of a benchmark that is to clean a corpus.

Null and empty texts and items match nothing; null ids are kept as null; repeated rows are reported as often
as they come. Of equally similar windows the first is reported. Other columns are not carried over.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import map_slices, stored

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 8, 36
PART_ITEMS, PART_BYTES = 20_000, 16 << 20
#: Windows of one text that are fingerprinted at a time, and words whose hashes a worker remembers.
REGION, MEMO_ENTRIES = 2048, 300_000
#: Bits of the table that rules out most shingles.
SIEVE_BITS = 22

_words = re.compile(r"\w+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_HASHES = WordHashes()


def forget() -> None:
    """Let the remembered word hashes go."""
    _HASHES.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of `width` words in a row, from word hashes; none if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out = (out ^ h[i : i + n]) * _BASE
        out ^= out >> np.uint64(32)
    return mixed(out)


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """128 signs (+1, -1) of each shingle."""
    both = np.stack([shingles, mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1).astype("<u8")
    return np.unpackbits(both.view(np.uint8).reshape(len(shingles), 16), axis=1, bitorder="little").astype(np.float32) * 2 - 1


def window_prints(shingles: np.ndarray, weights: np.ndarray, per_window: int) -> np.ndarray:
    """Fingerprints (8 blocks of 16 bits) of all windows of `per_window` shingles."""
    total = np.cumsum(bits_of(shingles) * weights[:, None], axis=0, dtype=np.float64)
    total = np.concatenate([np.zeros((1, 128)), total])
    return np.packbits(total[per_window:] - total[:-per_window] > 1e-9, axis=1, bitorder="little").view("<u2")


class Items:
    """Benchmark items by length, their shingles, weights and fingerprints with the multi-index over blocks."""

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY, width: int = SHINGLE, radius: int = RADIUS, spread: tuple[list, list, float] | None = None):
        """`spread`: hashes and counts of shingles that several texts of the whole benchmark hold, and the mean weight of its shingles; if these are all its items, None."""
        self.similarity, self.width, self.radius = similarity, width, radius
        kept = [(i, w) for i, w in ((i, tuple(_words((t or "").lower()))) for i, t in zip(ids, texts)) if w]
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        # Repeated items hold their shingles once. What no item holds weighs as much as a known shingle does on average.
        if spread is None:
            held = Counter(s for w in set(self.words) for s in set(self.shingles(w)))
            self.weight = {s: 1.0 / n for s, n in held.items()}
            self.unknown = sum(self.weight.values()) / max(1, len(self.weight))
        else:
            several, self.unknown = dict(zip(spread[0], spread[1])), spread[2]
            self.weight = {s: 1.0 / several.get(x, 1) for w in set(self.words) for s, x in zip(self.shingles(w), self.shingle_values(w).tolist())}
        self.counts = [Counter(self.shingles(w)) for w in self.words]
        self.other = [sum(self.weight[s] * n for s, n in c.items()) / sum(c.values()) for c in self.counts]
        hashes, values = [], []
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for n, w in enumerate(self.words):
            self.by_length[len(w)].append(n)
        self.holders: dict[int, set[int]] = defaultdict(set)  # shingle hash -> item lengths
        for w in self.words:
            h = self.hash_words(w)
            k = min(width, len(w))
            for s, value in zip(self.shingles(w), shingle_hashes(h, k).tolist()):
                self.holders[value].add(len(w))
                hashes.append(value)
                values.append(self.weight[s])
        order = np.unique(np.array(hashes, np.uint64), return_index=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.known, self.known_weight = order[0], np.array(values, np.float64)[order[1]]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.known >> np.uint64(64 - SIEVE_BITS)] = True
        self.widths = sorted({min(width, len(w)) for w in self.words})
        self.prints = {length: np.concatenate([self.print_of(self.words[n]) for n in at]) for length, at in self.by_length.items()}
        self.near: dict[tuple[int, int, int], np.ndarray] = {}

    def shingles(self, words: tuple[str, ...]) -> list[tuple[str, ...]]:
        k = min(self.width, len(words))
        return [words[i : i + k] for i in range(len(words) - k + 1)]

    def shingle_values(self, words) -> np.ndarray:
        """Hashes of `shingles`, as signed numbers."""
        return shingle_hashes(self.hash_words(words), min(self.width, len(words))).view(np.int64)

    def hash_words(self, words) -> np.ndarray:
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))

    def weights_of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(shingles))  # there is no item
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.known_weight[at], self.unknown)

    def print_of(self, words: tuple[str, ...]) -> np.ndarray:
        s = shingle_hashes(self.hash_words(words), min(self.width, len(words)))
        return window_prints(s, self.weights_of(s), len(s))

    def block_neighbours(self, length: int, block: int, value: int) -> np.ndarray:
        """Items of this length whose block differs from `value` in RADIUS // BLOCKS bits at most; remembered."""
        key = (length, block, value)
        if key not in self.near:
            if len(self.near) > MEMO_ENTRIES:
                self.near.clear()
            self.near[key] = np.flatnonzero(np.bitwise_count(self.prints[length][:, block] ^ np.uint16(value)) <= self.radius // BLOCKS)
        return self.near[key]

    def candidates(self, prints: np.ndarray, length: int) -> list[tuple[int, int]]:
        """(window, item) pairs within the radius."""
        out = []
        table = self.prints[length]
        for w, value in enumerate(prints.tolist()):
            found = [x for b in range(BLOCKS) if len(x := self.block_neighbours(length, b, value[b]))]
            if found:
                at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
                at = at[np.bitwise_count(table[at] ^ prints[w]).sum(axis=1) <= self.radius]
                out += [(w, self.by_length[length][i]) for i in at.tolist()]
        return out

    def verified(self, words: tuple[str, ...], item: int) -> float:
        """Exact weighted-shingle similarity of a window and an item; shingles that the item has not weigh as its own do on average."""
        mine, other = Counter(self.shingles(words)), self.counts[item]
        low = high = 0.0
        for s in mine.keys() | other.keys():
            a, b = mine.get(s, 0), other.get(s, 0)
            w = self.weight[s] if b else self.other[item]
            low, high = low + w * min(a, b), high + w * max(a, b)
        return low / high if high else 0.0

    def anchors(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of known shingles of k words."""
        s = shingle_hashes(h, k)
        at = np.flatnonzero(self.sieve[s >> np.uint64(64 - SIEVE_BITS)]) if len(self.known) else np.zeros(0, int)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
            at = at[self.known[place] == s[at]]
        return at, s[at]

    def scan(self, words: list[str], h: np.ndarray, hits: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of one text. hits: (position, shingle hash, words of the shingle)."""
        n, best = len(words), {}
        starts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, value, k in hits:
            for length in self.holders[value]:
                if n >= length:
                    starts[length].append((max(0, at - length + k), min(n - length, at)))
                elif n >= self.width:
                    starts[length].append((0, 0))
        for length, ranges in starts.items():
            size = min(length, n)
            k = min(self.width, size)
            ranges.sort()
            merged: list[list[int]] = []
            for a, b in ranges:
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for first, last in merged:
                for a in range(first, last + 1, REGION):
                    b = min(last, a + REGION - 1)
                    s = shingle_hashes(h[a : b + size], k)
                    prints = window_prints(s, self.weights_of(s), size - k + 1)
                    for w, item in self.candidates(prints, length):
                        value = self.verified(tuple(words[a + w : a + w + size]), item)
                        if value >= self.similarity and (item not in best or value > best[item][0] or value == best[item][0] and a + w < best[item][1]):
                            best[item] = (value, a + w, size)
        return best


def scan_batch(items: Items, texts: list[str | None]) -> list[dict[int, tuple[float, int, int]]]:
    """`Items.scan` for each text; anchors are looked up for all of them at once."""
    words = [_words(t.lower()) if t else [] for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((_HASHES[x] for w in words for x in w), np.uint64, int(count.sum()))
    ends = np.cumsum(count)
    hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k in items.widths:
        at, value = items.anchors(h, k)
        owner = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[owner]
        for a, v, o in zip(at[inside].tolist(), value[inside].tolist(), owner[inside].tolist()):
            hits[o].append((a - int(ends[o] - count[o]), v, k))
    return [items.scan(words[i], h[ends[i] - count[i] : ends[i]], hits[i]) if i in hits else {} for i in range(len(texts))]


def _held_shingles(rows: DataFrame) -> DataFrame:
    """text (hash of the item's words), shingle (hash): each shingle of each item's text."""

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            items = Items(list(range(batch.num_rows)), batch.column(0).to_pylist(), spread=([], [], 1.0))
            values = [np.unique(items.shingle_values(w)) for w in items.words]
            names = [hashlib.sha256(" ".join(w).encode("utf-8", "surrogatepass")).digest() for w in items.words]
            owner = np.repeat(np.arange(len(values)), [len(x) for x in values])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).take(pa.array(owner)), pa.array(np.concatenate(values) if values else [], pa.int64())], ["text", "shingle"])

        return apply

    return map_slices(rows.select("words"), make, "text binary, shingle long", "words", finish=forget)


def parts_of(benchmark: DataFrame, text: str, id: str) -> Iterator[tuple[pa.Table, tuple | None]]:
    """The benchmark in parts whose size is checked, one at a time: items in order, and what `Items` takes as `spread` if there are several parts."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(id).alias("item"), F.col(text).alias("words"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    parts = max(1, -(-n // PART_ITEMS), -(-size // PART_BYTES))
    in_order = lambda part: part.toArrow().sort_by([("item", "ascending"), ("words", "ascending")])
    if parts == 1:
        yield in_order(rows), None
        return
    counts, _ = stored(_held_shingles(rows).distinct().groupBy("shingle").agg(F.count("*").alias("n")), "shingles")
    mean = counts.agg(F.avg(1 / F.col("n"))).first()[0] or 1.0
    for p in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == p)
        several = counts.where("n > 1").join(_held_shingles(part).select("shingle").distinct(), "shingle").toArrow()
        yield in_order(part), (several.column("shingle").to_pylist(), several.column("n").to_pylist(), mean)


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """id, item_id, similarity double, first_word long, n_words long: each item found in each text, at its best window."""
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("key"), F.col(text).alias("body"))
    key, item = rows.schema["key"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    out = None
    for found, spread in parts_of(benchmark, item_text, item_id):
        held = spark.sparkContext.broadcast((found.column("item").to_pylist(), found.column("words").to_pylist(), spread))

        def make(held=held, item_type=found.schema.field("item").type) -> Callable:
            items = Items(*held.value[:2], similarity, spread=held.value[2])

            def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
                at, ids, values, first, size = [], [], [], [], []
                for i, best in enumerate(scan_batch(items, batch.column(1).to_pylist())):
                    for n, (value, a, length) in sorted(best.items()):
                        at.append(i)
                        ids.append(items.ids[n])
                        values.append(value)
                        first.append(a)
                        size.append(length)
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, item_type), pa.array(values, pa.float64()), pa.array(first, pa.int64()), pa.array(size, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["key", "item_id", "similarity", "first_word", "n_words"])

            return apply

        one = map_slices(rows, make, f"key {key}, item_id {item}, similarity double, first_word long, n_words long", "body", finish=forget)
        if spread is not None:  # written before the next part comes, so that the driver holds one part at a time
            one, _ = stored(one, "contaminated")
            held.destroy()
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("key", id)


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of df in whose text no item is found; all columns stay."""
    spark = df.sparkSession
    rows = df
    for found, spread in parts_of(benchmark, options.get("item_text", "text"), options.get("item_id", "item_id")):
        held = spark.sparkContext.broadcast((found.column("item").to_pylist(), found.column("words").to_pylist(), spread))
        at = rows.columns.index(text)

        def make(held=held, at=at) -> Callable:
            items = Items(*held.value[:2], options.get("similarity", SIMILARITY), spread=held.value[2])

            def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not best for best in scan_batch(items, batch.column(at).to_pylist())], pa.bool_()))

            return apply

        rows = map_slices(rows, make, rows.schema, text, finish=forget)
        if spread is not None:
            rows, _ = stored(rows, "clean")
            held.destroy()
    return rows
