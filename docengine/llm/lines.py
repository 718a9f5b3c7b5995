"""Line de-duplication by winnowing (operator 9).

Texts are sequences of lines in the order of their ids; words are split at white space, lines without words are
passed over. A line is deleted if it lies whole in a run of `least` words or more (MIN_WORDS by default) that already
stands in an earlier text, or earlier in the same text without overlap; the run may begin and end inside lines, whose
words stay. Of lines without words those inside a run go. The first occurrence stays.

1. Texts whose lines are all equal are one: of `least` words or more, all but the first are runs as a whole.
2. Fingerprints: of each two neighbouring lines the one with the lesser hash is selected (the minimum of a winnowing
   window), and a line that with its neighbours has `least` words, so could be the only whole line of a run. Every
   run whose inner line breaks are the same in both texts holds a selected line.
3. A run that holds a selected line reaches, to its left or its right, half of the words that the line lacks of
   `least`. So each selected line has two fingerprints, itself with so many words before it and after it. They are
   counted (partial sums first); those that stand once go no further, nor do common lines in different surroundings.
4. From the others matches are extended both ways, word by word, through all windows of `least` words that hold them. A
   window joins its first occurrence (a partial minimum; the few very frequent ones are broadcast, so frequent
   passages are no burden); a run of any length is a union of its windows.
5. Lines that lie in windows with an earlier occurrence are deleted by built-in expressions.

Windows and texts are compared by 128-bit digests of their words, fingerprints (which only select) by 64 bits.

A null text stays null and an empty one empty. Null ids come last in the order; rows with the same id come
in the order of a hash of their texts; rows that repeat id and text are one text and are all treated alike.
All columns stay, whatever their names; `n_chars`, if there is one, is counted again.
An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import fits, map_slices, meet, stored, unused
from docengine.llm.decontaminate import _HASHES, forget, mixed

#: Words of the shortest run that counts as repeated.
MIN_WORDS = 50
_LAST, _MASK = (1 << 63) - 1, (1 << 64) - 1
_BASES = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class Powers:
    """Powers of a base modulo 2^64 and of its inverse, for texts of any length met so far."""

    def __init__(self, base: int):
        self.factors = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(1024, 1 << n.bit_length())
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, f))]) for f in self.factors)
        return self.up, self.down


_POWERS = [Powers(b) for b in _BASES]


class Sequence:
    """Lines with words of a text: their numbers, word counts and hashes, and digests of words in a row."""

    def __init__(self, text: str):
        self.at, self.counts, self.words, self.lines = [], [], [], []
        for i, line in enumerate(text.split("\n")):
            if found := line.split():
                self.at.append(i)
                self.counts.append(len(found))
                self.words += found
                self.lines.append(_joined(found))
        self.hashes = [xxhash.xxh64_intdigest(x) for x in self.lines]
        self.total = [0, *itertools.accumulate(self.counts)]
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def whole(self) -> bytes:
        """128-bit digest of all lines."""
        return xxhash.xxh3_128_digest(b"\n".join(self.lines))

    def digest(self, start: np.ndarray, end: np.ndarray, half: int = 0) -> np.ndarray:
        """64-bit digests (two different ones) of the words start to end, for many of them: a polynomial of the words' hashes, from prefix sums."""
        n = len(self.words)
        if half not in self.sums:
            up, down = _POWERS[half].upto(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed(np.fromiter(map(_HASHES.__getitem__, self.words), np.uint64, n) + np.uint64(half)) * up[:n], out=sums[1:])
            self.sums[half] = sums, down
        sums, down = self.sums[half]
        # Divided by the power of the first word's place, equal words agree wherever they stand.
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _joined(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "surrogatepass")


def selected(hashes: list[int], counts: list[int], least: int) -> list[int]:
    """Numbers of the lines that winnowing selects: minima of two neighbours (of equal ones the later), and lines that can be alone in a run."""
    last, out = len(counts) - 1, []
    for i, (h, c) in enumerate(zip(hashes, counts)):
        around = c + (counts[i - 1] if i else 0) + (counts[i + 1] if i < last else 0)
        if around >= least or i and h <= hashes[i - 1] or i < last and h < hashes[i + 1]:
            out.append(i)
    return out


def fingerprints(text: Sequence, least: int) -> tuple[list[int], list[int]]:
    """Numbers of selected lines and their fingerprints: each line with the words before it, and after it, where there are so many."""
    at, prints = [], []
    for i in selected(text.hashes, text.counts, least):
        s, e = text.total[i], text.total[i + 1]
        half = -((e - s - least) // 2)
        if half <= 0:
            at.append(i)
            prints.append(text.hashes[i])
            continue
        for begin, end, side in ((s - half, e, 1), (s, e + half, 2)):
            if begin >= 0 and end <= text.total[-1]:
                at.append(i)
                prints.append(xxhash.xxh64_intdigest(_joined(text.words[begin:end]), side))
    return at, prints


def window_starts(total: list[int], live: list[int], least: int) -> np.ndarray:
    """First words of the windows that extend matches from the lines `live`: all that hold one whole; of a line of `least` words or more, windows that cover it and one that leads on."""
    wanted = np.zeros(max(0, total[-1] - least + 1), bool)
    for i in live:
        s, e = total[i], total[i + 1]
        if e - s < least:
            wanted[max(0, e - least) : s + 1] = True
        else:
            wanted[s : e - least + 1 : least] = True
            wanted[e - least : e - least + 2] = True
    return np.flatnonzero(wanted)


def runs_of(at: np.ndarray, counts: np.ndarray, starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, last) line numbers of the lines that lie whole in the windows, and of those that one window joins."""
    total = np.concatenate([[0], np.cumsum(counts)])
    s, e = total[:-1], total[1:]
    starts = np.sort(starts)
    among = lambda low, high: np.searchsorted(starts, high, "right") > np.searchsorted(starts, low, "left")
    gone = (e - s < least) & among(e - least, s)
    have = set(starts.tolist())
    for i in np.flatnonzero(e - s >= least).tolist():
        gone[i] = have.issuperset(range(s[i], e[i] - least + 1, least)) and int(e[i]) - least in have
    bound = among(e - least + 1, e - 1)
    out, i, n = [], 0, len(at)
    while i < n:
        j = i
        if gone[i]:
            while j + 1 < n and gone[j + 1] and bound[j]:
                j += 1
            out.append((int(at[i]), int(at[j])))
        i = j + 1
    return out


def _sequences(rows: DataFrame, least: int) -> DataFrame:
    """pos, k1, lines, counts (packed), digest (of all lines) and prints (fingerprints, twice if they repeat) of each text of `least` words or more."""

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, lines, counts, digests, prints = [], [], [], [], []
            for i, body in enumerate(batch.column(2).to_pylist()):
                text = Sequence(body or "")
                if text.total[-1] >= least:
                    kept.append(i)
                    lines.append(np.array(text.at, "<i4").tobytes())
                    counts.append(np.array(text.counts, "<i4").tobytes())
                    digests.append(text.whole())
                    values, n = np.unique(np.array(fingerprints(text, least)[1], np.uint64), return_counts=True)
                    prints.append(np.concatenate([values, values[n > 1]]).view(np.int64))
            taken = batch.take(pa.array(kept, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), pa.array(lines, pa.binary()), pa.array(counts, pa.binary()), pa.array(digests, pa.binary()), pa.array(prints, pa.list_(pa.int64()))],
                ["pos", "k1", "lines", "counts", "digest", "prints"],
            )

        return apply

    return map_slices(rows, make, "pos long, k1 long, lines binary, counts binary, digest binary, prints array<long>", "body", finish=forget)


def _windows(rows: DataFrame, least: int) -> DataFrame:
    """pos, k1, start (number of the first word), block (digest) of the windows around lines with a fingerprint among `shared`."""

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, start, block = [], [], []
            for i in range(batch.num_rows):
                text = Sequence(batch.column(2)[i].as_py())
                at, prints = fingerprints(text, least)
                shared = {x & _MASK for x in batch.column(3)[i].as_py()}
                live = sorted({line for line, x in zip(at, prints) if x in shared})
                starts = window_starts(text.total, live, least)
                digests = np.stack([text.digest(starts, starts + least), text.digest(starts, starts + least, 1)], axis=1)
                owner += [i] * len(starts)
                start.append(starts)
                packed = digests.tobytes()
                block += [packed[x : x + 16] for x in range(0, len(packed), 16)]
            taken = batch.select(["pos", "k1"]).take(pa.array(owner, pa.int64()))
            return pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(np.concatenate(start).astype(np.int32)), pa.array(block, pa.binary())], ["pos", "k1", "start", "block"])

        return apply

    return map_slices(rows, make, "pos long, k1 long, start int, block binary", "body", most=1 << 19, finish=forget)


def _runs(rows: DataFrame, least: int) -> DataFrame:
    """pos, k1, runs from pos, k1, lines, counts and the starts of the windows with an earlier occurrence."""

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            unpacked = lambda column, i: np.frombuffer(batch.column(column)[i].as_py(), "<i4").astype(np.int64)
            runs = [[{"first": a, "last": b} for a, b in runs_of(unpacked(2, i), unpacked(3, i), np.array(batch.column(4)[i].as_py(), np.int64), least)] for i in range(batch.num_rows)]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, kind)], ["pos", "k1", "runs"])

        return apply

    return map_slices(rows, make, "pos long, k1 long, runs array<struct<first:int,last:int>>", "lines")


def repeated_runs(df: DataFrame, text: str = "text", id: str = "doc_id", least: int = MIN_WORDS) -> DataFrame:
    """pos, k1 (the text's place in the order and hash), runs array<struct<first int, last int>>: the lines to delete."""
    rows = df.where(F.col(text).isNotNull()).select(*_place(text, id), F.col(text).alias("body"))
    every, _ = stored(_sequences(rows, least), "lines")
    first, _ = stored(every.groupBy("digest").agg(F.min(F.struct("pos", "k1")).alias("first"), F.count("*").alias("n")).where("n > 1"), "equal")
    placed = meet(every.select("pos", "k1", "lines", "digest"), first, "digest")
    copies, _ = stored(placed.where((F.col("first.pos") != F.col("pos")) | (F.col("first.k1") != F.col("k1"))).select("pos", "k1", "lines").distinct(), "copies")
    texts = every.join(copies.select("pos", "k1"), ["pos", "k1"], "left_anti").dropDuplicates(["pos", "k1"])
    prints = texts.select("pos", "k1", F.explode("prints").alias("print"))
    several, _ = stored(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "prints")
    shared, _ = stored(meet(prints, several, "print").groupBy("pos", "k1").agg(F.collect_set("print").alias("shared")), "shared")
    windows, _ = stored(_windows(rows.join(fits(shared.select("pos", "k1")), ["pos", "k1"], "left_semi").join(shared, ["pos", "k1"]).select("pos", "k1", "body", "shared"), least), "windows")
    here = F.struct("pos", "k1", "start")
    origin, _ = stored(windows.groupBy("block").agg(F.min(here).alias("origin"), F.count("*").alias("n")).where("n > 1"), "origins")
    # In the same text the earlier occurrence must end before the later one begins.
    earlier = (F.col("origin.pos") != F.col("pos")) | (F.col("origin.k1") != F.col("k1")) | (F.col("origin.start") + least <= F.col("start"))
    later = meet(windows, origin, "block").where(earlier).groupBy("pos", "k1").agg(F.collect_set("start").alias("starts"))
    parts = _runs(texts.select("pos", "k1", "lines", "counts").join(later, ["pos", "k1"]), least).where(F.size("runs") > 0)
    return parts.unionByName(_whole(copies))


def _whole(copies: DataFrame) -> DataFrame:
    """pos, k1, runs: one run from the first line with words to the last."""

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            lines = [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            runs = [[{"first": int(x[0]), "last": int(x[-1])}] for x in lines]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["pos", "k1", "runs"])

        return apply

    return map_slices(copies, make, "pos long, k1 long, runs array<struct<first:int,last:int>>", "lines")


def _place(text: str, id: str) -> list:
    return [F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("pos"), F.xxhash64(F.col(id), F.col(text)).alias("k1")]


def dedup_lines(df: DataFrame, text: str = "text", id: str = "doc_id", chars: str = "n_chars", least: int = MIN_WORDS) -> DataFrame:
    """df with repeated runs deleted from `text` (and `chars` counted again); rows and columns stay."""
    pos, k1, runs = unused(df.columns, "pos", "k1", "runs")
    place = [x.alias(n) for x, n in zip(_place(text, id), (pos, k1))]
    found, _ = stored(repeated_runs(df, text, id, least).select(F.col("pos").alias(pos), F.col("k1").alias(k1), F.col("runs").alias(runs)), "runs")
    rows = df.select("*", *place).join(fits(found, F.size(runs)), [pos, k1], "left")
    gone = lambda i: F.exists(runs, lambda r: (r["first"] <= i) & (i <= r["last"]))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~gone(i)), "\n")
    rows = rows.withColumn(text, F.when(F.col(runs).isNull(), F.col(text)).otherwise(kept))
    if chars in df.columns:
        rows = rows.withColumn(chars, F.when(F.col(runs).isNull(), F.col(chars)).otherwise(F.length(text).cast(df.schema[chars].dataType)))
    return rows.select(*df.columns)
