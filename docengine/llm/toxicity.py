"""Toxicity scores (operator 2): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, word pairs and pairs with one word between, hashed to 2^BITS indices; each
counts once. Learning rates are per coordinate and L1 keeps most weights at exactly zero, so the model that
is broadcast holds only the others (its size is bounded by 2^BITS whatever the corpus).

The model is fit on a bounded sample: about `sample` labelled rows, chosen by a hash of the id, so the same
rows are chosen whatever the partitions. Their feature indices come to the driver, which runs the passes
in a fixed order. Scores cover whole texts of all rows.

A null, empty or wordless text gets the score of the bias alone. Labels other than 0 and 1, null labels and
null ids teach nothing; repeated rows count as often as they come; with no labelled row or one class only,
every score is that class's rate (0.0 without rows). Other columns are not carried over.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import discard, held_out, map_slices, stored

BITS = 20
#: Labelled rows that the model is fit on, at most (as expected; the draw is by hash).
SAMPLE = 10_000
#: Bytes of their features that come to the driver at most (as expected; beyond it a share of the rows, by hash).
SAMPLE_BYTES = 256 << 20
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 3.0, 0.1, 5
MEMO_ENTRIES = 300_000

_words = re.compile(r"\w+").findall
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class WordHashes(dict):
    """64-bit hashes by word, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_HASHES = WordHashes()


def forget() -> None:
    """Let the remembered word hashes go."""
    _HASHES.clear()


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of the texts one after another, and the text that each belongs to; repeats included."""
    words = [_words(t.lower()) if t else [] for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    total = int(count.sum())
    get = _HASHES.__getitem__
    h = np.fromiter((get(x) for w in words for x in w), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), count)
    shift = np.uint64(64 - bits)
    index, of = [h * _MULTIPLIERS[0] >> shift], [owner]
    for gap in (1, 2):
        if total > gap:
            same = owner[gap:] == owner[:-gap]
            mixed = (h[:-gap] * _MULTIPLIERS[gap] + (h[gap:] ^ (h[gap:] >> np.uint64(29)))) * _MULTIPLIERS[0] >> shift
            index.append(mixed[same])
            of.append(owner[gap:][same])
    return np.concatenate(index).astype(np.int64), np.concatenate(of)


class Model:
    """Weights that are not zero, and the bias."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.index, self.weight, self.bias = index.astype(np.int32), weight.astype(np.float32), float(bias)

    def dense(self, bits: int = BITS) -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[self.index] = self.weight
        return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, passes: int = PASSES) -> Model:
    """FTRL-proximal over rows of distinct feature indices, `passes` times in an order drawn once."""
    if not len(rows) or labels.min() == labels.max():
        rate = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(0, np.int64), np.zeros(0), np.log(rate / (1 - rate)))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last coordinate is the bias, without L1
    l1 = np.full((1 << bits) + 1, L1)
    l1[-1] = 0.0
    order = np.random.default_rng(7).permutation(len(rows))

    def weights(at: np.ndarray) -> np.ndarray:
        za, la = z[at], l1[at]
        return np.where(np.abs(za) <= la, 0.0, -(za - np.sign(za) * la) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(passes):
        for r in order.tolist():
            at = np.append(rows[r], np.uint32(1 << bits)).astype(np.int64)
            w = weights(at)
            g = sigmoid(w.sum()) - labels[r]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    every = weights(np.arange((1 << bits) + 1))
    kept = np.flatnonzero(every[:-1])
    return Model(kept, every[kept], every[-1])


def score_texts(texts: list[str | None], dense: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Scores between 0 and 1; each distinct feature of a text counts once."""
    index, owner = features(texts, bits)
    hit = np.flatnonzero(dense[index])
    key = np.unique(owner[hit] << bits | index[hit])
    total = np.bincount(key >> bits, dense[key & ((1 << bits) - 1)], len(texts))
    return sigmoid(total + bias)


def train(df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Model from the labelled rows that are not held out; at most about `sample` of them."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id))).select(F.col(id).alias("key"), F.col(label).cast("int").alias("label"))
    n = known.count()
    if n > sample:
        share = int(sample / n * (1 << 30))
        known = known.where((F.xxhash64("key") % (1 << 30) + (1 << 30)) % (1 << 30) < share)
    rows = df.select(F.col(id).alias("key"), F.col(text).alias("body")).join(known, "key").select("key", "label", "body")

    def make() -> Callable:
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            index, owner = features(batch.column(2).to_pylist(), bits)
            key = np.unique(owner << bits | index)
            cuts = np.searchsorted(key >> bits, np.arange(1, batch.num_rows))
            packed = [x.astype("<u4").tobytes() for x in np.split(key & ((1 << bits) - 1), cuts)]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(packed, pa.binary())], ["key", "label", "features"])

        return apply

    drawn, path = stored(map_slices(rows, make, "key string, label int, features binary", "body", finish=forget), "features")
    size = drawn.agg(F.sum(F.octet_length("features"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        drawn = drawn.where((F.xxhash64("key", F.lit(1)) % (1 << 30) + (1 << 30)) % (1 << 30) < int(SAMPLE_BYTES / size * (1 << 30)))
    found = drawn.toArrow().sort_by([("key", "ascending"), ("features", "ascending")])
    discard(df.sparkSession, path)
    return fit([np.frombuffer(x.as_py(), "<u4") for x in found.column("features")], found.column("label").to_numpy().astype(np.float64), bits)


def score(df: DataFrame, model: Model, text: str = "text", id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """id, score double of every row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        dense, bias = held.value.dense(bits), held.value.bias

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1).to_pylist(), dense, bias, bits))], ["key", "score"])

        return apply

    rows = df.select(F.col(id).alias("key"), F.col(text).alias("body"))
    return map_slices(rows, make, f"key {rows.schema['key'].dataType.simpleString()}, score double", "body", finish=forget).withColumnRenamed("key", id)
