"""Language identification by multilingual mixtures (operator 6).

A model of hashed character n-grams gives each word a likelihood in every language. A text is a mixture:
expectation-maximisation over its words estimates the proportion of each language. Which languages it holds
is chosen by penalised likelihood (BIC): languages enter in order of their proportion while each one's gain
in log-likelihood exceeds its penalty: half the logarithm of the number of words (BIC) and MARGIN. The prediction is the language with the largest proportion in the
chosen set (ties: the alphabetically first), its score that proportion.

The model is fit on a bounded sample: about `per_lang` rows of each language that are not held out, chosen
by a hash of id and text; n-grams are counted on the executors and summed before they reach the driver (at
most languages x 2^BITS counts). Predictions use whole texts of all rows.

A null text, or one without a letter, is `und` with score 0. Letters that no language has seen leave all
languages equal. Without training rows every text is `und`. Null ids are allowed; repeated rows are scored
one by one; other columns are not carried over.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docengine.llm.common import held_out, map_slices, slices, smaller_batches

BITS = 15
#: Rows of each language that the model is fit on, at most (as expected; the draw is by hash).
PER_LANG = 3000
SMOOTHING, ROUNDS, MARGIN = 0.5, 12, 1.0
MEMO_ENTRIES, MEMO_CHARS = 250_000, 40
UNDETERMINED = "und"

_words = re.compile(r"[^\W\d_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (2 and 3) of words with a boundary on both sides, and the word of each."""
    joined = " " + " ".join(words) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    space = c == 32
    word = np.cumsum(space) - 1  # the boundary before a word belongs to it
    shift, index, owner = np.uint64(64 - bits), [], []
    three = ((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]) * _MIX >> shift
    inside = ~space[1:-1]
    index.append(three[inside])
    owner.append(word[1:-1][inside])
    two = ((c[:-1] << np.uint64(21)) ^ c[1:] ^ np.uint64(1 << 62)) * _MIX >> shift
    inside = ~space[:-1]
    index.append(two[inside])
    owner.append(word[:-1][inside])
    return np.concatenate(index).astype(np.int64), np.concatenate(owner)


class Model:
    """Languages in alphabetical order and log-probabilities of the n-gram indices (float32, 2^BITS by languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logs = np.log((counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)).astype(np.float32)


class Words:
    """Relative likelihoods of words in each language, remembered within bounds."""

    def __init__(self, model: Model, bits: int):
        self.model, self.bits, self.known = model, bits, {}
        self.logs = np.zeros((0, len(model.langs)), np.float32)
        self.letters = np.zeros(0, bool)

    def rows(self, texts: list[list[str]]) -> np.ndarray:
        """Row numbers of all words, in order. Rows stay valid until the next call."""
        known = self.known
        if len(known) >= MEMO_ENTRIES:
            known.clear()
            self.logs, self.letters = self.logs[:0], self.letters[:0]
        new = list(set().union(*texts).difference(known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            index, owner = grams(new, self.bits)
            order = np.argsort(owner, kind="stable")
            starts = np.searchsorted(owner[order], np.arange(len(new)))
            self.logs = np.concatenate([self.logs, np.add.reduceat(self.model.logs[index[order]], starts, axis=0)])
            self.letters = np.concatenate([self.letters, np.fromiter((any(map(str.isalpha, w)) for w in new), bool, len(new))])
        get = known.__getitem__
        return np.fromiter((get(w) for t in texts for w in t), np.int64, sum(map(len, texts)))


def mixtures(likelihood: np.ndarray, starts: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: proportions (texts by languages) from `share` on, and log-likelihoods (relative to each word's best language)."""
    for _ in range(rounds):
        part = likelihood * np.repeat(share, counts, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, starts, axis=0) / counts[:, None]
    total = np.log((likelihood * np.repeat(share, counts, axis=0)).sum(axis=1))
    return share, np.add.reduceat(total, starts)


def infer(logs: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions of the chosen languages (zero for the others) of texts with `counts` words each (one at least)."""
    n, k = len(counts), logs.shape[1]
    if not n:
        return np.zeros((0, k))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    relative = logs - logs.max(axis=1, keepdims=True)
    likelihood = np.maximum(np.exp(relative.astype(np.float64)), 1e-30)
    share, _ = mixtures(likelihood, starts, counts, np.full((n, k), 1.0 / k), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    single = np.add.reduceat(np.log(likelihood), starts, axis=0)
    first = np.argmax(single, axis=1)
    best = np.zeros((n, k))
    best[np.arange(n), first] = 1.0
    gained = single[np.arange(n), first]
    open_ = np.arange(n)
    for size in range(2, k + 1):
        # Only texts that took the last language try the next one.
        row = np.repeat(np.isin(np.arange(n), open_), counts)
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
        begin = np.maximum(share[open_], 1e-3) * allowed
        begin /= begin.sum(axis=1, keepdims=True)
        c = counts[open_]
        tried, value = mixtures(likelihood[row], np.concatenate([[0], np.cumsum(c)[:-1]]), c, begin, rounds)
        better = value - gained[open_] > 0.5 * np.log(np.maximum(c, 2)) + MARGIN
        took = open_[better]
        best[took] = tried[better]
        gained[took] = value[better]
        open_ = took
        if not len(open_):
            break
    return best


def predict_texts(texts: list[str | None], words: Words) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and proportions of whole texts."""
    langs = words.model.langs
    found = [_words(t.lower()) if t else [] for t in texts]
    share = np.zeros((len(texts), len(langs)))
    counts = np.array([len(x) for x in found], np.int64)
    if langs and counts.any():
        rows = words.rows(found)
        some = np.flatnonzero(counts)
        lettered = np.logical_or.reduceat(words.letters[rows], np.concatenate([[0], np.cumsum(counts[some])[:-1]]))
        share[some] = infer(words.logs[rows], counts[some])
        share[some[~lettered]] = 0.0
    top = share.argmax(axis=1) if langs else np.zeros(len(texts), np.int64)
    score = share.max(axis=1) if langs else np.zeros(len(texts))
    return [langs[i] if s > 0 else UNDETERMINED for i, s in zip(top.tolist(), score.tolist())], np.clip(score, 0.0, 1.0), share


def train(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_lang: int = PER_LANG, bits: int = BITS) -> Model:
    """Model from the rows with text and lang that are not held out; about `per_lang` of each language at most."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(id))).select(F.col(lang).alias("lang"), F.col(id).alias("key"), F.col(text).alias("body"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << bits, 0)))
    share = F.lit(0)
    for x in langs:
        share = F.when(F.col("lang") == x, F.lit(int(min(1.0, per_lang / sizes[x]) * (1 << 30)))).otherwise(share)
    drawn = rows.where((F.xxhash64("key", "body") % (1 << 30) + (1 << 30)) % (1 << 30) < share).select("lang", "body")

    def run(batches):
        total = np.zeros((len(langs), 1 << bits), np.int64)
        place = {x: i for i, x in enumerate(langs)}
        for batch in slices(batches, "body"):
            for lang_, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := _words(body.lower()):
                    total[place[lang_]] += np.bincount(grams(found, bits)[0], minlength=1 << bits)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], ["l", "g", "n"])

    smaller_batches(df)
    summed = drawn.mapInArrow(run, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << bits, len(langs)))
    counts[summed.column("g").to_numpy(), summed.column("l").to_numpy()] = summed.column("n").to_numpy()
    return Model(langs, counts)


def predict(df: DataFrame, model: Model, text: str = "text", id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """id, lang_pred string, score double, proportions map of every row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        words = Words(held.value, bits)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, share = predict_texts(batch.column(1).to_pylist(), words)
            held_share = [[(x, float(v)) for x, v in zip(words.model.langs, row) if v > 0] for row in share.tolist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(held_share, pa.map_(pa.string(), pa.float64()))],
                ["key", "lang_pred", "score", "proportions"],
            )

        return apply

    rows = df.select(F.col(id).alias("key"), F.col(text).alias("body"))
    return map_slices(rows, make, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double, proportions map<string,double>", "body").withColumnRenamed("key", id)


def annotate(df: DataFrame, model: Model, text: str = "text", bits: int = BITS, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the predicted language and its score added under `names` (columns of these names are replaced); all rows and other columns stay."""
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.drop(*names)
    at = rows.columns.index(text)

    def make() -> Callable:
        words = Words(held.value, bits)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, _ = predict_texts(batch.column(at).to_pylist(), words)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *names])

        return apply

    schema = StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return map_slices(rows, make, schema, text)
