"""Language-model scoring over an Elias-Fano n-gram trie (operator 11).

Words are maximal runs other than ASCII white space, A-Z lower-cased; each text ends with an end token, which also stands
before its first word. With c the training counts, N their sum and V the number of different tokens,

    p(w)     = (c(w) + 1) / (N + V + 1)                     the base, which every unknown word shares
    p(w | v) = (c(v w) + PRIOR p(w)) / (c(v) + PRIOR)       the model: a hierarchical Dirichlet prior, it adds up to 1

Nothing is pruned and nothing is collected: counts and model are dealt over shards, and texts come to the shards.

1. Texts become chunks of about TOKENS tokens: places in a sorted dictionary of 64-bit word hashes (computed by the JVM).
2. Each word shard adds up its words over the dictionaries of all chunks, numbers them by falling count and sends
   count and number back. A number also tells the count (exact to 1024, then in steps of half a per cent).
3. Each chunk sends the different pairs of known words, with their training counts and the documents they stand in, to the
   shard of the first word. Words with over SPLIT training tokens are split further by the second word.
4. Each pair shard adds up the counts, builds its trie of smoothed, quantised probabilities in a memory-mapped file,
   looks up the pairs of every chunk and returns one sum for each document of the chunk.

A shard holds a few million entries whatever the size of the input, which sets their number. The base is exact but for clashes of
64-bit hashes (about one word in a billion at ten billion different words).

A null text is empty (one end token); rows with null or repeated ids stay, each on its own. Without training rows
every probability is 1. An empty table gives no rows. Other columns are not carried over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import discard, smaller_batches, stored, trim
from docengine.llm.trie import Trie, mapped

#: Strength of the prior: so many tokens of p(w) are added to each context.
PRIOR = 200.0
#: Tokens and documents of a chunk; training tokens of a context in one shard.
TOKENS, DOCUMENTS, SPLIT = 1 << 19, 1 << 14, 1 << 19
#: Characters of input for each shard of words and of pairs.
WORD_SHARD, PAIR_SHARD = 1 << 25, 8 << 20
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Numbers of words: the class of the count above these bits, the rank below.
_RANK = 40
_EXACT, _RATIO = 1024, np.log(1.005)
_ZSTD = pa.Codec("zstd", compression_level=1)


def count_class(counts: np.ndarray) -> np.ndarray:
    """Class of each count: the count itself to _EXACT, then steps of half a per cent."""
    return np.where(counts <= _EXACT, counts, _EXACT + np.rint(np.log(np.maximum(counts, 1) / _EXACT) / _RATIO)).astype(np.int64)


def class_count(classes: np.ndarray) -> np.ndarray:
    return np.where(classes <= _EXACT, classes, _EXACT * np.exp((classes - _EXACT) * _RATIO)).astype(np.float64)


def count_of(numbers: np.ndarray) -> np.ndarray:
    """The training count that a word's number tells."""
    return class_count(numbers >> _RANK)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: whole numbers in the fewest bytes, byte by byte, compressed."""
    out = [struct.pack("<B", len(arrays))]
    for x in arrays:
        if x.dtype.kind != "f":
            x = x.astype(np.uint64) if x.dtype.kind == "b" or not len(x) or x.min() >= 0 else x.astype(np.int64)
            width = next((w for w in (1, 2, 4) if x.dtype.kind == "u" and (not len(x) or int(x.max()) < 1 << 8 * w)), 8)
            x = x.astype(f"<{x.dtype.kind}{width}")
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
        body = _ZSTD.compress(planes, asbytes=True) if planes else b""
        out += [struct.pack("<cBQQ", x.dtype.kind.encode(), x.itemsize, len(x), len(body)), body]
    return b"".join(out)


def unpack(packed: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(packed[0]):
        kind, width, n, size = struct.unpack_from("<cBQQ", packed, at)
        at += struct.calcsize("<cBQQ")
        planes = np.frombuffer(_ZSTD.decompress(packed[at : at + size], n * width), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(width, n).T).ravel().view(f"<{kind.decode()}{width}"))
        at += size
    return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of unsigned hashes: the order of hashes is the order of shards."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers (two multiplications with shifts)."""
    x = (x.astype(np.uint64) ^ (x.astype(np.uint64) >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pair_shard(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    parts = np.maximum(1, np.ceil(count_of(v) / SPLIT)).astype(np.uint64)
    return shard_of(mixed(mixed(v) + mixed(w) % parts), shards)


def _cut(sizes: np.ndarray) -> np.ndarray:
    """Where groups of these sizes begin."""
    return np.cumsum(sizes) - sizes


END = " "


def tokens(text: Column) -> Column:
    """64-bit hashes of the words, then that of the end token (white space, which no word is)."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACE), lambda w: w != "")
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(END))))


_CHUNKS = "words boolean, chunk long, shard int, data binary"


def chunks(df: DataFrame, trained: Column, shards: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row for each chunk of texts (documents, tokens), and one for each of its shards of words (hashes, training counts)."""
    end = df.sparkSession.range(1).select(F.xxhash64(F.lit(END))).first()[0]
    smaller_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        flags: list = []
        lengths: list = []
        held: list = []
        n = 0

        def emit() -> pa.RecordBatch:
            at_end = np.array(end, np.int64).view(np.uint64)
            words, place = np.unique(np.concatenate(held).view(np.uint64), return_inverse=True)
            sizes, taught = np.array(lengths, np.int64), np.array(flags, bool)
            counts = np.bincount(place, weights=np.repeat(taught, sizes), minlength=len(words)).astype(np.int64)
            shard = shard_of(words, shards)
            first = np.flatnonzero(np.diff(shard, prepend=-1))
            known = np.array([i is not None for i in ids], bool)
            row = [pack(known, np.array([i or 0 for i in ids], np.int64), taught, sizes, place, np.searchsorted(words, at_end).reshape(1))]
            row += [pack(words[a:b], counts[a:b]) for a, b in zip(first, [*first[1:], len(words)])]
            k = len(row)
            return pa.RecordBatch.from_arrays([pa.array([False] + [True] * (k - 1)), pa.array([chunk] * k, pa.int64()), pa.array([0, *shard[first].tolist()], pa.int32()), pa.array(row, pa.binary())], ["words", "chunk", "shard", "data"])

        for batch in batches:
            column = batch.column(2)
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for i, taught, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                ids.append(i), flags.append(bool(taught)), lengths.append(b - a), held.append(flat[a:b])
                n += b - a
                if n >= TOKENS or len(ids) >= DOCUMENTS:
                    yield emit()
                    chunk, n = chunk + 1, 0
                    ids.clear(), flags.clear(), lengths.clear(), held.clear()
        if ids:
            yield emit()
        trim()

    return df.select(F.col(id).cast("long"), trained, tokens(F.col(text))).mapInArrow(run, _CHUNKS)


def numbered(words: DataFrame, shards: int) -> DataFrame:
    """For each chunk and shard the numbers and counts of its words; one row of each shard has its sums `n` and `different`."""

    def task(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [unpack(x) for x in group.column("data").to_pylist()]
        sizes = [len(p[0]) for p in parts]
        place = np.unique(np.concatenate([p[0].astype(np.uint64) for p in parts]), return_inverse=True)[1]
        counts = np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        number = np.where(counts > 0, count_class(counts) << _RANK | (rank * shards + shard), 0)
        rows = [pack(number[p], counts[p]) for p in np.split(place, np.cumsum(sizes)[:-1])]
        first = [0] * (len(rows) - 1)
        out = pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"), "data": pa.array(rows, pa.binary()), "n": pa.array([int(counts.sum()), *first], pa.int64()), "different": pa.array([int((counts > 0).sum()), *first], pa.int64())})
        trim()
        return out

    return words.groupBy("shard").applyInArrow(task, "chunk long, shard int, data binary, n long, different long")


def pairs(texts: DataFrame, numbers: DataFrame, shards: int, total: int, different: int, prior: float) -> DataFrame:
    """For each chunk its documents with what needs no trie (shard of the chunk), and its pairs for each pair shard."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        known, ids, taught, sizes, place, end = unpack(left.column("data")[0].as_py())
        chunk = left.column("chunk")[0].as_py()
        order = np.argsort(right.column("shard").to_numpy())
        both = [unpack(right.column("data")[int(i)].as_py()) for i in order]
        number, count = (np.concatenate([b[k] for b in both]).astype(np.int64) for k in (0, 1))
        place, sizes = place.astype(np.int64), sizes.astype(np.int64)
        begin = _cut(sizes)
        before = np.empty(len(place), np.int64)
        before[1:], before[begin] = place[:-1], end[0]
        base = np.log10((count + 1.0) / (total + different + 1.0))
        told = count_of(number)
        seen_v, seen_w = number[before] > 0, number[place] > 0
        alone = np.where(seen_v & seen_w, 0.0, base[place] + np.where(seen_v, np.log10(prior / (told[before] + prior)), 0.0))
        add = lambda x: np.add.reduceat(x, begin)
        rows = [(shard_of(mixed(np.array([chunk])), shards)[0], pack(known, ids, taught, sizes, add((count[place] > 0).astype(np.int64)), add(base[place]), add(alone)))]
        at = np.repeat(np.arange(len(sizes)), sizes)
        both_seen = seen_v & seen_w
        wide, deep = len(number).bit_length(), len(sizes).bit_length()
        key = np.sort((before[both_seen] << wide | place[both_seen]) << deep | at[both_seen])
        pair, at = key >> deep, key & ((1 << deep) - 1)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        v, w = number[pair[first] >> wide], number[pair[first] & ((1 << wide) - 1)]
        times = np.diff(first, append=len(pair))
        trained = np.add.reduceat(taught.astype(np.int64)[at], first) if len(first) else first
        shard = pair_shard(v, w, shards)
        by_shard = np.argsort(shard, kind="stable")
        # occurrences in the order of their pairs
        order = np.repeat(first[by_shard] - _cut(times[by_shard]), times[by_shard]) + np.arange(len(pair))
        at, v, w, times, trained, shard = at[order], v[by_shard], w[by_shard], times[by_shard], trained[by_shard], shard[by_shard]
        cut = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
        spent = np.concatenate([[0], np.cumsum(times)])
        for a, b in zip(cut[:-1], cut[1:]):
            new = np.flatnonzero(np.diff(v[a:b], prepend=-1))
            rows.append((shard[a], pack(v[a:b][new], np.diff(new, append=b - a), w[a:b], times[a:b], trained[a:b], at[spent[a] : spent[b]], np.array([len(sizes)]))))
        out = pa.table({"shard": pa.array([int(s) for s, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "texts": pa.array([k == 0 for k in range(len(rows))]), "data": pa.array([d for _, d in rows], pa.binary())})
        trim()
        return out

    return texts.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(task, "shard int, chunk long, texts boolean, data binary")


def built(v: np.ndarray, w: np.ndarray, counts: np.ndarray, total: int, different: int, prior: float) -> Trie:
    """The trie of the sorted pairs of numbers v, w with training counts above 0."""
    words = np.unique(np.concatenate([v, w]))
    ranks = np.stack([np.searchsorted(words, v), np.searchsorted(words, w)], axis=1)
    base = (count_of(w) + 1.0) / (total + different + 1.0)
    return mapped(Trie.arrays(words, [ranks], [np.log10((counts + prior * base) / (count_of(v) + prior))]), 2)


def looked_up(requests: DataFrame, total: int, different: int, prior: float) -> DataFrame:
    """For each chunk and shard of pairs the sums of log10 probabilities by document; rows of documents pass."""

    def task(group: pa.Table) -> pa.Table:
        texts = group.filter(group.column("texts"))
        asked = group.filter(pa.compute.invert(group.column("texts")))
        parts = [unpack(x) for x in asked.column("data").to_pylist()]
        sums: list[bytes] = []
        if parts:
            v = np.concatenate([np.repeat(p[0].astype(np.int64), p[1].astype(np.int64)) for p in parts])
            w = np.concatenate([p[2].astype(np.int64) for p in parts])
            trained = np.concatenate([p[4].astype(np.int64) for p in parts])
            order = np.lexsort((w, v))
            sv, sw = v[order], w[order]
            first = np.flatnonzero((np.diff(sv, prepend=-1) != 0) | (np.diff(sw, prepend=-1) != 0))
            counts = np.add.reduceat(trained[order], first)
            sv, sw, some = sv[first], sw[first], counts > 0
            trie = built(sv[some], sw[some], counts[some], total, different, prior)
            node = trie.find(np.stack([sv, sw], axis=1))
            log = np.log10(prior * (count_of(sw) + 1.0) / (total + different + 1.0) / (count_of(sv) + prior))
            log[node >= 0] = trie.logs(0, node[node >= 0])
            each = np.empty(len(v), np.float64)
            each[order] = np.repeat(log, np.diff(first, append=len(v)))
            begin = 0
            for p in parts:
                n = len(p[2])
                sums.append(pack(np.bincount(p[5].astype(np.int64), weights=np.repeat(each[begin : begin + n], p[3].astype(np.int64)), minlength=int(p[6][0]))))
                begin += n
        out = pa.table({"chunk": pa.concat_arrays([*texts.column("chunk").chunks, *asked.column("chunk").chunks]) if group.num_rows else pa.array([], pa.int64()), "texts": pa.array([True] * texts.num_rows + [False] * asked.num_rows, pa.bool_()), "data": pa.array(texts.column("data").to_pylist() + sums, pa.binary())})
        trim()
        return out

    return requests.groupBy("shard").applyInArrow(task, "chunk long, texts boolean, data binary")


def added(found: DataFrame, id: str, total: int) -> DataFrame:
    """A row for each document of each chunk, with its sums added up."""
    names = [id, "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def task(group: pa.Table) -> pa.Table:
        texts = group.column("texts").to_pylist().index(True)
        known, ids, taught, sizes, seen, base, score = unpack(group.column("data")[texts].as_py())
        for k, data in enumerate(group.column("data").to_pylist()):
            if k != texts:
                score = score + unpack(data)[0]
        n = len(ids)
        columns = [pa.array(ids.astype(np.int64), mask=~known.astype(bool)), pa.array(taught.astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)]
        return pa.table(dict(zip(names, columns)))

    return found.groupBy("chunk").applyInArrow(task, f"`{id}` long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(df: DataFrame, trained: Column, text: str = "text", id: str = "doc_id", prior: float = PRIOR) -> DataFrame:
    """id, trained, n_tokens, n_known, train_tokens, base_score and score of every row, learnt from the rows where `trained` is true."""
    spark = df.sparkSession
    size = df.select(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    word_shards, pair_shards = 1 + size // WORD_SHARD, 1 + size // PAIR_SHARD
    held, path = stored(chunks(df, F.coalesce(trained, F.lit(False)), word_shards, text, id), "chunks", by="words")
    numbers, _ = stored(numbered(held.where("words").select("chunk", "shard", "data"), word_shards), "numbers")
    total, different = (int(x or 0) for x in numbers.agg(F.sum("n"), F.sum("different")).first())
    discard(spark, f"{path}/words=true")
    asked = pairs(held.where("not words").select("chunk", "data"), numbers.select("chunk", "shard", "data"), pair_shards, total, different, prior)
    return added(looked_up(asked, total, different, prior), id, total)
