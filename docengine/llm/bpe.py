"""Byte-level BPE encoding and decoding (operator 1).

Encoding keeps the pairs that can merge in a priority queue made of two levels of bitmaps over the
merge ranks. A set bit says that the bucket of that rank holds positions of a linked list of symbols;
find-first-set on the upper level and then on one lower word gives the least rank in constant time.
Entries whose pair has changed meanwhile are recognised by the rank stored at the position and skipped.
The distinct new pre-tokens of a slice of texts share one queue, so a bucket merges all its positions in
a few array operations; `Encoder.merge` is the same queue over a single pre-token.
A pre-token of n bytes costs O(n log n) at worst (the heap inside one bucket), so one word of a
megabyte is as safe as many short ones.

Rows: a null text counts as empty (no ids); repeated rows and null ids are kept as they are; other
columns of the input are not carried over. Ids are packed as little-endian unsigned 32-bit integers.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import SLICE_BYTES, map_slices

#: Bits of one word of the lower bitmap level.
WORD = 256
#: Encoded pre-tokens that a Python worker remembers, and the longest that it does.
MEMO_ENTRIES, MEMO_CHARS = 150_000, 48


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a .tiktoken file: base64 of the token's bytes, a space, the rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


class Encoder:
    """Encodes pre-tokens by a table of ranks. The queue is empty between calls and is used again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.words = [0] * (max(ranks.values(), default=0) // WORD + 1)
        self.pairs = Pairs(ranks)
        #: An id that no pair has; it stands between pre-tokens.
        self.barrier = max(ranks.values(), default=0) + 1
        self.bytes_as_ids = np.array([ranks.get(bytes([b]), self.barrier) for b in range(256)], np.int32)
        self.missing = frozenset(b for b in range(256) if bytes([b]) not in ranks)
        self.memo: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: again and again the pair of the least rank merges, leftmost first."""
        ranks, words = self.ranks, self.words
        rank_of = ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        upper = 0
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)  # in order of position, so it is a heap already
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= 1 << (r & 255)
                    upper |= 1 << (r >> 8)
        while upper:
            w = (upper & -upper).bit_length() - 1
            word = words[w]
            r = (w << 8) | ((word & -word).bit_length() - 1)
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                word &= word - 1
                words[w] = word
                if not word:
                    upper &= upper - 1
            if pair[i] != r:
                continue  # stale: a neighbour has merged since
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = -1
            if k < n:
                before[k] = i
                new = rank_of(piece[i : after[k]], -1)
                pair[i] = new
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        words[new >> 8] |= 1 << (new & 255)
                        upper |= 1 << (new >> 8)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                new = rank_of(piece[p:k], -1)
                pair[p] = new
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], p)
                    else:
                        buckets[new] = [p]
                        words[new >> 8] |= 1 << (new & 255)
                        upper |= 1 << (new >> 8)
        ids, i = [], 0
        while i < n:
            k = after[i]
            ids.append(ranks[piece[i:k]])
            i = k
        return ids

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pre-tokens, merged together: one linked list with a barrier after each
        pre-token, one queue. A popped bucket merges all its positions of this rank at once; where two of
        them overlap, the left one goes first. Should a merge make a pair of no greater rank (a table that
        no training gave), its pre-token is done again alone."""
        table, barrier = self.pairs, self.barrier
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1)  # of each pre-token: the barrier's position is one less, after an opening barrier
        n = int(ends[-1]) + 1
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        tok = self.bytes_as_ids[raw]
        tok[0] = barrier
        tok[ends] = barrier
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        pair = np.full(n, -1, np.int32)
        pair[:-1] = table.ranks_of(tok[:-1], tok[1:])
        words, upper, buckets, again = self.words, 0, {}, set()

        def push(positions: np.ndarray, ranks: np.ndarray) -> int:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            top = 0
            for a, b in zip(cuts, cuts[1:]):
                r = int(ranks[a])
                if r in buckets:
                    buckets[r].append(positions[a:b])
                else:
                    buckets[r] = [positions[a:b]]
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
            return top

        first = np.flatnonzero(pair >= 0).astype(np.int32)
        if len(first):
            upper = push(first, pair[first])
        while upper:
            w = (upper & -upper).bit_length() - 1
            word = words[w]
            r = (w << 8) | ((word & -word).bit_length() - 1)
            word &= word - 1
            words[w] = word
            if not word:
                upper &= upper - 1
            held = buckets.pop(r)
            p = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            p = p[pair[p] == r]  # the others are stale
            if not len(p):
                continue
            j = after[p]
            if len(p) > 1:
                overlaps = np.flatnonzero(j[:-1] == p[1:]) + 1
                if len(overlaps):
                    index = np.arange(len(p))
                    start = index.copy()
                    start[overlaps] = 0
                    keep = (index - np.maximum.accumulate(start)) % 2 == 0
                    p, j = p[keep], j[keep]
            k = after[j]
            after[p] = k
            before[k] = p
            pair[j] = -1
            tok[j] = -1
            tok[p] = r
            q = before[p]
            changed = np.concatenate([p, q])
            new = table.ranks_of(tok[changed], np.concatenate([tok[k], tok[p]]))
            pair[changed] = new
            live = new >= 0
            if live.any():
                changed, new = changed[live], new[live]
                if int(new.min()) <= r:
                    again.update(np.searchsorted(ends, changed[new <= r]).tolist())
                upper |= push(changed, new)
        alive = (tok >= 0) & (tok != barrier)
        count = np.cumsum(alive)[ends].tolist()
        packed = tok[alive].astype("<u4").tobytes()
        out = [packed[4 * a : 4 * b] for a, b in zip([0, *count], count)]
        for x in again:
            out[x] = np.array(self.merge(pieces[x]), "<u4").tobytes()
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        memo = self.memo
        pieces = [self.split(t) for t in texts]
        if new := list(set().union(*pieces).difference(memo)):
            encoded = [x.encode("utf-8", "surrogatepass") for x in new]
            if self.missing and any(not self.missing.isdisjoint(x) for x in encoded):
                raise ValueError("the vocabulary has no token for a byte of the text")
            memo.update(zip(new, self.merge_many(encoded)))
        out = [b"".join(map(memo.__getitem__, x)) for x in pieces]
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for x in new:
            if len(x) > MEMO_CHARS:
                memo.pop(x, None)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], "<u4").tolist()


class Pairs:
    """Ranks of pairs of ids: every split of a token into two tokens, by a sorted key."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int32)[order], -1).astype(np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1).astype(np.int32)


def decode_ids(ids: Iterable[int], tokens: list[bytes | None]) -> bytes:
    """Bytes of the ids; an id without a token is an error."""
    return b"".join(map(tokens.__getitem__, ids))


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


_LOADED: dict[tuple[int, str], tuple[Encoder, list[bytes | None]]] = {}


def _loaded(content: bytes, pattern: str) -> tuple[Encoder, list[bytes | None]]:
    """One encoder for each Python worker, kept between tasks."""
    key = (hash(content), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        ranks = parse_ranks(content)
        _LOADED[key] = Encoder(ranks, pattern), token_table(ranks)
    return _LOADED[key]


def _forget() -> None:
    """Let the remembered pre-tokens go; the tables of the vocabulary stay."""
    for encoder, _ in _LOADED.values():
        encoder.memo.clear()


def _vocabulary(df: DataFrame, path: str):
    """The rank file (its size is fixed by the vocabulary), read on the driver and broadcast."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens long, ids binary (packed) of every whole text; a null text has no ids."""
    content = _vocabulary(df, vocabulary)

    def make() -> Callable:
        encoder, _ = _loaded(content.value, pattern)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.packed([t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

        return apply

    rows = df.select(F.col(id).alias("key"), F.col(text).alias("body"))
    return map_slices(rows, make, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids binary", "body", SLICE_BYTES, _forget).withColumnRenamed("key", id)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`: the bytes that the packed ids stand for. Null ids count as none; an unknown id fails the query."""
    content = _vocabulary(df, vocabulary)
    rows = df.drop(out)
    at = rows.columns.index(ids)

    def make() -> Callable:
        _, tokens = _loaded(content.value, "")

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [decode_ids(np.frombuffer(x or b"", "<u4").tolist(), tokens) for x in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

        return apply

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` binary"
    return map_slices(rows, make, schema, ids)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """`encode` and then `decode` in one pass: id, n_tokens long, ids binary, decoded binary."""
    content = _vocabulary(df, vocabulary)

    def make() -> Callable:
        encoder, tokens = _loaded(content.value, pattern)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.packed([t or "" for t in batch.column(1).to_pylist()])
            back = [decode_ids(np.frombuffer(x, "<u4").tolist(), tokens) for x in ids]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids", "decoded"])

        return apply

    rows = df.select(F.col(id).alias("key"), F.col(text).alias("body"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary"
    return map_slices(rows, make, schema, "body", SLICE_BYTES, _forget).withColumnRenamed("key", id)
