"""Elias-Fano n-gram trie: monotone sequences in two bit arrays, levels in one memory-mapped file (operator 11).

A sequence of n whole numbers below u that never falls keeps the low log2(u / n) bits of each number packed, and the
high bits as a bit array: as many zeros as the high part grew, then a one for each number. Successor search goes
to the numbers of one high part by selecting zeros, then halves over their low bits.

The trie's first level is the sequence of its words. Each further level holds the last words of the n-grams of one
order, as ranks in the first level, sorted by their prefixes; to be one monotone sequence, the ranks of each group of siblings are raised
by the last number of the group before. Pointers from the nodes of a level to their children are monotone too. A child
is looked up by successor search for its rank raised by what stands before its group, within the group. Each
level holds a quantised log10 probability for each node.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: Quantisation of log10 probabilities: 16 bits, steps of 1 / STEPS.
STEPS = 2048
#: Sequences that are selected from at a time.
PIECE = 1 << 16
#: Place of the k-th one in each byte (8 if there is none).
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs * STEPS), 0, 65535).astype(np.uint16)


def dequantised(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -STEPS


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """values, `width` bits each, low bits first, with room to read eight bytes at any place."""
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    step = 8 * max(1, PIECE // 8)
    for at in range(0, len(values) if width else 0, step):
        piece = values[at : at + step].astype(np.uint64)
        bits = ((piece[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        part = np.packbits(bits.ravel(), bitorder="little")
        out[at * width // 8 : at * width // 8 + len(part)] = part
    return out


def read_bits(packed: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The values at `places` of what packed_bits made."""
    if not width:
        return np.zeros(len(places), np.int64)
    first = places * width
    words = np.ndarray((len(packed) - 7,), "<u8", packed, strides=(1,))  # eight bytes from every byte on
    return ((words[first >> 3] >> (first & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


class Monotone:
    """A sequence of whole numbers (0 to 2^62) that never falls."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.top, self.width = (int(x) for x in parts["head"])
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        """What the sequence is kept as: low bits, high bits, and for each word of the latter the ones before it."""
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        place = (values >> width) + np.arange(n)
        high = np.zeros(((top >> width) + n) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        return {"head": np.array([n, top, width], np.int64), "low": packed_bits(values & ((1 << width) - 1), width), "high": high, "ones": ones}

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places of the k-th (from 0) zeros or ones of the high bits."""
        before = self.zeros if zeros else self.ones
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), PIECE):
            q = k[at : at + PIECE]
            word = np.searchsorted(before, q, side="right") - 1
            held, left = self.high[word], (q - before[word]).astype(np.uint8)
            eight = (~held if zeros else held).astype("<u8").view(np.uint8).reshape(-1, 8)
            upto = np.cumsum(np.bitwise_count(eight), axis=1, dtype=np.uint8)
            byte = np.argmax(upto > left[:, None], axis=1)
            row = np.arange(len(q))
            left -= upto[row, byte] - np.bitwise_count(eight[row, byte])
            out[at : at + PIECE] = word * 64 + byte * 8 + _IN_BYTE[eight[row, byte], left]
        return out

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        return (self._select(places, False) - places << self.width) | read_bits(self.low, places, self.width)

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each target the place of the first number that is not less (n if there is none), and whether it is equal."""
        inside = targets <= self.top
        t = np.where(inside, targets, 0)
        part, low = t >> self.width, t & ((1 << self.width) - 1)
        begin = np.where(part > 0, self._select(np.maximum(part - 1, 0), True) - part + 1, 0) if self.n else np.zeros(len(t), np.int64)
        end = np.minimum(self._select(part, True) - part, self.n) if self.n else begin
        a, b = begin.copy(), end.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            less = read_bits(self.low, middle, self.width) < low[open_]
            a[open_[less]], b[open_[~less]] = middle[less] + 1, middle[~less]
        at = np.where(inside & (self.n > 0), a, self.n)
        equal = inside & (a < end)
        equal[equal] = read_bits(self.low, a[equal], self.width) == low[equal]
        return at, equal


class Trie:
    """A trie over memory-mapped levels. `levels[k]`: (pointers, children, codes) of the n-grams of k + 2 words."""

    def __init__(self, arrays: dict[str, np.ndarray], order: int):
        self.order = order
        sequence = lambda name: Monotone({k: arrays[f"{name}.{k}"] for k in ("head", "low", "high", "ones")})
        self.words = sequence("words")
        self.levels = [(sequence(f"pointers{k}"), sequence(f"children{k}"), arrays[f"codes{k}"]) for k in range(order - 1)]

    @staticmethod
    def arrays(words: np.ndarray, grams: list[np.ndarray], logs: list[np.ndarray]) -> dict[str, np.ndarray]:
        """The arrays of a trie. words: sorted ids. grams: for each order from 2 the n-grams as rows of ranks in words, sorted,
        each with its prefix among those one word shorter; logs: their log10 probabilities."""
        out = {f"words.{k}": v for k, v in Monotone.parts(words).items()}
        nodes, before = len(words), None
        for level, (rows, log) in enumerate(zip(grams, logs)):
            if before is None:
                parent = rows[:, 0]
            else:
                new = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
                parent = found_rows(before, rows[new][:, :-1])[np.cumsum(new) - 1] if len(rows) else np.zeros(0, np.int64)
            pointers = np.searchsorted(parent, np.arange(nodes + 1))
            rank = rows[:, -1].astype(np.int64) + 1
            some = pointers[:-1] < pointers[1:]
            last = rank[pointers[1:][some] - 1]
            raised = np.cumsum(last) - last
            children = rank + np.repeat(raised, np.diff(pointers)[some])
            out |= {f"pointers{level}.{k}": v for k, v in Monotone.parts(pointers).items()} | {f"children{level}.{k}": v for k, v in Monotone.parts(children).items()} | {f"codes{level}": quantised(log)}
            nodes, before = len(rows), rows
        return out

    def child(self, level: int, nodes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The node of each (node of the level above, rank of a word) or -1."""
        pointers, children, _ = self.levels[level]
        if not children.n:
            return np.full(len(nodes), -1, np.int64)
        first, end = pointers[nodes], pointers[nodes + 1]
        before = np.where(first > 0, children[np.maximum(first - 1, 0)], 0)
        at, equal = children.successor(before + ranks + 1)
        return np.where(equal & (at >= first) & (at < end), at, -1)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The node of each row of word ids in its level, or -1."""
        different, place = np.unique(grams, return_inverse=True)
        ranks, known = (x[place].reshape(grams.shape) for x in self.words.successor(different))
        known = known.all(axis=1)
        node = np.full(len(grams), -1, np.int64)
        alive = np.flatnonzero(known)
        at = ranks[alive, 0]
        for k in range(1, grams.shape[1]):
            at = self.child(k - 1, at, ranks[alive, k])
            alive, at = alive[at >= 0], at[at >= 0]
        node[alive] = at
        return node

    def logs(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return dequantised(self.levels[level][2][nodes])


def found_rows(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of `rows` in the sorted rows of `table`, where all of them are."""
    as_keys = lambda x: np.ascontiguousarray(x.astype(">i8")).view(f"S{8 * x.shape[1]}").ravel()
    return np.searchsorted(as_keys(table), as_keys(rows))


def mapped(arrays: dict[str, np.ndarray], order: int) -> Trie:
    """The trie with all its arrays in one file, mapped to memory; the file's name is gone, its pages go with the trie."""
    places, size = {}, 0
    with tempfile.TemporaryFile(prefix="trie-") as file:
        for name, x in arrays.items():
            size += file.write(b"\0" * (-size % 8))
            places[name] = (size, x.dtype, len(x))
            size += file.write(np.ascontiguousarray(x).tobytes())
        file.flush()
        held = mmap.mmap(file.fileno(), max(1, size), access=mmap.ACCESS_READ)
    return Trie({name: np.frombuffer(held, dtype, n, at) for name, (at, dtype, n) in places.items()}, order)
