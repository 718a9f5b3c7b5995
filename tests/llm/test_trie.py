import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docengine.llm.trie import STEPS, Monotone, Trie, dequantised, mapped, packed_bits, quantised, read_bits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 56), max_size=300), st.lists(st.integers(0, 1 << 56), max_size=50))
def test_sequence_access_and_successor(values, targets):
    x = np.array(sorted(values), np.int64)
    s = Monotone(Monotone.parts(x))
    assert s[np.arange(len(x))].tolist() == x.tolist()
    targets = np.array(targets + values + [v + 1 for v in values], np.int64)
    at, equal = s.successor(targets)
    assert at.tolist() == np.searchsorted(x, targets).tolist()
    assert equal.tolist() == [t in set(values) for t in targets.tolist()]


def test_sequence_of_equal_and_dense_numbers():
    for x in ([], [0], [0, 0, 0], [5] * 1000, list(range(1000)), [0] * 500 + [1 << 40] * 500):
        x = np.array(x, np.int64)
        s = Monotone(Monotone.parts(x))
        assert s[np.arange(len(x))].tolist() == x.tolist()
        targets = np.array([0, 1, 5, 6, 999, 1 << 40, (1 << 40) + 1], np.int64)
        assert s.successor(targets)[0].tolist() == np.searchsorted(x, targets).tolist()


def test_packed_bits_of_every_width():
    r = np.random.default_rng(1)
    for width in range(0, 57):
        x = r.integers(0, 1 << width, 200_000 if width == 17 else 1000)
        assert read_bits(packed_bits(x, width), np.arange(len(x)), width).tolist() == x.tolist()


def test_quantised_within_half_a_step():
    logs = -np.random.default_rng(2).random(1000) * 12
    assert np.abs(dequantised(quantised(logs)) - logs).max() <= 0.5 / STEPS + 1e-12


def test_trie_of_three_words_equals_a_dictionary():
    r = random.Random(3)
    text = [r.choice([7, 9, 100, 2000, 30_000, 1 << 50]) for _ in range(400)]
    words = np.array(sorted(set(text)), np.int64)
    rank = {w: i for i, w in enumerate(words.tolist())}
    grams = [sorted({tuple(text[i : i + n]) for i in range(len(text) - n + 1)}) for n in (2, 3)]
    # every third of three words goes: nodes without children stay
    grams[1] = grams[1][::3]
    rows = [np.array([[rank[w] for w in g] for g in level]) for level in grams]
    logs = [-np.arange(len(level)) / 64 for level in grams]
    trie = mapped(Trie.arrays(words, rows, logs), 3)
    for level, known in enumerate(grams):
        asked = [tuple(r.choice([7, 9, 100, 2000, 30_000, 1 << 50, 8, 0]) for _ in range(level + 2)) for _ in range(500)] + known
        node = trie.find(np.array(asked, np.int64))
        assert node.tolist() == [known.index(g) if g in known else -1 for g in asked]
        found = np.flatnonzero(node >= 0)
        assert np.allclose(trie.logs(level, node[found]), [logs[level][known.index(asked[i])] for i in found], atol=1 / STEPS)


def test_empty_trie():
    trie = mapped(Trie.arrays(np.zeros(0, np.int64), [np.zeros((0, 2), np.int64)], [np.zeros(0)]), 2)
    assert trie.find(np.array([[1, 2]])).tolist() == [-1]
