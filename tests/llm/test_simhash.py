import random
import re

import numpy as np
import xxhash

from docengine.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(rows, radius=4):
    """(id, fingerprint) rows -> component by id."""
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if (i == j or bin(a ^ b).count("1") <= radius) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def documents(n=120, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out)[1].split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "Changed"
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(r.choice(words) for _ in range(r.randrange(1, 90)))))
    return out


def test_fingerprint():
    for text in ["", " \t\n", "one", "One two THREE", "a b c d", "a b c d e", "É é ÉÉ\x85x\xa0y z w", *(t for _, t in documents(30))]:
        assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == plain_fingerprint(text), text


def test_pairs_are_exact():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 700, dtype=np.uint64)
    near = a[:300] ^ (np.uint64(1) << r.integers(0, 63, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 300).astype(np.uint64))
    every = np.concatenate([a, near])
    found = {(min(p, q), max(p, q)) for x, y in simhash.linked_pairs(every, None, 4) for p, q in zip(x.tolist(), y.tolist()) if p != q}
    d = np.bitwise_count(every[:, None] ^ every[None])
    assert found == {(p, q) for p, q in zip(*np.nonzero(d <= 4)) if p < q}
    cross = {(p, q) for x, y in simhash.linked_pairs(a, near, 4) for p, q in zip(x.tolist(), y.tolist())}
    assert cross == set(zip(*np.nonzero(np.bitwise_count(a[:, None] ^ near[None]) <= 4)))


def test_components_by_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t in docs])


def test_chain_and_hot_group(spark):
    """A chain of single bits that only many steps connect, and one fingerprint of many rows."""
    value, chain = 0, []
    for step in range(60):
        chain.append(value)
        value ^= 1 << (step % 61) if step % 2 else 0b1111 << (step % 50)
    nodes = spark.createDataFrame([(i + 5, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(dict.fromkeys(chain))], "node long, bits long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes)).collect()}
    rows = [(i + 5, v) for i, v in enumerate(dict.fromkeys(chain))]
    expected = {k: v for k, v in plain_components(rows).items()}
    assert all(found.get(k, k) == v for k, v in expected.items())
    hot = spark.range(3000).selectExpr("id doc_id", "'the very same text of some words' text")
    assert simhash.near_duplicates(hot).groupBy("component_id").count().collect() == [(0, 3000)]
    assert [r["doc_id"] for r in simhash.one_of_each(hot).collect()] == [0]


def test_edges_of_input(spark):
    rows = [(7, None, "a", 1), (5, "", "a", 1), (9, " \n", "a", 1), (None, "x y z", "a", 1), (3, "one two three four five", "a", 1), (3, "one two three four five", "a", 1), (8, "word " * 30_000, "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits string, component_id int")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(7, 5), (5, 5), (9, 5), (None, None), (3, 3), (3, 3), (8, 8)], key=str)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 5, 8, None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
