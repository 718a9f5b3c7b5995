import random

import numpy as np

from docengine.llm import decontaminate as D


def brute(items, words):
    """item -> (similarity, -first) over all windows of one text."""
    out = {}
    for n, w in enumerate(items.words):
        size = min(len(w), len(words))
        if size:
            value, first = max((items.verified(tuple(words[i : i + size]), n), -i) for i in range(len(words) - size + 1))
            if value >= items.similarity:
                out[items.ids[n]] = (value, -first)
    return out


def corpus():
    r = random.Random(4)
    word = lambda: f"w{r.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(r.choice([2, 4, 5, 9, 20, 30, 45])))) for i in range(25)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(0, 3)):
            part = r.choice(items)[1].split()
            if r.random() < 0.5:
                part[r.randrange(len(part))] = "Edited"
            at = r.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, ", ".join(body).title()))
    return items, docs


def test_by_brute_force(spark):
    items, docs = corpus()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in D.contaminated(d, b).collect()}
    table = D.Items([i for i, _ in items], [t for _, t in items])
    expected = {(i, item): v for i, t in docs for item, v in brute(table, D._words(t.lower())).items()}
    assert got == expected and len(got) > 20
    left = {r["doc_id"] for r in D.clean(d, b).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in expected}


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(2)
    items = D.Items(list(range(50)), [" ".join(f"x{r.integers(0, 1000)}" for _ in range(12)) for _ in range(50)])
    table = items.prints[12]
    probes = table[r.integers(0, 50, 200)].copy()
    for p in probes:
        for bit in r.choice(128, r.integers(0, 60), replace=False):
            p[bit // 16] ^= np.uint16(1 << (bit % 16))
    found = set(items.candidates(probes, 12))
    near = {(w, items.by_length[12][i]) for w, i in zip(*np.nonzero(np.bitwise_count(probes[:, None] ^ table[None]).sum(axis=2) <= D.RADIUS))}
    assert found == near


def test_edges_of_input(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    b = spark.createDataFrame([(1, passage), (2, None), (3, ""), (1, passage)], "item_id long, text string")
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, passage, 0), (3, passage, 0), (None, f"x {passage}. y", 0), (4, "z " * 60_000 + passage, 0), (5, "clean text", 0)], "doc_id long, text string, item_id int")
    got = sorted(((r["doc_id"], r["similarity"]) for r in D.contaminated(d, b).where("item_id = 1").dropDuplicates(["doc_id", "first_word"]).collect()), key=str)
    assert got == sorted([(3, 1.0), (None, 1.0), (4, 1.0)], key=str)
    kept = D.clean(d, b)
    assert kept.columns == d.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 5]
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0


def test_repeated_items_weigh_as_one():
    words = [f"word{i}" for i in range(100)]
    items = D.Items(list(range(5)), [" ".join(words)] * 5)
    found = D.scan_batch(items, [" ".join("changed" if i == 50 else w for i, w in enumerate(words))])[0]
    assert {n: round(v[0], 6) for n, v in found.items()} == {n: round(91 / 101, 6) for n in range(5)}
    # A word changed in what most items have in common does not outweigh the rest.
    common = words[:50]
    items = D.Items(list(range(20)), [" ".join(common + [f"own{n}x{i}" for i in range(5)]) for n in range(20)])
    copy = ["changed" if i == 20 else w for i, w in enumerate(items.words[3])]
    assert items.verified(tuple(copy), 3) > 0.8


def test_parts_change_nothing(spark, monkeypatch):
    items, docs = corpus()
    items = items[:12] + items[:3] + [(100 + n, f"{items[9][1]} {items[10][1]} tail{n}") for n in range(3)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(tuple, D.contaminated(d, b).collect()))
    monkeypatch.setattr(D, "PART_ITEMS", 6)
    assert [x[:2] + (round(x[2], 9),) + x[3:] for x in map(tuple, one)] == [x[:2] + (round(x[2], 9),) + x[3:] for x in sorted(map(tuple, D.contaminated(d, b).collect()))]
    assert len(one) > 10
