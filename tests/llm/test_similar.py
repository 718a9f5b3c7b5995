import random

import numpy as np

from docengine.llm import similar, simhash


def plain_shingles(text, width=5):
    w = (text or "").lower().split()
    k = min(width, max(1, len(w)))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain_classes(rows, least=0.8):
    """(id, text) rows -> the least id that links of `least` reach, by all pairs."""
    sets = [(i, plain_shingles(t)) for i, t in rows]
    label, changed = {i: i for i, _ in rows}, True
    alike = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1 :] if i == j or (len(a & b) / len(a | b) if a | b else 1.0) >= least]
    while changed:
        changed = False
        for i, j in alike:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def documents(n=140, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 4, 7])):
                w[r.randrange(len(w))] = f"changed{r.random()}"
            if r.random() < 0.3:
                w += [f"more{r.random()}"] * r.randrange(1, 20)
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(f"w{r.randrange(3000)}" for _ in range(r.choice([1, 3, 5, 6, 30, 120, 400])))))
    r.shuffle(out)
    return out


def test_by_brute_force(spark):
    docs = documents()
    got = {r["doc_id"]: r["component_id"] for r in similar.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected = plain_classes(docs)
    assert got == expected and 20 < len(set(expected.values())) < 120
    kept = {r["doc_id"] for r in similar.one_of_each_similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {i for i, c in expected.items() if i == c}


def test_small_groups_and_tiles_change_nothing(spark, monkeypatch):
    docs = documents(100, 8)
    monkeypatch.setattr(similar, "TILE", 8)
    monkeypatch.setattr(simhash, "MIN_GROUPS", 25)
    monkeypatch.setattr(similar, "SHARE", 3)
    monkeypatch.setattr(similar, "GROUP_SHINGLES", 3000)
    monkeypatch.setattr(similar, "COLUMNS", 50)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_classes(docs)


def test_hot_groups(spark):
    """Many exact copies and many near copies of one text whose copies are less alike than their original."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 700):
        w = list(base)
        for at in r.sample(range(200), 4):
            w[at] = f"x{i}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(f"own{i}n{j}" for j in range(50))) for i in range(30)]
    left = similar.one_of_each_similar(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in left.collect()) == [0, *range(1000, 1030)]


def test_fingerprints_differ_as_texts_do():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:800], r.integers(0, 2**63, 100, dtype=np.uint64)]))
    x, y = similar.simhash128(a), similar.simhash128(b)
    assert similar.similarity(a, b) == 800 / 1000 and np.bitwise_count(x ^ y).sum() <= similar.RADIUS
    assert similar.simhash128(np.zeros(0, np.uint64)).tolist() == [0, 0] and similar.similarity(a[:0], a[:0]) == 1.0


def test_edges_of_input(spark):
    long = "word " * 30_000 + "end"
    rows = [(7, None, "a", 1), (5, "", "a", 1), (9, " \n", "a", 1), (None, "x y z", "a", 1), (None, "x y z", "a", 1), (3, "one two three four five", "a", 1), (3, "one two three four five", "b", 2), (3, "other text", "b", 3), (8, long, "b", 2), (4, "One two\nthree four five", "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `key` string, `Row` int").withColumnsRenamed({"doc_id": "doc_id"})
    kept = similar.one_of_each_similar(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, ""), (None, "x y z"), (None, "x y z"), (3, "one two three four five"), (3, "other text"), (8, long)], key=str)
    assert similar.one_of_each_similar(df.limit(0)).count() == 0 and similar.similar(df.limit(0)).count() == 0
    found = sorted(((r["doc_id"], r["component_id"]) for r in similar.similar(df).collect()), key=str)
    assert found == sorted([(7, 5), (5, 5), (9, 5), (None, None), (None, None), (3, 3), (3, 3), (3, 3), (8, 8), (4, 3)], key=str)


def test_many_texts_below_the_similarity(spark):
    """A crowd of texts that are candidates of one another without being alike, and pairs among them that are."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(160):
        w = list(base)
        for at in r.sample(range(150), 6):
            w[at] = f"x{i}y{at}"
        docs.append((i, " ".join(w)))
        if i % 10 == 0:
            w[r.randrange(150)] = "edited"
            docs.append((1000 + i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in similar.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected = plain_classes(docs)
    assert got == expected and 100 < len(set(expected.values())) < 176
