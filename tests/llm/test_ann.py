import numpy as np

from docengine.llm import ann


def vectors(n, seed=0, dim=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    return (centres[r.integers(0, 8, n)] + 0.6 * r.normal(size=(n, dim))).astype(np.float32)


def test_cells_come_in_order():
    x = vectors(600).astype(float)
    index = ann.Index(x, len(x), 5)
    counts = np.ones(len(index.first) * len(index.second), np.int64)
    for q in x[:20]:
        seen = index.visit(q, counts, 10**9).tolist()
        score = (index.first @ q[: index.half])[:, None] + (index.second @ q[index.half :])[None]
        assert sorted(seen) == list(range(len(counts)))
        assert (np.diff(score.ravel()[seen]) <= 1e-9).all()


def test_recall_and_scores(spark):
    x = vectors(3000)
    x[100:400] = x[100]  # a hot vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, k=10, every=50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d, hits = x.astype(float), 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        s = (d * d[q]).sum(axis=1)
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in rows) and all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(rows, rows[1:]))
        s[q] = -np.inf
        hits += len({v for _, v, _ in rows} & set(np.lexsort((np.arange(3000), -s))[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_edges_of_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (40, None), (7, [None, 1.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, k=20).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 20, 0.5), (20, 1, 6, 1.0), (20, 2, 0, 0.5)]
    assert ann.search(df.limit(0)).count() == 0


def test_only_visited_cells_are_scored():
    """Clustered vectors: high recall at less than a tenth of the pairs; entries of cells not visited never return."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 32))
    x = centres[r.integers(0, 60, 6000)] + 0.4 * r.normal(size=(6000, 32))
    index = ann.Index(x, len(x), 10)
    cell, ids, asked = index.cells(x), np.arange(6000), np.arange(0, 6000, 40)
    counts = np.bincount(cell, minlength=len(index.first) * len(index.second))
    wanted = max(11, int(np.ceil(index.share * len(x))))
    visited = [np.array(list(index.visit(x[q], counts, wanted))) for q in asked]
    q, e, s, scored = ann.top_of_bin(x, ids, cell, x[asked], asked, visited, 10)
    assert scored == sum(counts[v].sum() for v in visited) < 0.1 * len(asked) * len(x)
    hits = 0
    for a, v in zip(asked, visited):
        true = x @ x[a]
        true[a] = -np.inf
        best = np.lexsort((ids, -true))
        among = [i for i in best.tolist() if cell[i] in set(v.tolist()) and i != a][:10]
        assert e[q == a].tolist() == among
        hits += len(set(best[:10].tolist()) & set(among))
    assert hits / (10 * len(asked)) >= 0.9


def test_stray_lengths_and_hot_bins(spark, monkeypatch):
    monkeypatch.setattr(ann.Index, "calibrated", lambda *_: 1.0)  # every cell is visited
    x = vectors(400, 4)
    x[50:250] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0] * 40), (1001, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected = sorted(map(tuple, ann.search(df, k=5, every=10).collect()))
    assert {r[0] for r in expected} == set(range(0, 400, 10))
    for name, value in (("QUERY_ROWS", 3), ("BIN_ROWS", 40), ("WAITING", 10)):
        monkeypatch.setattr(ann, name, value)
    assert sorted(map(tuple, ann.search(df, k=5, every=10).collect())) == expected
    d = x.astype(float)
    for q in range(0, 400, 10):
        s = (d * d[q]).sum(axis=1)
        s[q] = -np.inf
        assert [r[2] for r in expected if r[0] == q] == np.lexsort((np.arange(400), -s))[:5].tolist()
