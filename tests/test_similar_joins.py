import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.operators import bands, relational, setjoin

SETS = "group string, id long, tokens array<string>"


def random_sets(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and r.random() < 0.4:
            t = [x for x in r.choice(rows)[2] if r.random() < 0.85] + [f"t{r.randrange(40)}" for _ in range(r.randrange(3))]
        else:
            t = [f"t{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(0, 14))]
        rows.append((r.choice(["g", "h"]), k, sorted(set(t))))
    return rows + [(None, 500, ["t1"]), ("g", 501, [])]


def jaccard(x, y):
    return round(len(set(x) & set(y)) / len(set(x) | set(y)), 6) if set(x) | set(y) else 0.0


@pytest.mark.parametrize("least", [0.22, 0.5, 0.8, 1.0])
def test_set_join_equals_all_pairs(spark, least):
    a, b = random_sets(90, 1), random_sets(80, 2)
    left, right = spark.createDataFrame(a, SETS), spark.createDataFrame(b, SETS)
    want = sorted((g, i, j, jaccard(x, y)) for g, i, x in a for h, j, y in b if g is not None and g == h and jaccard(x, y) >= least)
    assert sorted(map(tuple, setjoin.similar(left, right, least).collect())) == want
    best = {}
    for g, i, j, s in want:
        best[g, i] = min(best.get((g, i), (0, 0)), (-s, j))
    assert sorted(map(tuple, setjoin.best(left, right, least).collect())) == sorted((g, i, j, -s) for (g, i), (s, j) in best.items())
    own = sorted((g, i, j, jaccard(x, y)) for g, i, x in a for h, j, y in a if g is not None and g == h and i != j and jaccard(x, y) >= least)
    assert sorted(map(tuple, setjoin.similar(left, left, least, apart=True).collect())) == own


def test_few_candidates_at_a_high_similarity(spark):
    rows = random_sets(150, 3)
    df = spark.createDataFrame(rows, SETS)
    every = sum(1 for g, i, _ in rows for h, j, _ in rows if g is not None and g == h and i != j)
    few, some = setjoin.candidates(df, df, 0.8, apart=True).count(), setjoin.candidates(df, df, 0.22, apart=True).count()
    assert few < 0.12 * every and few <= some <= every


def vectors(n, seed, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = r.standard_normal(dim) if not rows or r.random() < 0.5 else np.array(rows[r.integers(len(rows))][1]) + r.standard_normal(dim) * 0.1
        rows.append((k, [float(x) for x in base]))
    return rows + [(900, rows[3][1]), (901, rows[3][1]), (902, None), (903, [0.0] * dim), (904, [float("nan")] * dim), (905, [1.0, 2.0])]


def close(rows, limit, dim=16):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and len(v) == dim and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    return sorted((i, j) for i in unit for j in unit if i < j and round(float(unit[i] @ unit[j]), 6) >= limit)


@pytest.mark.parametrize("limit", [0.9, 0.97, 0.999])
def test_bands_find_every_close_pair(spark, limit):
    rows = vectors(250, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs = bands.close_pairs(df, limit)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == close(rows, limit)
    stays = []
    near = set(close(rows, limit))
    for i in sorted(i for i, _ in rows):
        if not any((j, i) in near for j in stays):
            stays.append(i)
    assert sorted(r["vec_id"] for r in bands.keep_first(df, pairs).collect()) == stays


def test_bands_of_no_rows_and_their_number(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert bands.close_pairs(df, 0.9).collect() == []
    assert [r["vec_id"] for r in bands.keep_first(df, bands.close_pairs(df, 0.9)).collect()] == [1]
    for limit in (0.5, 0.9, 0.99):
        same = (1 - np.arccos(limit) / np.pi) ** 8
        assert (1 - same) ** bands.number_of_bands(limit, 8, 1e-4) <= 1e-4
    assert bands.number_of_bands(1.0) == 1


def test_names_in_long_names(spark):
    r = random.Random(2)
    short = ["", "ab", "aba", "b", "中文", "x" * 30] + ["".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    long = ["", None, "ab", "x" * 20_000, "中文字"] + ["".join(r.choice("abcd") for _ in range(r.randrange(0, 30))) for _ in range(100)]
    a, b = spark.createDataFrame([(x,) for x in [*short, None]], "name string"), spark.createDataFrame([(x,) for x in long], "name string").distinct()
    want = sorted({(s, x) for s in short for x in long if s and x and s in x})
    for most in (1 << 20, 20):
        assert sorted(map(tuple, relational.contained(a, b, most).select("short", "long").collect())) == want


def test_long_names_in_linear_time(spark):
    a = spark.createDataFrame([(f"{'ab' * k}c{k}",) for k in range(500)], "name string")
    b = spark.createDataFrame([("ab" * 100_000 + "c7",), ("ab" * 10_000,)], "name string")
    began = time.monotonic()
    assert [r["short"] for r in relational.contained(a, b).collect()] == ["ab" * 7 + "c7"]
    assert time.monotonic() - began < 20


def test_pairs_of_groups_meet_in_tiles(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, r.choice([1, 2, 2]), [r.gauss(0, 0.3) for _ in range(6)]) for k in range(300)]
    rows += [(300 + k, 1, [0.5, 0.5, 0.5, 0.5, 0.0, 0.0]) for k in range(30)] + [(7, 2, [0.6] * 6)]  # copies; an id that comes twice
    odd = [(400, 1, None), (401, 1, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (402, None, [1.0] * 6), (403, 1, [1.0] * 5), (404, 1, []), (405, 1, [1.0] * 5)]
    nan, inf = float("nan"), float("inf")
    rows += odd + [(500, 2, [nan] * 6), (501, 2, [inf, 1.0, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    x, y = (df.select(F.col("vec_id").alias(n), F.col("embedding").alias(f"v{n}"), "label") for n in "ab")
    want = x.join(y, "label").where("a < b").select("a", "b", F.round(bands.vectors.dot(F.col("va"), F.col("vb")), 5).alias("s")).where("s >= 0.3")
    want = sorted((a, b, str(s)) for a, b, s in want.collect())
    monkeypatch.setattr(bands, "STRIP", 16)
    for tile in (1 << 13, 40):
        monkeypatch.setattr(bands, "TILE", tile)
        found = bands.pairs_of_groups(df, 0.3, "label", digits=5)
        assert sorted((a, b, str(s)) for a, b, s in found.collect()) == want
    assert len(want) > 1000 and "Join" not in str(found._jdf.queryExecution().executedPlan()).replace("BroadcastHashJoin", "")
