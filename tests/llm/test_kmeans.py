import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, n int"


def plain(rows, k=40, rounds=5, dim=64):
    """Each distance worked out, in Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(np.float32(x)) for x in e)]
    draw = sorted((hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    places = [v for _, v in draw[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(places))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        places = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(places)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, places[c])).encode()).hexdigest()) for i, c, d in found]


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, e, "x", 1, 2) for i, e in rows], SCHEMA)
    found = kmeans.cluster(df, **options).withColumn("digest", kmeans.digest(F.col("centroid")))
    return [tuple(x) for x in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "digest").collect()]


def vectors(n=300, seed=2):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(k, [x + r.uniform(-0.2, 0.2) for x in r.choice(middles)]) for k in range(n)]
    rows += rows[:20] + [(5, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] * 64), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, [0.0] * 64), (907, [-0.0] * 64)]
    return rows


def test_equals_plain_rounds(spark):
    rows = vectors()
    assert sorted(got(spark, rows), key=str) == sorted(plain(rows), key=str)


def test_ties_go_to_the_smaller_number(spark):
    r = random.Random(4)
    rows = [(k, [float(r.choice([0, 1])) / 256 for _ in range(2)] + [0.0] * 62) for k in range(200)]
    assert sorted(got(spark, rows), key=str) == sorted(plain(rows), key=str)


def test_large_components_are_exact(spark):
    rows = [(k, [float(v * 1000 + k) for v in e]) for k, e in vectors(60)[:60]] + [(100, [300_000.0] * 64)]
    assert sorted(got(spark, rows), key=str) == sorted(plain(rows), key=str)
    assert {x[0] for x in got(spark, [*rows, (101, [3e30] * 64)])} == {i for i, _ in rows}


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(20)[:7]
    assert sorted(got(spark, rows), key=str) == sorted(plain(rows), key=str)
    assert got(spark, []) == [] and got(spark, [(1, None)]) == []


def test_empty_centroids_stay_and_scans_end_early():
    r = np.random.default_rng(1)
    places = r.integers(-256, 256, (40, 64))
    x = places[r.integers(0, 40, 2000)] + r.integers(-20, 20, (2000, 64))
    c = kmeans.Centroids(places)
    all_far = ((x[:, None, :] - places[None]) ** 2).sum(2)
    near = np.argmin(all_far, axis=1)
    cluster, distance, first = c.assign(x, np.zeros(2000, np.int64))
    assert (cluster == near).all() and (distance == all_far.min(axis=1)).all()
    again, _, took = c.assign(x, cluster)
    assert (again == near).all() and took < 1.1 * len(x) <= first


def test_exact_and_whole_number_paths_agree():
    r = np.random.default_rng(3)
    places, x = r.integers(-99, 99, (10, 8)), r.integers(-99, 99, (500, 8))
    for scale in (1, kmeans.EXACT):
        cluster, distance, _ = kmeans.Centroids(places * scale).assign(x * scale, np.zeros(500, np.int64))
        assert (distance == ((x - places[cluster]) ** 2).sum(1) * scale * scale).all()


@pytest.mark.parametrize("bad", ["vec_id", "embedding"])
def test_null_columns(spark, bad):
    rows = [(None if bad == "vec_id" else k, None if bad == "embedding" else e) for k, e in vectors(50)[:50]]
    assert sorted(got(spark, rows), key=str) == sorted(plain(rows), key=str)
