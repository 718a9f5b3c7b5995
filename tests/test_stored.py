import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.operators import sketches, vectors
from docengine.operators.ivf import InvertedFile
from docengine.sources.observed import write_observed


def clustered(spark, n, seed=1, first=0, dim=24):
    r = np.random.default_rng(seed)
    middles = np.random.default_rng(9).standard_normal((15, dim))
    rows = [(first + k, [float(x) for x in middles[r.integers(15)] + 0.25 * r.standard_normal(dim)], int(r.integers(4))) for k in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.select("query_id", "vec_id").collect()}


def test_lists_are_pruned_and_find_nearly_all(spark, tmp_path):
    base, more = clustered(spark, 900), clustered(spark, 300, 2, 5000)
    odd = spark.createDataFrame([(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [1.0], 1), (9004, [float("nan")] * 24, 1)], base.schema)
    lists = InvertedFile.build(base.unionByName(odd), f"file://{tmp_path}/lists", columns=["label"])
    lists.append(more, columns=["label"])
    every = base.unionByName(more)
    asked = every.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    for where in (None, F.col("label") == 2):
        want = pairs(vectors.nearest(every, asked, 10, where=where))
        got = pairs(lists.search(asked, 10, probes=4, where=where))
        assert len(got & want) >= 0.95 * len(want)
        assert pairs(lists.search(asked, 10, probes=len(lists.centroids), where=where)) == want
    # the folders of other lists are not read, and the predicate reaches the scan
    one = lists.scan([3], F.col("label") == 2)
    assert {f.split("list=")[1].split("/")[0] for f in one.inputFiles()} <= {str(k) for k in range(len(lists.centroids))}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,2)]" in plan
    assert InvertedFile(spark, f"file://{tmp_path}/lists").centroids.shape == lists.centroids.shape
    assert lists.search(asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        InvertedFile.build(odd.where("vec_id < 9003"), f"file://{tmp_path}/none")


def test_summaries_merge_to_what_one_summary_says(spark):
    r = np.random.default_rng(3)
    rows = [(int(k % 7), int(r.integers(5000)), float(r.normal()), "a" if k % 3 else "b") for k in range(30_000)] + [(0, None, None, "a")]
    df = spark.createDataFrame(rows, "day int, user long, value double, kind string")
    by_day = sketches.report(sketches.summarize(df, F.col("day"), ["kind"], "user", "value"), ["kind"])
    for x in by_day.collect():
        own = df.where(F.col("kind") == x["kind"])
        users = own.select("user").where("user is not null").distinct().count()
        assert x["n"] == own.count() and abs(x["distinct"] - users) <= sketches.distinct_error() * users
        values = np.sort([v["value"] for v in own.where("value is not null").select("value").collect()])
        for q, v in zip((0.5, 0.95), x["quantiles"]):
            assert abs(np.searchsorted(values, v) / len(values) - q) <= sketches.RANK


def test_measures_are_taken_while_writing(spark, tmp_path):
    df = spark.range(1000).withColumn("t", F.when(F.col("id") % 3 == 0, "x"))
    seen = write_observed(df, lambda x: x.write.parquet(f"file://{tmp_path}/out"), n=F.count(F.lit(1)), filled=F.count("t"), most=F.max("id"))
    assert seen == {"n": 1000, "filled": 334, "most": 999}
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1000
    # one job: the measures are part of the write
    tracker, group = spark.sparkContext.statusTracker(), "observed"
    spark.sparkContext.setJobGroup(group, "")
    write_observed(df, lambda x: x.write.parquet(f"file://{tmp_path}/again"), n=F.count(F.lit(1)))
    assert len(tracker.getJobIdsForGroup(group)) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
