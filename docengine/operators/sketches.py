"""Mergeable summaries kept for each batch, next to the exact forms: distinct counts (HLL) and quantiles (KLL).

A batch leaves one small row for each key; a report merges rows and reads no data again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of an HLL sketch's buckets (relative error about 1.04 / sqrt(2^LG), two deviations stated), and KLL's size (rank error below RANK).
LG, K, RANK = 12, 200, 0.0266


def distinct_error(lg: int = LG) -> float:
    return 2 * 1.04 / 2 ** (lg / 2)


def summarize(df: DataFrame, batch: Column, keys: list[str], distinct: str, value: str) -> DataFrame:
    """batch, keys, n, hll, kll: one row for each key of each batch. Nulls of `distinct` and `value` count in n only."""
    rows = df.select(batch.alias("batch"), *keys, F.col(distinct).cast("string").alias("d"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("batch", *keys).agg(F.count("*").alias("n"), F.hll_sketch_agg("d", F.lit(LG)).alias("hll"), F.kll_sketch_agg_double("v", F.lit(K)).alias("kll"))


def report(batches: DataFrame, keys: list[str], at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """keys, n, distinct (estimated) and quantiles (array, in the order of `at`) over all batches."""
    merged = batches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("kll", F.lit(float(q))) for q in at])
    return merged.select(*keys, "n", F.hll_sketch_estimate("hll").alias("distinct"), quantiles.alias("quantiles"))
