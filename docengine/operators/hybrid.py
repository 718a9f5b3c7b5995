"""Hybrid ranking: fusion, parent promotion, aggregation, bonuses, group de-duplication, rerank, charts, final cut.

Rows of many queries go through together; `query_id` is always part of the key. Ties are broken by the node's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
CHART_MARK = "[图表]"


def ranked(hits: DataFrame, id: str = "node", score: str = "score", by: str = "query_id") -> DataFrame:
    """Adds rank: the position in each list, from 0."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), id)) - 1)


def fuse(vector: DataFrame, text: DataFrame, vector_weight: float = 0.5, text_weight: float = 0.5, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal ranks of two lists (query_id, node, rank from 0); a list without the node adds nothing."""
    v = vector.select("query_id", "node", F.col("rank").alias("vector_rank"))
    t = text.select("query_id", "node", F.col("rank").alias("text_rank"))
    both = v.join(t, ["query_id", "node"], "full")

    def part(rank: str, weight: float) -> Column:
        return F.coalesce(F.lit(weight) / (F.lit(k) + F.col(rank)), F.lit(0.0))

    return both.withColumn("score", part("vector_rank", vector_weight) + part("text_rank", text_weight))


def ordered_union(first: DataFrame, second: DataFrame, id: str = "node") -> DataFrame:
    """Both lists, one after the other, each node where it comes first: query_id, id, position (from 0)."""
    rows = first.select("query_id", id, "rank", F.lit(0).alias("list")).unionByName(second.select("query_id", id, "rank", F.lit(1).alias("list")))
    once = rows.groupBy("query_id", id).agg(F.min(F.struct("list", "rank")).alias("at"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("at", id)) - 1).drop("at")


def promote(hits: DataFrame, nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Chart hits go; a hit whose parent exists becomes the parent. nodes: node, chunk_type, parent; parents: parent."""
    known = hits.join(nodes, "node").where(F.coalesce(F.col("chunk_type"), F.lit("")) != "chart")
    there = parents.select(F.col("parent").alias("found"))
    up = known.join(there, F.col("parent") == F.col("found"), "left")
    return up.select("query_id", F.coalesce("found", "node").alias("node"), "score", F.col("found").isNotNull().alias("promoted"))


def aggregate(hits: DataFrame) -> DataFrame:
    """One row for each node: score (the best), score_sum, hits."""
    return hits.groupBy("query_id", "node").agg(F.max("score").alias("score"), F.sum("score").alias("score_sum"), F.count("*").alias("hits"))


def bonus(chart_ids: Column, text: Column, hits: Column, score: Column | None = None) -> Column:
    """0.03 with charts, 0.02 with an image or chart mark, 0.01 for each further hit up to 0.05.

    score: what they are added to, one after the other; the order of the sums decides which scores tie."""
    ids = F.trim(F.coalesce(chart_ids, F.lit("")))
    charts = F.when((ids != "") & ~ids.isin("[]", "{}"), F.lit(0.03)).otherwise(0.0)
    marks = F.when(F.contains(text, F.lit("images/")) | F.contains(text, F.lit(CHART_MARK)), F.lit(0.02)).otherwise(0.0)
    return (charts if score is None else score + charts) + marks + F.when(hits >= 2, F.least(F.lit(0.05), (hits - 1) / 100)).otherwise(0.0)


def dedup_groups(rows: DataFrame, group: str = "group_id", source: str = "source", most: int = 5) -> DataFrame:
    """The first row of each group in rank order (rows without a group are groups of their own) with up to `most`
    distinct sources, in the order met. rows: query_id, node, rank, group, source, and more.

    Sources go through a minimum by (group, source) first, so what is gathered for a group is bounded by `most`."""
    key = F.when(F.coalesce(F.trim(F.col(group)), F.lit("")) != "", F.col(group)).otherwise(F.concat(F.lit("\0"), F.col("node").cast("string")))
    keyed = rows.withColumn("__key", key)
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__key").orderBy("rank"))).where("__n = 1").drop("__n")
    met = keyed.where(F.coalesce(F.col(source), F.lit("")) != "").groupBy("query_id", "__key", source).agg(F.min("rank").alias("at"))
    met = met.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__key").orderBy("at", source))).where(F.col("__n") <= most)
    cited = met.groupBy("query_id", "__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(source).alias("s")))), lambda x: x["s"]).alias("citations"))
    return first.join(cited, ["query_id", "__key"], "left").drop("__key").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


def rerank_merge(rows: DataFrame, pool: int, keep: int) -> DataFrame:
    """Rows of the pool by their rerank score (those without one behind), then the others by rank; `keep` of them.

    rows: query_id, node, rank, rerank (null: the reranker gave none)."""
    tier = F.when(F.col("rank") >= pool, 2).when(F.col("rerank").isNull(), 1).otherwise(0)
    order = Window.partitionBy("query_id").orderBy("__tier", F.when(F.col("__tier") == 0, -F.col("rerank")), "rank")
    return rows.withColumn("__tier", tier).withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < keep).drop("__tier")


def parse_ids(raw: Column) -> Column:
    """Distinct ids of a JSON list, else of a comma-separated text."""
    parsed = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    listed = F.when(F.trim(raw).startswith("["), parsed)
    plain = F.split(raw, ",")
    found = F.transform(F.coalesce(listed, plain), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x != ""))


def expand_charts(rows: DataFrame, charts: DataFrame, total: int, per_parent: int) -> DataFrame:
    """The rows and, behind each, its charts: `per_parent` at most, `total` in a query, each chart once.

    rows: query_id, node, place, score, chart_ids; charts: chart. Out: query_id, node, place, child (0 for the row itself), score, is_chart.
    A chart goes to the first parent that names it, then both limits are taken in order."""
    own = rows.select("query_id", "node", "place", F.lit(0).alias("child"), "score", F.lit(False).alias("is_chart"))
    named = rows.select("query_id", "place", "score", F.posexplode(parse_ids(F.col("chart_ids"))).alias("at", "chart")).join(charts.select("chart"), "chart")
    once = named.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chart").orderBy("place", "at"))).where("n = 1")
    few = once.withColumn("child", F.row_number().over(Window.partitionBy("query_id", "place").orderBy("at"))).where(F.col("child") <= per_parent)
    some = few.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "child"))).where(F.col("n") <= total)
    return own.unionByName(some.select("query_id", F.col("chart").alias("node"), "place", "child", "score", F.lit(True).alias("is_chart")))


def default_chart_caps(top_k: Column) -> Column:
    return F.least(F.lit(12), F.greatest(F.lit(3), top_k))


def final_cut(rows: DataFrame, top_k: int, threshold: float | None = None) -> DataFrame:
    """Distinct nodes and groups in order, `top_k` slots for rows that are no charts; charts ride along.

    A row below the threshold uses up its slot; after the slots nothing comes. rows: query_id, node, place, child, score, is_chart, group_id."""
    order = Window.partitionBy("query_id").orderBy("place", "child")
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "node").orderBy("place", "child"))).where("n = 1")
    group = F.coalesce(F.col("group_id"), F.lit(""))
    key = F.when(group != "", group).otherwise(F.concat(F.lit("\0"), F.col("node").cast("string")))
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("place", "child"))).where("n = 1")
    slots = once.withColumn("slot", F.sum(F.when(F.col("is_chart"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("slot") <= top_k)
    if threshold is not None:
        slots = slots.where(F.col("is_chart") | (F.col("score") >= threshold))
    return slots.withColumn("rank", F.row_number().over(order) - 1).drop("n", "slot")
