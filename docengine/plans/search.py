"""Index build and hybrid search over a knowledge base made of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import chart_links, chunking, fulltext, hybrid, vectors
from docengine.sources.tables import discard, kept, stored


def hashed_embedding(text: Column, dim: int = 32) -> Column:
    """Stand-in for an embedding model: counts of hashed tokens, normalized. Native and deterministic."""
    slots = F.transform(T.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = vectors.let(slots, lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(held, lambda s: s == i)).cast("double")))
    return vectors.normalize(counts)


@dataclass
class KnowledgeBase:
    """chunks (node, doc, source, chunk_type, parent, group_id, content), parents (parent, content, chart_ids, group_id, source), index, vectors (node, embedding)."""

    chunks: DataFrame
    parents: DataFrame
    index: fulltext.Index
    vectors: DataFrame


def knowledge_base(docs: DataFrame, size: int = 1024, embed: Callable[[Column], Column] = hashed_embedding, charts: DataFrame | None = None) -> KnowledgeBase:
    """Chunks without repeats inside their document, their parents, a BM25 index and vectors, each written once.

    charts (doc_id, stem, json): their summaries stand below their images before texts are cut, each chart is a chunk
    of its own, and parents know the charts that they name. What is written on the way is deleted."""
    known, spark, whole = None, docs.sparkSession, docs
    if charts is not None:
        known = kept(chart_links.usable(charts), "charts")
        docs = chart_links.inject_summaries(docs, known).drop("n_injected")
    chunks, first = stored(chunking.dedup_in_document(chunking.chunk(docs, "structure_aware", size=size)), "chunks")
    chunks = kept(chunking.parents(chunks)[0], "nodes")
    discard(spark, first)
    nodes = chunks.select(F.col("chunk_id").alias("node"), F.col("doc_id").alias("doc"), "source", "chunk_type", "parent", "group_id", "content")
    parents, ids, second = chunking.passages(chunks), F.lit(None).cast("string"), None
    if known is not None:
        parents, second = stored(parents, "parents")
        named = chart_links.chart_ids(parents, known, "parent")
        parents, ids = parents.join(named, "parent", "left"), F.to_json("chart_ids")
        sources = whole.groupBy(F.col("doc_id").alias("doc")).agg(F.min("source").alias("source"))
        content = chunking.chart_chunk(F.col("node"), F.col("name"), F.col("kind"), F.col("description"), F.col("data"))
        # A stem may stand in several documents: its chunk is the one of the first.
        rows = known.join(sources, "doc").groupBy("node").agg(F.min(F.struct("doc", "source", content.alias("content"))).alias("c"))
        rows = rows.select("node", "c.doc", "c.source", F.lit("chart").alias("chunk_type"), F.lit(None).cast("string").alias("parent"), T.dedup_group_id(F.col("c.content"), F.lit("chart"), F.col("node")).alias("group_id"), "c.content")
        nodes = nodes.unionByName(kept(rows, "chart-nodes"))
    up = kept(parents.select("parent", "content", ids.alias("chart_ids"), T.dedup_group_id(F.col("content"), F.lit("parent")).alias("group_id"), "source"), "passages")
    if second is not None:
        discard(spark, second)
    index = fulltext.build(nodes, "node", "content")
    # Postings and lengths are read from the stored bags of terms.
    index = fulltext.Index(index.postings, index.lengths, kept(index.terms, "terms"), kept(index.stats, "stats"), index.bags)
    return KnowledgeBase(nodes, up, index, kept(nodes.select("node", embed(F.col("content")).alias("embedding")), "vectors"))


def search(kb: KnowledgeBase, queries: DataFrame, top_k: int = 10, pool: int | None = None, threshold: float | None = None, where: Column | None = None,
           embed: Callable[[Column], Column] = hashed_embedding, rerank: Callable[[DataFrame], DataFrame] | None = None, charts_per_parent: int = 2, digits: int | None = None) -> DataFrame:
    """query_id, node, rank, score, hits, citations, chars, is_chart of the best parents for each query (query_id, query).

    Three times top_k candidates of both branches are fused; hits rise to their parents (charts as hits go); bonuses,
    group de-duplication and the optional rerank hook (rows -> rows with `rerank`) follow. Each row brings the charts
    that it names, `charts_per_parent` at most; the final cut counts rows that are no charts. digits: scores of both
    branches are rounded, so that equal ones rank by node."""
    wide = 3 * max(1, top_k)
    allowed = kb.chunks if where is None else kb.chunks.where(where)
    asked = queries.select("query_id", embed(F.col("query")).alias("query_vec"))
    base = kb.vectors if where is None else kb.vectors.join(allowed.select("node"), "node", "left_semi")
    near = vectors.nearest(base, asked, wide, id="node", digits=digits)
    words = fulltext.search(kb.index, queries, 2 * wide, id="node", allowed=None if where is None else allowed, digits=digits)
    fused = kept(fulltext.first_of_each(hybrid.fuse(near, words), [F.desc("score"), "node"], wide).select("query_id", "node", "score"), "fused")
    # What was found is small beside the base: the base's rows are looked up where they lie, their contents are not shuffled.
    met = kept(kb.chunks.select("node", "chunk_type", "parent").join(fulltext.small(kept(fused.select("node").distinct(), "met")), "node", "left_semi"), "met")
    above = kb.parents.select("parent").join(fulltext.small(kept(met.select("parent").distinct(), "above")), "parent", "left_semi")
    found = fulltext.small(kept(hybrid.aggregate(hybrid.promote(fused, met, above)), "found"))
    info = kb.parents.select(F.col("parent").alias("node"), "content", "chart_ids", "group_id", "source").unionByName(kb.chunks.select("node", "content", F.lit(None).cast("string").alias("chart_ids"), "group_id", "source"))
    rows = found.join(info, "node").withColumn("score", hybrid.bonus(F.col("chart_ids"), F.col("content"), F.col("hits"), F.col("score")))
    rows = hybrid.dedup_groups(hybrid.ranked(rows))
    rows = hybrid.ranked(rows.drop("rank"))
    rows = rerank(rows) if rerank else rows.withColumn("rerank", F.lit(None).cast("double"))
    rows = kept(hybrid.rerank_merge(rows, pool or wide, wide), "merged")
    charts = kb.chunks.where("chunk_type = 'chart'").select(F.col("node").alias("chart"))
    total = min(12, max(3, top_k))
    placed = hybrid.expand_charts(rows, charts, total, charts_per_parent)
    known = rows.select("query_id", "node", "group_id", "hits", "citations", F.length("content").alias("chars"))
    known = known.unionByName(placed.where("is_chart").select("query_id", "node").join(kb.chunks.where("chunk_type = 'chart'").select("node", "group_id", F.lit(0).cast("long").alias("hits"), F.array().cast("array<string>").alias("citations"), F.length("content").alias("chars")), "node").distinct())
    cut = hybrid.final_cut(placed.join(known, ["query_id", "node"]), top_k, threshold)
    return cut.select("query_id", "node", "rank", F.round("score", 6).alias("score"), "hits", F.array_join("citations", ",").alias("citations"), "chars", "is_chart")


def pick_unique(rows: DataFrame, source: str, most: int) -> DataFrame:
    """The first rows of `most` different sources of each query, in rank order; adds k."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", source).orderBy("rank"))).where("__n = 1").drop("__n")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("k") <= most)


def best_of(indexes: list[DataFrame]) -> DataFrame:
    """The best score of each node over several indexes (ties: the index named first in the alphabet)."""
    rows = reduce(DataFrame.unionByName, indexes)
    best = rows.groupBy("node").agg(F.max("score").alias("score"), F.min(F.struct(-F.col("score"), "name")).alias("b"))
    return best.select("node", "score", F.col("b.name").alias("name"))


def without(rows: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    return rows.join(gone.select(id), id, "left_anti")


def coverage(asked: DataFrame, hits: DataFrame, least: float) -> DataFrame:
    """query_id, hits, max_score, uncovered (no hit, or the best below `least`) of every query."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("max_score"))
    rows = asked.join(found, "query_id", "left")
    return rows.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), "max_score", (F.coalesce("max_score", F.lit(0.0)) < least).alias("uncovered"))


def without_nodes(kb: KnowledgeBase, gone: DataFrame, parents: DataFrame | None = None) -> KnowledgeBase:
    """The knowledge base without chunks (node) and parents (parent); terms and statistics are counted again."""
    chunks = kb.chunks.join(gone.select("node"), "node", "left_anti")
    postings = kb.index.postings.join(gone.select("node"), "node", "left_anti")
    lengths = kb.index.lengths.join(gone.select("node"), "node", "left_anti")
    left = kb.parents if parents is None else kb.parents.join(parents.select("parent"), "parent", "left_anti")
    index = fulltext.Index(postings, lengths, *fulltext.weights(postings, lengths))
    return KnowledgeBase(chunks, left, index, kb.vectors.join(gone.select("node"), "node", "left_anti"))


def delete_by_source(kb: KnowledgeBase, sources: DataFrame) -> KnowledgeBase:
    """Without the chunks and parents of the sources (source)."""
    return without_nodes(kb, kb.chunks.join(sources.select("source"), "source", "left_semi"), kb.parents.join(sources.select("source"), "source", "left_semi"))


def delete_by_query(kb: KnowledgeBase, queries: DataFrame, most: int = 1000) -> KnowledgeBase:
    """Without the `most` best chunks of each query by words."""
    return without_nodes(kb, fulltext.search(kb.index, queries, most, id="node").select("node").distinct())


def collection_info(kb: KnowledgeBase) -> DataFrame:
    """source, chunk_type, chunks, documents, vectors of a knowledge base."""
    rows = kb.chunks.join(kb.vectors.select("node", F.lit(1).alias("v")), "node", "left")
    return rows.groupBy("source", "chunk_type").agg(F.count("*").alias("chunks"), F.countDistinct("doc").alias("documents"), F.count("v").alias("vectors"))
