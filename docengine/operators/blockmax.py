"""Ranked retrieval that skips postings which can't reach the k-th score.

Postings of a term are kept in blocks ordered by impact: term frequency falling, then length rising. A block knows its largest
frequency and least length, and so, for any average length, a bound of what it adds to a score (BM25's part grows with
the frequency and falls with the length). Terms with many postings are dealt over shards by a hash of the id, each with
blocks of its own, so no term lies in one task.

A search has four steps, each for all queries at once:

1. The first blocks of the asked terms name the PROBES * k rows with the largest sums so far; scored exactly, the k-th best of
   them is a threshold that the k-th score of all can't be below.
2. Terms whose bounds together stay below the threshold are left out: a row that holds no other can't be among the k best. Of
   the other terms, blocks are left out that stay below it with the bounds of all other terms added.
3. The blocks that are left give each row a part of its score. The PROBES * k rows with the largest parts, scored exactly,
   raise the threshold; rows whose part and the bounds of the terms left out stay below it go.
4. What remains is scored exactly from the bags of terms of those rows alone.

Scores are those of the whole postings; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.operators.fulltext import B, K1, MOST_ROWS, first_of_each, small
from docengine.sources.tables import kept

#: Postings of a block and, about, of a shard of a term.
BLOCK, SHARD = 128, 1 << 20
#: Rows, times k, that are scored exactly for a threshold.
PROBES = 3
#: What rounding and the order of sums can change.
SLACK = 1e-6


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """BM25's part of a term without its weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.when(avgdl > 0, avgdl).otherwise(1.0)))


def blocks(bags: DataFrame, terms: DataFrame, id: str = "doc_id", size: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """term, shard, block (from 0), n, max_tf, min_dl, postings (id, tf, dl) of bags (id, dl, bag); terms: term, df."""
    rows = bags.select(F.col(id).alias("id"), "dl", F.explode("bag").alias("p")).select("id", "dl", "p.term", "p.tf")
    many = F.broadcast(terms.where(F.col("df") > shard).select("term", F.ceil(F.col("df") / shard).cast("int").alias("parts")))  # fewer than all postings / shard
    rows = rows.join(many, "term", "left").withColumn("shard", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), "parts")).cast("int"))
    place = F.row_number().over(Window.partitionBy("term", "shard").orderBy(F.desc("tf"), "dl", "id")) - 1
    placed = rows.withColumn("block", F.floor(place / size).cast("int"))
    held = placed.groupBy("term", "shard", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.array_sort(F.collect_list(F.struct("id", "tf", "dl"))).alias("postings"))  # `size` at most
    return held.select("term", "shard", "block", "n", "max_tf", "min_dl", "postings")


def _parts(rows: DataFrame, avgdl: float, keys: list[str]) -> DataFrame:
    """query_id, *keys, id, part of the postings in rows of blocks that met their queries."""
    each = rows.select("query_id", "idf", *keys, F.explode("postings").alias("p"))
    return each.select("query_id", *keys, F.col("p.id").alias("id"), (F.col("idf") * saturation(F.col("p.tf"), F.col("p.dl"), F.lit(avgdl))).alias("part"))


def search(held: DataFrame, bags: DataFrame, asked: DataFrame, avgdl: float, k: int, id: str = "doc_id", digits: int | None = None, gone: DataFrame | None = None, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank (from 0) of the k best rows, counters).

    held: blocks; bags: id, dl, bag; asked: query_id, term, idf; all may carry `keys` (a row's place, its segment, say),
    which together with the id name a row. gone: keys and id of rows that count no more.
    counters (a stored table): query_id, blocks (of all its terms), read (in steps 1 and 3), candidates (rows scored exactly)."""
    keys, loss = list(keys), SLACK + (10.0**-digits if digits is not None else 0.0)
    held, bags = held.withColumnRenamed(id, "id") if id in held.columns else held, bags.withColumnRenamed(id, "id")
    live = lambda df: df if gone is None else df.join(small(gone.select(*keys, "id")), [*keys, "id"], "left_anti")
    wanted = small(asked)
    bound = saturation(F.col("max_tf"), F.col("min_dl"), F.lit(avgdl))
    total = F.sum(F.col("idf") * saturation(F.col("tf"), F.col("dl"), F.lit(avgdl)))

    def scored(candidates: DataFrame) -> DataFrame:
        """query_id, keys, id, score of stored candidates, from their bags.

        A bag's terms meet the queries once, however many queries its row is a candidate of; no bag is copied or shuffled."""
        rows = kept(candidates.select(*keys, "id").distinct(), "rows")
        few = rows.count() <= MOST_ROWS
        texts = bags.join(F.broadcast(rows), [*keys, "id"], "left_semi") if few else bags
        each = texts.select(*keys, "id", "dl", F.explode("bag").alias("p")).select(*keys, "id", "dl", "p.term", "p.tf")
        sums = each.join(wanted, "term").groupBy("query_id", *keys, "id").agg(total.alias("score"))  # in part before the shuffle: a row's terms are together
        return sums.join(small(candidates), ["query_id", *keys, "id"])

    def threshold(sums: DataFrame, by: str) -> DataFrame:
        """query_id, least: what the k-th score can't be below, from the rows with the largest sums."""
        place = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c)))
        probes = kept(sums.withColumn("n", place(by)).where(F.col("n") <= PROBES * k).select("query_id", *keys, "id"), "probes")
        return kept(scored(probes).withColumn("n", place("score")).where(F.col("n") == k).select("query_id", (F.col("score") - loss).alias("least")), "thresholds")

    # Bounds come from the blocks' own columns: their postings are not read.
    of_term = held.join(small(kept(asked.select("term").distinct(), "words")), "term").groupBy("term").agg(F.max(bound).alias("most"), F.count("*").alias("blocks"))
    terms = kept(asked.join(of_term, "term").withColumn("most", F.col("most") * F.col("idf")), "bounds")
    first = held.where("block = 0").join(small(terms.select("query_id", "term", "idf")), "term")
    seen = live(_parts(first, avgdl, keys)).groupBy("query_id", *keys, "id").agg(F.sum("part").alias("sum"))
    known = terms.join(small(threshold(seen, "sum")), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term"))  # a query's terms
    known = known.withColumns({"upto": upto, "total": F.sum("most").over(Window.partitionBy("query_id"))})
    known = kept(known.withColumn("needed", F.col("upto") >= F.col("least")), "terms")
    rest = F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))), F.lit(0.0))
    limits = kept(known.groupBy("query_id").agg(F.first("least").alias("least"), rest.alias("rest"), F.sum("blocks").alias("blocks")), "limits")
    need = small(known.where("needed").select("query_id", "term", "idf", (F.col("least") - (F.col("total") - F.col("most"))).alias("block_least")))
    met = held.join(need, "term").where(bound * F.col("idf") >= F.col("block_least"))
    found = live(_parts(met, avgdl, keys)).groupBy("query_id", *keys, "id").agg(F.sum("part").alias("part"))
    found = kept(found.join(small(limits.select("query_id", "least", "rest")), "query_id").where(F.col("part") + F.col("rest") >= F.col("least")), "parts")
    raised = threshold(found, "part").withColumnRenamed("least", "raised")
    left = found.join(small(raised), "query_id", "left").where(F.col("part") + F.col("rest") >= F.coalesce("raised", F.lit(0.0)))
    candidates = kept(left.select("query_id", *keys, "id"), "candidates")
    scores = scored(candidates)
    scored_rows = (scores.withColumn("score", F.round("score", digits)) if digits is not None else scores).where("score > 0")
    best = first_of_each(scored_rows, [F.desc("score"), "id"], k).select("query_id", F.col("id").alias(id), "score", "rank")
    read = met.groupBy("query_id").agg(F.count("*").alias("met")).join(first.groupBy("query_id").agg(F.count("*").alias("first")), "query_id", "full")
    counters = limits.select("query_id", "blocks").join(read, "query_id", "left").join(candidates.groupBy("query_id").agg(F.count("*").alias("candidates")), "query_id", "left")
    counters = counters.select("query_id", "blocks", (F.coalesce("met", F.lit(0)) + F.coalesce("first", F.lit(0))).alias("read"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    return best, counters
