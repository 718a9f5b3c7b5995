"""Filter interaction audit (operator 13): what five document filters remove in every order, by part.

Filters (words are maximal runs other than white space of ASCII, case-sensitive): A under 50 words; B under 65 per
cent different words; C over 5 per cent capitals A-Z; D a character of #$%&*|; E the text of a smaller id again.

E comes from sorting. Rows are dealt by ranges of (fingerprint, id), so that no group of copies, however large, has to
lie in one task, and each task sorts its range by fingerprint, full text and id. A row fails if its predecessor has
the same text and the run of that text began with a smaller id. Runs that can go on across a boundary (those of a task's first and
last fingerprint) are few for each task; a small table of them tells each task the least id that came before. Texts are
compared whole; the fingerprint only sorts.

A document becomes a mask of five failures and two labels. Masks are counted by part before any shuffle, and the
counts are additive: the rows of all 120 orders follow from at most 128 counts of a part.

A null text is empty (it fails A, and E if another empty text has a smaller id), a null part counts as the empty
string. A null id is never smaller than another and never has a smaller one; rows that repeat id and text don't make
each other fail E. Of several labels of an id any that says so counts; null labels and labels without a document
don't. Empty tables give no rows (no part); without labels the lost counts are zero. Other columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import discard, fits, smaller_batches, stored

LETTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, "#$%&*|"
GOOD, TOXIC = 32, 64
ORDERS = ["".join(p) for p in permutations(LETTERS)]
SPACE = r"[\x20\x09-\x0D]+"


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def masked(rows: DataFrame) -> DataFrame:
    """rows with `mask`: failures of A to D as bits 1, 2, 4 and 8. Words are split once."""
    text = F.col("text")
    split = rows.withColumn("words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    n, different = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < WORDS, 100 * different < DISTINCT * n, 100 * capitals > CAPITALS * F.length(text), F.length(F.translate(text, MARKS, "")) < F.length(text)]
    return split.withColumn("mask", sum((F.when(f, 1 << at).otherwise(0) for at, f in enumerate(fails)), F.lit(0)).cast("int")).drop("words")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (print, text, id, part, mask) of a task, without their texts: each with the least id of its run so far.

    run: the number of the row's run where its fingerprint is the task's first, else null. Rows of `edge` stand for the
    runs of the task's first and last fingerprint, with their text and least id."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId()
    first = print_now = text_now = least = None
    number, edges = -1, []
    for batch in batches:
        prints, ids, texts = batch.column("print").to_pylist(), batch.column("id").to_pylist(), batch.column("text")
        runs, leasts = [], []
        for at, (p, i) in enumerate(zip(prints, ids)):
            text = texts[at]
            if number < 0 or p != print_now or text.as_buffer() != text_now:
                if number < 0:
                    first = p
                elif p != print_now:
                    edges = [e for e in edges if e[0] == first]  # an earlier fingerprint that is neither first nor last
                print_now, text_now, least, number = p, text.as_buffer(), i, number + 1
                edges.append((p, text.as_py(), number, i))
            runs.append(number if p == first else None)
            leasts.append(least)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([place] * n, pa.int32()), pa.array(runs, pa.int64()), batch.column("id"), pa.array(leasts, pa.int64()), batch.column("part"), batch.column("mask"), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array([False] * n)], _NAMES)
    for p, text, run, i in edges:
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([run], pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.array([text], pa.string()), pa.array([p], pa.int64()), pa.array([True])], _NAMES)


_SCHEMA = "place int, run long, id long, least long, part string, mask int, text string, print long, edge boolean"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def failures(df: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> tuple[DataFrame, str]:
    """id, part, mask of every row (five bits), and the path of the table that it is read from."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")).withColumn("print", fingerprint(F.col("text")))
    smaller_batches(df)
    dealt = masked(rows.repartitionByRange(F.col("print"), F.col("id").asc_nulls_last()).sortWithinPartitions("print", "text", F.col("id").asc_nulls_last()))
    held, path = stored(dealt.select("print", "text", "id", "part", "mask").mapInArrow(_runs, _SCHEMA), "audit", by="edge")
    edges = held.where("edge")
    earlier = F.min("least").over(Window.partitionBy("print", "text").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    came = edges.select("place", "run", earlier.alias("came")).where("came is not null")
    found = held.where("not edge").join(fits(came), ["place", "run"], "left")
    again = F.coalesce(F.least("least", "came") < F.col("id"), F.lit(False))
    return found.select("id", "part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask")), path


def counted(df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """part, mask (seven bits), n: the additive counters."""
    found, path = failures(df, text, id, part)
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    full = F.col("mask") + F.when(F.col("good"), GOOD).otherwise(0) + F.when(F.col("toxic"), TOXIC).otherwise(0)
    counts, _ = stored(found.join(said, "id", "left").groupBy("part", full.alias("mask")).agg(F.count("*").alias("n")), "masks")
    discard(df.sparkSession, path)
    return counts


def _total(test: str) -> Column:
    """Sum of n of the (mask, n) pairs of `held` that meet the SQL condition `test` on m_."""
    return F.expr(f"aggregate(held, 0L, (s, x) -> s + if({test.replace('m_', 'x.mask')}, x.n, 0L))")


def interactions(df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (all long)."""
    counts = counted(df, labels, text, id, part)
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n")).alias("held"))  # 128 at most
    orders = F.array(*[F.lit(o) for o in ORDERS])
    rows = held.select("part", "held", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    own = F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{LETTERS}') - 1)")
    earlier = F.expr(f"aggregate(sequence(1, 5), 0, (s, k) -> if(k < step, s | shiftleft(1, locate(substring(filter_order, k, 1), '{LETTERS}') - 1), s))")
    rows = rows.withColumns({"own": own, "earlier": earlier})
    lost = "m_ & own != 0 and m_ & earlier = 0"
    return rows.select(
        "part", "filter_order", "step",
        _total("m_ & (own | earlier) = 0").alias("kept"),
        _total(lost).alias("removed"),
        _total("m_ & own != 0 and m_ & earlier != 0").alias("redundant"),
        _total("m_ & 31 = own").alias("unique_fails"),
        _total(f"{lost} and m_ & {GOOD} != 0").alias("good_lost"),
        _total(f"{lost} and m_ & {TOXIC} != 0").alias("toxic_lost"),
        # of the 120 orders a document's failing filters come first equally often
        F.expr("aggregate(held, 0L, (s, x) -> s + if(x.mask & own != 0, x.n * (120 div bit_count(x.mask & 31)), 0L))").alias("shapley"),
    )


def interactions_sql() -> str:
    """DuckDB SQL of the audit over `documents` and `labels`."""
    return r"""
WITH d AS MATERIALIZED (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS MATERIALIZED (SELECT part, doc_id,
  len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, COALESCE(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(COALESCE(quality = 1, false)) AS good, bool_or(COALESCE(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
g AS MATERIALIZED (SELECT f.*, COALESCE(good, false) AS good, COALESCE(toxic, false) AS toxic, a::INT + b::INT + c::INT + d::INT + e::INT AS fails FROM f LEFT JOIN l USING (doc_id)),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM one p, one q, one r, one s, one t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
m AS MATERIALIZED (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed, good, toxic, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT m.part, filter_order, step, own, n, good, toxic, failed,
  contains(failed, own) AS fails, length(earlier) > 0 AND length(translate(failed, earlier, '')) < length(failed) AS gone FROM m, steps),
t AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant,
  sum(n) FILTER (failed = own) AS unique_fails, sum(n) FILTER (NOT gone AND fails AND good) AS good_lost, sum(n) FILTER (NOT gone AND fails AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(COALESCE(kept, 0) AS BIGINT) AS kept, CAST(COALESCE(removed, 0) AS BIGINT) AS removed, CAST(COALESCE(redundant, 0) AS BIGINT) AS redundant,
 CAST(COALESCE(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(COALESCE(good_lost, 0) AS BIGINT) AS good_lost, CAST(COALESCE(toxic_lost, 0) AS BIGINT) AS toxic_lost,
 CAST(COALESCE(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM t"""
