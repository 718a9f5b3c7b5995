"""Small relational operators: latest versions, pagination, roll-ups, nearest headings, theta matches."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.names import unused
from docengine.sources.tables import kept


def latest(df: DataFrame, key: str, version: str, where: Column | None = None) -> DataFrame:
    """The row of the greatest version of each key, among those that `where` lets through."""
    rows = df if where is None else df.where(where)
    n, = unused(rows.columns, "n")
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where(F.col(n) == 1).drop(n)


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page; the order must be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def status_rollup(df: DataFrame, key: str, status: str, progress: str) -> DataFrame:
    """All completed, else any failed, else any processing, else pending; progress is the truncated mean."""
    s = F.col(status)
    total = F.when(F.bool_and(s == "completed"), "completed").when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "processing"), "processing").otherwise("pending")
    return df.groupBy(key).agg(total.alias("status"), F.floor(F.avg(progress)).alias("progress"))


def job_rollup(df: DataFrame, key: str, ok: Column, images: Column) -> DataFrame:
    """success, failed or partial, with counters."""
    good, bad = F.count_if(ok), F.count_if(~ok)
    state = F.when(bad == 0, "success").when(good == 0, "failed").otherwise("partial")
    return df.groupBy(key).agg(state.alias("state"), good.alias("succeeded"), bad.alias("failed"), F.sum(images).alias("images"))


def version_rollup(df: DataFrame, scope: str, version: str, active: Column, updated: Column) -> DataFrame:
    """latest, active, count and last update of each scope."""
    return df.groupBy(scope).agg(F.max(version).alias("latest_version"), F.max(F.when(active, F.col(version))).alias("active_version"), F.count("*").alias("versions"), F.max(updated).alias("updated"))


def effective_limit(provider: Column, callsite: Column, default: int | None) -> Column:
    """The least of (provider's limit or the default) and the call site's, ignoring nulls."""
    return F.least(F.coalesce(provider, F.lit(default)), callsite)


def preceding_heading(df: DataFrame, key: str, pos: str, heading: Column, where: Column) -> DataFrame:
    """Adds heading: the nearest earlier one of the same key, for the rows that `where` picks."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("heading", F.last(heading, ignorenulls=True).over(w)).where(where)


def ancestors(items: DataFrame, key: str, pos: str, depth: str, deepest: int = 6) -> DataFrame:
    """Adds parent: the position of the nearest earlier item of lesser depth (null for none)."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.when(F.col(depth) > d, F.last(F.when(F.col(depth) == d, F.col(pos)), ignorenulls=True).over(w)) for d in range(1, deepest)]
    return items.withColumn("parent", F.greatest(*lasts))


#: Characters of short names that one pass looks for.
PART_CHARS = 8 << 20


def contained(short: DataFrame, long: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """short, long: pairs of distinct names (each frame has one column `name`) where the first is part of the second.

    The short names, counted first, come to each task as one automaton (Aho and Corasick) that finds all of them in a
    single look at a long name, so the work is linear in its length and in the pairs found; of more than `most` characters,
    by parts. Empty and null names are in none."""
    spark, held = short.sparkSession, kept(short.where("name <> ''").select("name").distinct(), "short-names")
    chars = held.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // most))
    rows, out = long.where("name is not null").select("name"), None
    for part in range(parts):
        names = held if parts == 1 else held.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        known = spark.sparkContext.broadcast(names.toArrow().column(0).combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for name in known.value.to_pylist():
                automaton.add_word(name, name)
            automaton.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, name in enumerate(batch.column(0).to_pylist()):
                    some = {x for _, x in automaton.iter(name)} if len(automaton) else ()
                    at += [i] * len(some)
                    found += some
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], ["short", "long"])

        pairs = rows.mapInArrow(run, "short string, long string")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def name_match(left: DataFrame, right: DataFrame, name: str, key: str) -> DataFrame:
    """The right row of each left name: the equal one, else the first (by key) where either name contains the other.

    Adds match (null for none). Names are matched once each; empty names match only their equals."""
    keys = right.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(key).alias("k"))
    asked = left.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    rest = asked.join(keys, "name", "left_anti").where("name != ''")
    names = keys.select("name").where("name != ''")
    pairs = contained(names, rest).select(F.col("long").alias("name"), F.col("short").alias("other")).unionByName(contained(rest, names).select(F.col("short").alias("name"), F.col("long").alias("other")))
    near = pairs.join(keys.withColumnRenamed("name", "other"), "other").groupBy("name").agg(F.min("k").alias("k"))
    own, = unused([*left.columns, "match"], "own")
    found = asked.join(keys, "name").unionByName(near).select(F.col("name").alias(own), F.col("k").alias("match"))
    return left.join(found, F.col(name) == F.col(own), "left").drop(own)


def resume(found: DataFrame, state: DataFrame, key: str, signature: str) -> DataFrame:
    """Rows whose key has no state yet or another signature in its last record (state: key, signature, offset)."""
    done, = unused(found.columns, "done")
    last = state.groupBy(key).agg(F.max_by(signature, "offset").alias(done))
    rows = found.join(last, key, "left")
    return rows.where(~F.col(signature).eqNullSafe(F.col(done))).drop(done)


def percentiles(df: DataFrame, key: str | None, value: str) -> DataFrame:
    """p50, p95 and max by linear interpolation."""
    p = F.expr(f"percentile({value}, array(0.5, 0.95, 1))")
    grouped = df.groupBy(key) if key else df.groupBy()
    return grouped.agg(p.alias("p")).select(*([key] if key else []), *[F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p95", "max"))])


def stale(rows: DataFrame, done: DataFrame, keys: list[str], files: str = "files_exist") -> DataFrame:
    """Rows that have to be made (again): no entry in `done` with equal keys (id, hash, theme, version) whose files exist."""
    kept = done.where(F.coalesce(F.col(files), F.lit(False))).select(*keys).distinct()
    return rows.join(kept, keys, "left_anti")


def apply_changes(table: DataFrame, changes: DataFrame, key: str, locked: str = "locked") -> DataFrame:
    """table after one change for each key: changes has the table's columns, `op` (create, update, delete, lock, unlock) and `seq`; the last one counts.

    An update takes the columns that are not null. A locked row takes no update and no delete; creating a key that is
    there, or changing one that is not, does nothing."""
    columns = table.columns
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    last = changes.withColumn("__n", rank).where("__n = 1").select(F.col(key).alias("__key"), "op", *[F.col(c).alias(f"__{c}") for c in columns if c != key])
    both = table.join(last, F.col(key) == F.col("__key"), "full")
    there, lock = F.col(key).isNotNull(), F.coalesce(F.col(locked), F.lit(False))
    op = F.coalesce(F.col("op"), F.lit(""))
    kept = (there & ~((op == "delete") & ~lock)) | (~there & (op == "create"))
    free = there & (op == "update") & ~lock

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(key), F.col("__key")).alias(c)
        if c == locked:
            return F.when(there & (op == "lock"), True).when(there & (op == "unlock"), False).when(there, lock).otherwise(F.coalesce(F.col(f"__{c}"), F.lit(False))).alias(c)
        return F.when(~there, F.col(f"__{c}")).when(free, F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)).alias(c)

    return both.where(kept).select(*[value(c) for c in columns])
