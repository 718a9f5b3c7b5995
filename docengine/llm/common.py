"""Helpers shared by the training-data operators: Arrow batching, shared storage, held-out split."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docengine.sources.tables import shared_folder

#: Rows and bytes that a Python operator holds at a time, whatever the Arrow batch size is.
SLICE_ROWS = 1024
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def slices(batches: Iterator[pa.RecordBatch], sized: str | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most SLICE_ROWS rows and about `most` bytes of column `sized` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if sized is None:
            for at in range(0, n, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS)
            continue
        at = 0
        lengths = [x or 0 for x in pc.binary_length(batch.column(batch.schema.get_field_index(sized))).to_pylist()]
        while at < n:
            end, held = at, 0
            while end < n and end - at < SLICE_ROWS and (end == at or held + lengths[end] <= most):
                held += lengths[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def trim() -> None:
    """Give free memory of this worker back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trimmed(task: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A task of two co-groups that gives free memory back when it ends."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = task(left, right)
        trim()
        return out

    return run


def smaller_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows where they have Spark's default size, too much for long texts."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType, sized: str | None = None, most: int = SLICE_BYTES, finish: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with `make()` called once a task; the function it returns gets one bounded slice at a time.

    `finish` runs when the task ends: workers live on between tasks, so what they remember is let go there, and
    free memory goes back to the system. Arrow batches hold BATCH_ROWS rows, unless the session says otherwise.
    """
    smaller_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        try:
            for piece in slices(batches, sized, most):
                out = apply(piece)
                if out is not None and out.num_rows:
                    yield out
        finally:
            if finish:
                finish()
            del apply
            trim()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, label: str, by: str | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: later steps survive lost executors without running it again. by: a column to lay folders by."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by `stored` that nothing reads any more."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like `names` that no column has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with more than this part of all rows is broadcast: there are fewer than 1 / FREQUENT of them.
FREQUENT = 0.001


def meet(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows joined by `key` to `found` (its column n counts the rows of each key): frequent keys by broadcast, others dealt by key."""
    least = max(100, int(found.agg(F.sum("n")).first()[0] or 0) * FREQUENT)
    frequent = F.broadcast(found.where(F.col("n") > least).drop("n"))
    return rows.join(frequent, key).unionByName(rows.join(frequent.select(key), key, "left_anti").join(found.where(F.col("n") <= least).drop("n"), key))


#: Rows and cells (of 8 to 16 bytes) of a table that `fits` lets be broadcast.
MOST_ROWS, MOST_CELLS = 200_000, 1_000_000


def fits(df: DataFrame, cells: Column | None = None) -> DataFrame:
    """df (a stored table of narrow rows) for a join: to be broadcast if it is small by count, as it is otherwise."""
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(cells), F.lit(0)) if cells is not None else F.lit(0)).first()
    return F.broadcast(df) if n <= MOST_ROWS and held <= MOST_CELLS else df


def held_out(doc_id: Column, remainder: int = 2, of: int = 4) -> Column:
    """True where crc32 of the id as text leaves `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))
