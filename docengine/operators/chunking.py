"""Chunking: documents to chunks by four strategies, their ids, de-duplication, parents and statistics.

Block and boundary rules depend on the order inside a text, so each text goes through one Python function in
Arrow batches; nothing is shuffled for it. Parents are packed by document (a window of one document's chunks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import sequential as S
from docengine.functions import text as T
from docengine.functions.names import unused

SCHEMA = "chunk_index int, chunk_type string, content string, start_char int, end_char int, truncated boolean"


def chunk(df: DataFrame, strategy: str = "structure_aware", size: int = 1024, overlap: int = 200, least: int = 100, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ("source",),
          distance: Callable[[list[str]], list[float]] = S.word_distances, percentile: float = 50.0) -> DataFrame:
    """id, keep, chunk_id and the columns of SCHEMA. Null and blank texts have no chunks."""
    strategies: dict[str, Callable[[str], list[S.Chunk]]] = {
        "structure_aware": lambda t: S.chunk_structure(t, size, overlap, least),
        "semantic": lambda t: S.chunk_semantic(t, distance, percentile),
        "sentence": lambda t: S.chunk_sentence(t, size),
    }
    split = strategies.get(strategy, lambda t: S.chunk_length(t, size, overlap))
    body, = unused([id, *keep], "text")
    rows = df.select(id, *keep, F.col(text).alias(body))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                at, found = [], []
                for i, t in enumerate(batch.column(len(names)).to_pylist()):
                    for c in split(t) if t and t.strip() else ():
                        at.append(i)
                        found.append(c)
                taken = batch.take(pa.array(at, pa.int64()))
                made = [pa.array([c.index for c in found], pa.int32()), pa.array([c.kind for c in found], pa.string()), pa.array([c.content for c in found], pa.string()),
                        pa.array([c.start for c in found], pa.int32()), pa.array([c.end for c in found], pa.int32()), pa.array([c.truncated for c in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*taken.columns[:-1], *made], [*names, "chunk_index", "chunk_type", "content", "start_char", "end_char", "truncated"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    made = rows.mapInArrow(run, f"{head}, {SCHEMA}")
    return made.withColumn("chunk_id", F.substring(F.md5(F.concat_ws("_", F.col(id).cast("string"), F.col("chunk_index").cast("string"))), 1, 16))


def fixed_windows(df: DataFrame, size: int, stride: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Windows at a fixed stride, built in: id, chunk_index, content. Ends at the end of the text."""
    n = F.length(text)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / stride) + 1).cast("int")
    rows = df.where(n > 0).select(id, F.col(text).alias("t"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    return rows.select(id, "chunk_index", F.substring(F.col("t"), F.col("chunk_index") * stride + 1, F.lit(size)).alias("content"))


def dedup_in_document(chunks: DataFrame, id: str = "doc_id") -> DataFrame:
    """Adds group_id; of each group in a document the first chunk stays. Charts and chunks without a group stay."""
    marked = chunks.withColumn("group_id", T.dedup_group_id(F.col("content"), F.col("chunk_type")))
    first, n = F.row_number().over(Window.partitionBy(id, "group_id").orderBy("chunk_index")), unused(marked.columns, "n")[0]
    return marked.withColumn(n, first).where((F.col(n) == 1) | (F.col("group_id") == "") | (F.col("chunk_type") == "chart")).drop(n)


def parents(chunks: DataFrame, most: int = 2400, id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chunks with parent, parents): neighbours of a document packed while at most `most` characters.

    Only the lengths of a document's chunks come together, as an array, and are numbered in one walk; chart chunks and
    blank ones have no parent."""
    size, = unused(chunks.columns, "size")
    used = chunks.where((F.col("chunk_type") != "chart") & (T.strip(F.col("content")) != "")).withColumn(size, F.length(T.strip(F.col("content"))))
    lengths = used.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col(size).alias("size")))).alias("l"))
    kind = chunks.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, numbers = [], [], []
            for i, row in enumerate(batch.column(1).to_pylist()):
                number, held = -1, 0
                for x in row:
                    if number < 0 or held + 2 + x["size"] > most:
                        number, held = number + 1, x["size"]
                    else:
                        held += 2 + x["size"]
                    at.append(i), places.append(x["chunk_index"]), numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), pa.array(numbers, pa.int32())], [id, "chunk_index", "number"])

    numbers = lengths.select(id, "l").mapInArrow(run, f"`{id}` {kind}, chunk_index int, number int")
    name = F.concat(F.lit("parent_"), F.col(id).cast("string"), F.lit("_"), F.col("number").cast("string"))
    placed = chunks.join(numbers, [id, "chunk_index"], "left").withColumn("parent", F.when(F.col("number").isNotNull(), name)).drop("number")
    return placed, passages(placed, id)


def passages(placed: DataFrame, id: str = "doc_id") -> DataFrame:
    """parent, id, source, content, n_chunks of chunks with their parent."""
    grouped = placed.where("parent IS NOT NULL").groupBy("parent", id).agg(F.array_sort(F.collect_list(F.struct("chunk_index", T.strip(F.col("content")).alias("c")))).alias("l"), F.first("source").alias("source"))
    return grouped.select("parent", id, "source", F.array_join(F.transform("l", lambda x: x["c"]), "\n\n").alias("content"), F.size("l").alias("n_chunks"))


def statistics(chunks: DataFrame) -> DataFrame:
    """total_chunks, total_chars, avg_chunk_size and the number of chunks by type; zeros without chunks."""
    by_type = chunks.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    total, chars = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_type", "n"))))
    return by_type.agg(total.alias("total_chunks"), chars.alias("total_chars"), F.when(total > 0, chars / total).otherwise(0.0).alias("avg_chunk_size"), types.alias("chunk_type_distribution"))


def chart_chunk(chart_id, name, kind, description, raw, most: int = 800):
    """The fixed text of a chart's chunk (column expressions): id, name, type, description and its data."""
    return F.concat_ws("\n", F.concat(F.lit("[Chart: "), chart_id, F.lit("]")), F.concat(F.lit("name: "), name), F.concat(F.lit("type: "), kind), F.concat(F.lit("description: "), description), F.concat(F.lit("data: "), F.substring(raw, 1, most)))


def chart_snippet(name, kind, description, legend, most: int = 240, keys: int = 12):
    """The summary put in place of a chart's image: name, type, description and legend keys."""
    return F.concat_ws("\n", F.concat(F.lit("[图表] "), name), F.concat(F.lit("type: "), kind), F.concat(F.lit("description: "), F.substring(description, 1, most)), F.concat(F.lit("legend: "), F.array_join(F.slice(legend, 1, keys), ", ")))
