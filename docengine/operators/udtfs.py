"""Hooks as table functions for SQL: chunkers and extraction with a TABLE argument.

    register(spark)
    SELECT doc_id, chunk_index, content FROM chunk(TABLE(documents), 'structure_aware', 1024)
    SELECT * FROM extract(TABLE(SELECT id, image FROM images) PARTITION BY (source), 'model')

The result has the columns of the table (without the text, for chunks) and those that the function adds: `analyze` works them out from
the table that is given. Models are named: `hooks` says what a name calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from docengine.functions import sequential as S

_CHUNK = [StructField("chunk_index", IntegerType()), StructField("chunk_type", StringType()), StructField("content", StringType()), StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), StructField("truncated", BooleanType())]


def _given(argument: AnalyzeArgument | None, default):
    return default if argument is None or argument.value is None else argument.value


def chunker(strategy: str, size: int, overlap: int, least: int) -> Callable[[str], list[S.Chunk]]:
    """The chunker of a strategy, as in `chunking.chunk`."""
    strategies = {
        "structure_aware": lambda t: S.chunk_structure(t, size, overlap, least),
        "semantic": lambda t: S.chunk_semantic(t, S.word_distances, 50.0),
        "sentence": lambda t: S.chunk_sentence(t, size),
        "length": lambda t: S.chunk_length(t, size, overlap),
    }
    if strategy not in strategies:
        raise ValueError(f"unknown strategy: {strategy}")
    return strategies[strategy]


class Chunks:
    """chunk(TABLE(t), strategy, size, overlap, least, text): a row for each chunk of each text; null and blank texts have none."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, strategy: AnalyzeArgument = None, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None, least: AnalyzeArgument = None, text: AnalyzeArgument = None) -> AnalyzeResult:
        name = _given(text, "text")
        if not rows.isTable or name not in rows.dataType.names:
            raise ValueError(f"the first argument must be a table with a column {name}")
        chunker(_given(strategy, "structure_aware"), 1, 0, 0)
        return AnalyzeResult(schema=StructType([f for f in rows.dataType.fields if f.name != name] + _CHUNK))

    def eval(self, row: Row, strategy: str = "structure_aware", size: int = 1024, overlap: int = 200, least: int = 100, text: str = "text") -> Iterator[tuple]:
        given = row.asDict()
        body = given.pop(text)
        for c in chunker(strategy, size, overlap, least)(body) if body and body.strip() else ():
            yield (*given.values(), c.index, c.kind, c.content, c.start, c.end, c.truncated)


def extraction(hooks: dict[str, Callable[[str], dict | None]]) -> type:
    """extract(TABLE(t), model, image): each row with status (chart, non_chart, error), json and error of a named model hook."""

    class Extract:
        @staticmethod
        def analyze(rows: AnalyzeArgument, model: AnalyzeArgument, image: AnalyzeArgument = None) -> AnalyzeResult:
            if model.value not in hooks:
                raise ValueError(f"unknown model: {model.value}")
            if not rows.isTable or _given(image, "image") not in rows.dataType.names:
                raise ValueError("the first argument must be a table with the image's column")
            added = [StructField(n, StringType()) for n in ("status", "json", "error")]
            return AnalyzeResult(schema=StructType([*rows.dataType.fields, *added]))

        def eval(self, row: Row, model: str, image: str = "image") -> Iterator[tuple]:
            import json

            try:
                found = hooks[model](row[image])
                if not isinstance(found, dict):
                    raise ValueError("no object")
                status = "chart" if found.get("is_chart") is True else "non_chart"
                yield (*row, status, json.dumps(found, ensure_ascii=False), None)
            except Exception as e:  # noqa: BLE001  (the row carries it)
                yield (*row, "error", None, f"{type(e).__name__}: {e}")

    return Extract


def register(spark: SparkSession, hooks: dict[str, Callable[[str], dict | None]] | None = None) -> None:
    """chunk and, with hooks, extract in the SQL of this session."""
    spark.udtf.register("chunk", udtf(Chunks))
    if hooks:
        spark.udtf.register("extract", udtf(extraction(hooks)))
