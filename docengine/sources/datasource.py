"""Python data sources: logs of JSON lines (batch and stream) and folders of chart files.

    register(spark)
    spark.read.format("jsonl_log").option("keys", "source_image,status").load("/data/state.jsonl")
    spark.readStream.format("jsonl_log").load("/data/logs")
    spark.read.format("chart_folder").load("/data/workspace")

A log is a file or a folder of *.jsonl files that only grow at their ends. Files are cut into ranges of `range_bytes`; a line belongs to
the range that it begins in. Lines that are no JSON object are left out. Rows: file, offset (byte at which the line begins),
the string fields named in `keys` and the line itself; equality and IN filters on fields and files are applied while reading.
A stream's offset is the number of bytes of whole lines in each file.

The workers open files with Python, so paths are those of a file system that all machines mount.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

RANGE_BYTES = 8 << 20
#: Chart files of a task.
FILES = 2000


class Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def local(path: str) -> str:
    return re.sub("^file:(//)?(?=/)", "", path)


def files_of(path: str, ending: str = "*.jsonl") -> list[str]:
    path = local(path)
    return sorted(glob.glob(f"{path}/**/{ending}", recursive=True)) if os.path.isdir(path) else [path] if os.path.exists(path) else []


def ranges(file: str, begin: int, end: int, size: int) -> list[Range]:
    return [Range(file, at, min(end, at + size)) for at in range(begin, end, size)]


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the range."""
    with open(part.file, "rb") as f:
        at = part.begin
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # the rest of a line that began before
        while at < part.end:
            line = f.readline()
            if not line:
                return
            yield at, line
            at += len(line)


def whole_lines(file: str) -> int:
    """Bytes up to the end of the last line that is whole."""
    size = os.path.getsize(file)
    with open(file, "rb") as f:
        at = size
        while at > 0:
            begin = max(0, at - 65_536)
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            at = begin
    return 0


def rows_of(part: Range, keys: list[str], wanted: dict[str, set]) -> Iterator[tuple]:
    for at, line in lines_of(part):
        try:
            found = json.loads(line)
        except ValueError:
            continue
        if not isinstance(found, dict):
            continue
        values = {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in ((k, found.get(k)) for k in keys)}
        if all((values[k] if k in values else None) in some for k, some in wanted.items() if k != "file"):
            yield (part.file, at, *(values[k] for k in keys), line.decode("utf-8", "replace").rstrip("\r\n"))


class _Options:
    def __init__(self, options: dict, ending: str):
        self.path, self.ending = options["path"], ending
        self.keys = [k.strip() for k in options.get("keys", "").split(",") if k.strip()]
        self.size = int(options.get("range_bytes", RANGE_BYTES))


class LogReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options, self.wanted = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            named = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if named in (*self.options.keys, "file"):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[named] = self.wanted.get(named, some) & some
            else:
                yield f

    def partitions(self) -> list[Range]:
        files = [f for f in files_of(self.options.path, self.options.ending) if f in self.wanted.get("file", {f})]
        return [r for f in files for r in ranges(f, 0, os.path.getsize(f), self.options.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            yield from rows_of(partition, self.options.keys, self.wanted)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: whole_lines(f) for f in files_of(self.options.path, self.options.ending)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for f, size in sorted(end.items()) for r in ranges(f, start.get(f, 0), size, self.options.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            yield from rows_of(partition, self.options.keys, {})

    def commit(self, end: dict) -> None:
        pass


class JsonLines(DataSource):
    """Logs of JSON lines; options: path, keys (fields as string columns, by commas), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_log"

    def schema(self) -> str:
        return ", ".join(["file string", "offset long", *(f"`{k}` string" for k in _Options(dict(self.options), "").keys), "line string"])

    def reader(self, schema) -> LogReader:
        return LogReader(_Options(dict(self.options), "*.jsonl"))

    def streamReader(self, schema) -> LogStream:
        return LogStream(_Options(dict(self.options), "*.jsonl"))


class ChartReader(DataSourceReader):
    def __init__(self, path: str, folder: str):
        self.path, self.folder, self.wanted = path, folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("chart_id",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = some if self.wanted is None else self.wanted & some
            else:
                yield f

    def _names(self, entries) -> list[str]:
        return sorted(n for n in entries if n.endswith(".json") and not n.startswith(".") and (self.wanted is None or n[:-5] in self.wanted))

    def _folders(self) -> Iterator[tuple[str, list[str]]]:
        """Each folder with its files. A folder is listed once, and no file is looked at; hidden ones are left out."""
        root = local(self.path)
        if not os.path.isdir(root) and os.path.exists(root):
            file = os.path.basename(root)
            yield os.path.dirname(root), [file] if self.wanted is None or file[:-5] in self.wanted else []
        for at, inner, files in os.walk(root, followlinks=True):
            inner[:] = sorted(d for d in inner if not d.startswith("."))
            if not self.folder or f"/{os.path.relpath(at, root)}".endswith(f"/{self.folder}"):
                yield at, self._names(files)

    def partitions(self) -> list[InputPartition]:
        """About FILES files each: whole folders, which the task lists itself, and named files of larger ones."""
        parts, some, n = [], [], 0
        for folder, names in self._folders():
            for begin in range(0, len(names), FILES):
                named = names[begin : begin + FILES]
                whole = len(names) <= FILES and os.path.isdir(local(self.path))
                if n and n + len(named) > FILES:
                    parts.append(InputPartition(some))
                    some, n = [], 0
                some.append((folder, None if whole else named))
                n += len(named)
        return parts + [InputPartition(some)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file in (f"{folder}/{n}" for folder, named in partition.value for n in (self._names(os.listdir(folder)) if named is None else named)):
            with open(file, "rb") as f:
                text = f.read().decode("utf-8-sig", "replace")
            try:
                found = json.loads(text)
            except ValueError:
                continue
            if isinstance(found, dict) and found.get("is_chart") is True:
                yield (file, os.path.basename(file)[:-5], found.get("_source_image"), found.get("chart_type"), text)


class ChartFolder(DataSource):
    """Chart files below a folder: path, chart_id (the stem), source_image, chart_type, json; others than charts are left out.

    Options: path; folder (only files in folders of that name, default all)."""

    @classmethod
    def name(cls) -> str:
        return "chart_folder"

    def schema(self) -> str:
        return "path string, chart_id string, source_image string, chart_type string, json string"

    def reader(self, schema) -> ChartReader:
        return ChartReader(self.options["path"], self.options.get("folder", ""))


def register(spark: SparkSession) -> None:
    """Both sources in this session; filters reach them only with the setting that is turned on here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (JsonLines, ChartFolder):
        spark.dataSource.register(source)
