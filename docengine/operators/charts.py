"""Chart JSON: types, normalization, series points and flat records; cycles of flow charts.

Payloads are objects or lists; each is read once with a schema for either form, and what the other form lacks is
null. Everything is built in, but the search for cycles, which walks one chart's links in Python.
"""

from __future__ import annotations

import json as _json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.sequential import find_cycle
from docengine.functions.text import strip

# Other names of chart types, by type; the types; the series names used where none is given.
ALIASES = {
    "bar": ["bar", "bar_chart", "column", "column_chart", "histogram"],
    "line": ["line", "line_chart"],
    "pie": ["pie", "pie_chart", "donut", "donut_chart"],
    "stacked_area": ["stacked_area", "stacked_area_chart_with_legend", "area", "area_chart"],
    "sankey": ["sankey", "flow", "flow_chart_with_categories", "process_flow", "process_flow_chart", "process_flow_diagram", "flow_diagram"],
    "table": ["table", "table_chart", "comparison_table", "comparison_chart", "energy_storage_comparison_chart"],
    "scatter": ["scatter", "scatter_plot"],
    "heatmap": ["heatmap"],
    "radar": ["radar"],
    "unknown": ["unknown"],
    "none": ["none"],
}
DEFAULT_SERIES, VALUE_SERIES, SHARE_SERIES = "系列", "数值", "占比"
PATH_TYPES = ["table", "bar", "line", "pie", "scatter", "area", "radar", "heatmap"]

CHART = "schema_version int, is_chart string, chart_type string, _chart_name string, description string, title string, name string, chart_title string, chart_count int, chart_data string"
SERIES = "array<struct<name:string,values:array<string>>>"
OBJECT = f"struct<categories:array<string>,x:array<string>,x_axis:array<string>,labels:array<string>,values:array<string>,series:{SERIES},links:array<struct<source:string,target:string,value:string>>,nodes:array<string>,columns:array<string>,rows:array<map<string,string>>,points:array<struct<x:string,y:string,name:string>>,indicator:array<struct<name:string,max:string>>,x_labels:array<string>,y_labels:array<string>,matrix:array<array<string>>>"
LIST = "array<struct<category:string,label:string,name:string,value:string,series:string,_chart_separator:string,data_points:array<struct<time:string,value:string>>>>"


def to_bool(v: Column) -> Column:
    s = F.lower(strip(v.cast("string")))
    return F.when(s.isin("true", "1", "yes", "y"), True).when(s.isin("false", "0", "no", "n"), False)


def to_number(v: Column) -> Column:
    """A number without its commas, else the first number in the text; null without one."""
    s = F.replace(strip(v.cast("string")), F.lit(","), F.lit(""))
    return F.coalesce(F.when(s.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), s.try_cast("double")), F.regexp_extract(s, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double"))


def canonical_type(raw: Column, hint: Column | None = None) -> Column:
    names = F.create_map(*[F.lit(x) for kind, others in ALIASES.items() for o in others for x in (o, kind)])
    s = F.lower(strip(F.coalesce(raw, F.lit(""))))
    if hint is not None:
        s = F.when(s == "", F.lower(strip(F.coalesce(hint, F.lit(""))))).otherwise(s)
    return F.when(s == "", "unknown").otherwise(F.coalesce(F.try_element_at(names, s), F.lit("unknown")))


def type_of_image(kind: Column, path: Column) -> Column:
    said = F.lower(F.concat_ws(" ", kind, path))
    out = F.lit("other")
    for t in reversed(PATH_TYPES):
        out = F.when(said.contains(t), t).otherwise(out)
    return out


def normalized(json: Column, hint: Column | None = None, strict: bool = False) -> Column:
    """STRUCT of the controlled fields; strict fails without is_chart, or a chart without description or data."""
    c = F.from_json(json, CHART)
    chart = to_bool(c["is_chart"])
    filled = [F.nullif(strip(c[n]), F.lit("")) for n in ("description", "title", "name", "chart_title", "_chart_name")]
    text = F.coalesce(*filled, F.lit(""))
    fields = F.struct(
        F.coalesce(c["schema_version"], F.lit(1)).alias("schema_version"),
        chart.alias("is_chart"),
        F.when(chart, canonical_type(c["chart_type"], hint)).when(~chart, "none").otherwise(c["chart_type"]).alias("chart_type"),
        F.when(chart, text).when(~chart, "").otherwise(c["description"]).alias("description"),
        F.when(chart, F.coalesce(c["chart_count"], F.lit(1))).when(~chart, 0).alias("chart_count"),
        F.when(chart, F.coalesce(c["chart_data"], F.lit("{}"))).when(~chart, "[]").otherwise(c["chart_data"]).alias("chart_data"),
    )
    if not strict:
        return fields
    wrong = F.when(chart.isNull(), "is_chart is missing or illegal").when(chart & (text == ""), "a chart without description").when(chart & c["chart_data"].isNull(), "a chart without chart_data")
    return F.when(wrong.isNull(), fields).otherwise(F.raise_error(wrong).cast(f"struct<schema_version:int,is_chart:boolean,chart_type:string,description:string,chart_count:int,chart_data:string>"))


def parsed(df: DataFrame, json: str = "json", id: str = "chart_id") -> DataFrame:
    """id, chart_type, title, obj, list of the rows that are charts."""
    c = F.from_json(F.col(json), CHART)
    rows = df.select(id, c.alias("c")).where(to_bool(F.col("c.is_chart")))
    title = F.coalesce(F.nullif(strip(F.col("c.description")), F.lit("")), F.nullif(strip(F.col("c._chart_name")), F.lit("")), F.lit("图表"))
    data = F.trim("c.chart_data")
    return rows.select(
        id, canonical_type(F.col("c.chart_type")).alias("chart_type"), title.alias("title"), F.when(data.startswith("{"), F.from_json(data, OBJECT)).alias("obj"), F.when(data.startswith("["), F.from_json(data, LIST)).alias("list")
    )


_POINT = "array<struct<series:string,x:string,y:double,s:int,i:int>>"


def _named(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(default))


def _grid(axis: Column, series: Column, most: int) -> Column:
    """Points of each of the first series at each label; values beyond the end are null."""
    labels = F.filter(F.transform(axis, strip), lambda x: x != "")

    def one(s: Column, k: Column) -> Column:
        return F.transform(labels, lambda x, i: F.struct(_named(s["name"], DEFAULT_SERIES).alias("series"), x.alias("x"), to_number(F.get(s["values"], i)).alias("y"), k.alias("s"), i.alias("i")))

    valid = F.slice(F.filter(series, lambda s: s["values"].isNotNull()), 1, most)
    return F.flatten(F.transform(valid, one)).cast(_POINT)


def _pairs(items: Column, label, series: str) -> Column:
    kept = F.filter(items, lambda x: x["_chart_separator"].isNull() & label(x).isNotNull())
    return F.transform(kept, lambda x, i: F.struct(F.lit(series).alias("series"), label(x).alias("x"), to_number(x["value"]).alias("y"), F.lit(0).alias("s"), i.alias("i"))).cast(_POINT)


def _timelines(items: Column) -> Column:
    """Points of each series at every time that any series has, in order of first mention."""
    times = F.array_distinct(F.filter(F.flatten(F.transform(items, lambda s: F.transform(F.coalesce(s["data_points"], F.array()), lambda p: strip(p["time"])))), lambda t: t != ""))

    def one(s: Column, k: Column) -> Column:
        def at(t: Column, i: Column) -> Column:
            last = F.element_at(F.filter(s["data_points"], lambda p: strip(p["time"]) == t), -1)
            there = F.exists(s["data_points"], lambda p: strip(p["time"]) == t)
            return F.struct(_named(F.coalesce(s["series"], s["name"]), DEFAULT_SERIES).alias("series"), t.alias("x"), F.when(there, to_number(last["value"])).alias("y"), k.alias("s"), i.alias("i"))

        return F.transform(times, at)

    return F.flatten(F.transform(F.slice(F.filter(items, lambda s: s["data_points"].isNotNull()), 1, 8), one)).cast(_POINT)


def _cells(matrix: Column, across: Column, down: Column) -> Column:
    """Points of a heatmap's cells (column, row, value): x and series are the labels of column and row, else their numbers."""
    number = lambda v: to_number(v).cast("int")
    name = lambda labels, v: F.coalesce(F.nullif(strip(F.get(labels, number(v))), F.lit("")), number(v).cast("string"))
    whole = F.filter(matrix, lambda c: (F.size(c) >= 3) & to_number(c[0]).isNotNull() & to_number(c[1]).isNotNull())
    return F.transform(whole, lambda c: F.struct(name(down, c[1]).alias("series"), name(across, c[0]).alias("x"), to_number(c[2]).alias("y"), number(c[1]).alias("s"), number(c[0]).alias("i"))).cast(_POINT)


def series_points(df: DataFrame, json: str = "json", id: str = "chart_id") -> DataFrame:
    """id, chart_type, title, series, x, y (null where it is missing), s, i of bar, line, pie, area, scatter, heatmap, radar and table charts."""
    rows = parsed(df, json, id)
    o, l, t = F.col("obj"), F.col("list"), F.col("chart_type")
    axis = F.coalesce(o["x"], o["x_axis"], o["categories"])
    pie = F.transform(F.coalesce(o["labels"], o["categories"]), lambda x, i: F.struct(F.lit(SHARE_SERIES).alias("series"), strip(x).alias("x"), to_number(F.get(o["values"], i)).alias("y"), F.lit(0).alias("s"), i.alias("i")))
    scatter = F.transform(o["points"], lambda p, i: F.struct(F.coalesce(p["name"], F.lit("散点")).alias("series"), to_number(p["x"]).cast("string").alias("x"), to_number(p["y"]).alias("y"), F.lit(0).alias("s"), i.alias("i")))
    points = (
        F.when((t == "bar") & l.isNotNull(), _pairs(l, lambda x: x["category"], VALUE_SERIES))
        .when((t == "pie") & l.isNotNull(), _pairs(l, lambda x: F.coalesce(x["label"], x["category"]), SHARE_SERIES))
        .when((t == "line") & l.isNotNull(), _timelines(l))
        .when(t == "line", _grid(axis, o["series"], 8))
        .when((t == "pie") & (F.coalesce(F.size(F.coalesce(o["labels"], o["categories"])), F.lit(0)) > 0), F.filter(pie, lambda x: x["x"] != "").cast(_POINT))
        .when(t == "scatter", F.filter(scatter, lambda x: x["x"].isNotNull() & x["y"].isNotNull()).cast(_POINT))
        .when(t == "heatmap", _cells(o["matrix"], o["x_labels"], o["y_labels"]))
        .when(t == "radar", _grid(F.transform(o["indicator"], lambda x: x["name"]), o["series"], 10))
        .otherwise(_grid(F.coalesce(o["categories"], o["x"]), o["series"], 8))
    )
    return rows.where(~t.isin("none", "sankey")).select(id, "chart_type", "title", F.explode(points).alias("p")).select(id, "chart_type", "title", "p.*")


def flat_records(df: DataFrame, json: str = "json", id: str = "chart_id") -> DataFrame:
    """id, x, series, y of the points that have a value. An area chart's last label goes if it repeats the first."""
    p = series_points(df, json, id)
    ends = parsed(df, json, id).where("chart_type = 'stacked_area'").select(id, F.coalesce(F.col("obj.x"), F.col("obj.categories")).alias("a")).where("size(a) > 1 AND trim(a[0]) = trim(element_at(a, -1))")
    kept = p.join(ends.select(id, (F.size("a") - 1).alias("last")), id, "left").where("last IS NULL OR i != last")
    return kept.where("y IS NOT NULL").select(id, "x", "series", "y")


def table_cells(df: DataFrame, json: str = "json", id: str = "chart_id") -> DataFrame:
    """id, position (of the row), column, value of table charts: their columns in order, the cells of each row by name."""
    rows = parsed(df, json, id).where("chart_type = 'table' AND obj.columns IS NOT NULL").select(id, F.col("obj.columns").alias("columns"), F.posexplode("obj.rows").alias("position", "r"))
    cells = rows.select(id, "position", "r", F.explode(F.filter(F.transform("columns", strip), lambda c: c != "")).alias("column"))
    return cells.select(id, "position", "column", F.try_element_at("r", F.col("column")).alias("value"))


def links(df: DataFrame, json: str = "json", id: str = "chart_id") -> DataFrame:
    """id, source, target, value (1 where it is no number) of flow charts; links without an end go."""
    rows = parsed(df, json, id).where("chart_type = 'sankey'").select(id, F.posexplode(F.col("obj.links")).alias("position", "l"))
    s, t = strip(F.col("l.source")), strip(F.col("l.target"))
    return rows.where((s != "") & (t != "")).select(id, "position", s.alias("source"), t.alias("target"), F.coalesce(to_number(F.col("l.value")), F.lit(1.0)).alias("value"))


def cycles(df: DataFrame, json: str = "json", id: str = "chart_id") -> DataFrame:
    """id, render_type (graph with a cycle, else sankey), links_count, nodes_count, cycle (its nodes, '>' between)."""
    found = links(df, json, id)
    by = found.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("position", "source", "target"))).alias("l"))
    rows = by.select(id, F.transform("l", lambda x: x["source"]).alias("s"), F.transform("l", lambda x: x["target"]).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = [list(zip(s, t)) for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            loops = [find_cycle(e) for e in edges]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(["graph" if c else "sankey" for c in loops]), pa.array([len(e) for e in edges], pa.int64()), pa.array([len({n for x in e for n in x}) for e in edges], pa.int64()), pa.array([">".join(c) if c else None for c in loops], pa.string())],
                [id, "render_type", "links_count", "nodes_count", "cycle"],
            )

    return rows.mapInArrow(run, f"`{id}` {rows.schema[id].dataType.simpleString()}, render_type string, links_count long, nodes_count long, cycle string")


_SPAN = "array<struct<content:string,text:string,image_path:string>>"
LAYOUT = f"struct<pdf_info:array<struct<preproc_blocks:array<struct<type:string,blocks:array<struct<type:string,group_id:double,content:string,lines:array<struct<spans:{_SPAN}>>>>>>>>>"


def layout_captions(df: DataFrame, layout: str, id: str = "doc_id") -> DataFrame:
    """id, image_path, caption of each image in nested layouts (JSON): its first block counts.

    A caption joins the different texts of the block's captions and titles that have the image's group number, or where
    one of the two has none; null without one."""

    def said(b: Column) -> Column:
        spans = F.flatten(F.transform(F.filter(F.coalesce(b["lines"], F.array().cast(f"array<struct<spans:{_SPAN}>>")), lambda x: x["spans"].isNotNull()), lambda x: x["spans"]))
        parts = F.transform(spans, lambda s: F.coalesce(F.nullif(strip(s["content"]), F.lit("")), F.nullif(strip(s["text"]), F.lit(""))))
        return F.coalesce(F.nullif(strip(b["content"]), F.lit("")), F.array_join(F.filter(parts, lambda p: p.isNotNull()), " "))

    pages = df.select(id, F.posexplode(F.from_json(layout, LAYOUT)["pdf_info"]).alias("page", "p"))
    blocks = pages.select(id, "page", F.posexplode("p.preproc_blocks").alias("at", "b")).where("b.type = 'image' AND b.blocks IS NOT NULL").select(id, "page", "at", F.col("b.blocks").alias("parts"))
    bodies = blocks.select("*", F.posexplode(F.filter("parts", lambda b: b["type"] == "image_body")).alias("n", "body"))
    images = bodies.select(id, "page", "at", "n", "parts", F.col("body.group_id").alias("group"), F.explode("body.lines").alias("l")).select(id, "page", "at", "n", "parts", "group", F.explode("l.spans").alias("s"))
    texts = F.transform(F.filter("parts", lambda b: b["type"].isin("image_caption", "image_title") & F.coalesce(b["group_id"] == F.col("group"), F.lit(True))), said)
    caption = F.nullif(F.array_join(F.array_distinct(F.filter(texts, lambda t: t != "")), " "), F.lit(""))
    named = images.select(id, strip(F.col("s.image_path")).alias("image_path"), F.struct("page", "at", "n", caption.alias("caption")).alias("c")).where("image_path != ''")
    return named.groupBy(id, "image_path").agg(F.min("c").alias("c")).select(id, "image_path", "c.caption")


def chart_name(layout: Column, described: Column, alt: Column, heading: Column, kind: Column) -> Column:
    """The first name that is not blank: layout, description, alternative text, heading, type."""
    return F.coalesce(*[F.nullif(strip(x), F.lit("")) for x in (layout, described, alt, heading, kind)])


def extract(df: DataFrame, model: Callable[[str], dict | None], image: str) -> DataFrame:
    """df with status (chart, non_chart, error), json and error of a model hook for each image; failures are rows."""
    names = df.columns
    at = names.index(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, answers, errors = [], [], []
            for value in b.column(at).to_pylist():
                try:
                    found = model(value)
                    status.append("chart" if found and found.get("is_chart") is True else "non_chart")
                    answers.append(_json.dumps(found) if found else None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  (the row carries it)
                    status.append("error")
                    answers.append(None)
                    errors.append(str(e)[:400])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(status), pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*names, "status", "json", "error"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{head}, status string, json string, error string")


def options(points: DataFrame, id: str = "chart_id") -> DataFrame:
    """option (JSON: title, labels, series) and block (an HTML container with it) of each chart."""
    one = points.groupBy(id, "chart_type", "title", "s", "series").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    data = F.struct("s", F.col("series").alias("name"), F.transform("p", lambda q: q["x"]).alias("labels"), F.transform("p", lambda q: q["y"]).alias("data"))
    by = one.groupBy(id, "chart_type", "title").agg(F.array_sort(F.collect_list(data)).alias("all"))
    shown = F.transform("all", lambda x: F.struct(x["name"].alias("name"), F.col("chart_type").alias("type"), x["data"].alias("data")))
    option = F.to_json(F.struct(F.struct(F.col("title").alias("text")).alias("title"), F.struct(F.col("all")[0]["labels"].alias("data")).alias("xAxis"), shown.alias("series")))
    rows = by.select(id, option.alias("option"))
    safe = F.replace(F.col("option"), F.lit("</"), F.lit("<\\/"))
    return rows.withColumn("block", F.concat(F.lit("<div class='chart-container' id='"), F.col(id).cast("string"), F.lit("'><script type='application/json'>"), safe, F.lit("</script></div>")))
