"""Charts of documents: ids of the charts that a text names, and their summaries put below their images.

Charts are rows (doc, stem, json): the document they belong to, the name of their file without its ending, and their
JSON. A text names a chart by an image below `images/` whose file has the chart's stem, or by a summary line with its
name. Both keys are equal joins on (doc, kind of key, key); rows of one text only gather their own ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import markdown as M
from docengine.functions import text as T
from docengine.operators import charts as C
from docengine.operators import chunking, hybrid, setjoin
from docengine.sources.tables import kept

# Forms of an image reference and of a chart's summary line.
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
SUMMARY = r"(?m)^\[图表\]\s*(.+?)\s*$"


def chart_node(stem: Column) -> Column:
    """Id of a chart's chunk; a stem without a usable character gives the digest of the stem."""
    plain = F.regexp_replace(F.regexp_replace(T.strip(stem), "[^0-9a-zA-Z_-]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("chart_"), F.when(plain == "", F.substring(F.md5(stem), 1, 12)).otherwise(plain))


def stem_of(reference: Column) -> Column:
    """File name without its last ending of a reference below images/; null for another one."""
    path = T.normalize_path(reference)
    return F.when(path.startswith("images/"), F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"(?<=.)\.[^.]*$", ""))


def usable(charts: DataFrame, doc: str = "doc_id", stem: str = "stem", json: str = "json") -> DataFrame:
    """doc, stem, node, name, kind, description, legend, data of the rows that are charts, each (doc, stem) once."""
    c = F.from_json(F.col(json), C.CHART)
    rows = charts.select(F.col(doc).alias("doc"), F.col(stem).alias("stem"), c.alias("c")).where(C.to_bool(F.col("c.is_chart")) & F.col("stem").isNotNull())
    name = F.coalesce(*[F.nullif(T.strip(F.col(f"c.{n}")), F.lit("")) for n in ("_chart_name", "name")], F.lit(""))
    series = F.from_json("c.chart_data", "series array<struct<name:string>>")["series"]
    legend = F.filter(F.transform(F.coalesce(series, F.array().cast("array<struct<name:string>>")), lambda s: s["name"]), lambda x: x.isNotNull())
    rows = rows.select("doc", "stem", F.struct(name.alias("name"), C.canonical_type(F.col("c.chart_type")).alias("kind"), F.coalesce("c.description", F.lit("")).alias("description"), legend.alias("legend"), F.coalesce("c.chart_data", F.lit("{}")).alias("data")).alias("v"))
    return rows.groupBy("doc", "stem").agg(F.min("v").alias("v")).select("doc", "stem", chart_node(F.col("stem")).alias("node"), "v.*")


def lookup(charts: DataFrame) -> DataFrame:
    """doc, kind, key, node: every usable chart by its stem and, the first stem of a name, by its compact name."""
    by_stem = charts.select("doc", F.lit("stem").alias("kind"), F.col("stem").alias("key"), "node")
    named = charts.where("name != ''").groupBy("doc", T.norm_compact(F.col("name")).alias("key")).agg(F.min(F.struct("stem", "node")).alias("first"))
    return by_stem.unionByName(named.select("doc", F.lit("name").alias("kind"), "key", F.col("first.node").alias("node")))


def chart_ids(texts: DataFrame, charts: DataFrame, key: str, text: str = "content", doc: str = "doc_id") -> DataFrame:
    """`key` (the texts' id, of another name than doc, kind, key and node), chart_ids array<string> (sorted, distinct) of the texts that name charts. charts: as from `usable`."""
    stems = F.transform(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), lambda r: F.struct(F.lit("stem").alias("kind"), stem_of(r).alias("key")))
    names = F.transform(F.regexp_extract_all(text, F.lit(SUMMARY), F.lit(1)), lambda n: F.struct(F.lit("name").alias("kind"), T.norm_compact(n).alias("key")))
    asked = texts.select(key, F.col(doc).alias("doc"), F.explode(F.array_distinct(F.concat(stems, names))).alias("r")).select(key, "doc", "r.kind", "r.key")
    found = asked.join(lookup(charts), ["doc", "kind", "key"])
    return found.groupBy(key).agg(F.array_sort(F.collect_set("node")).alias("chart_ids"))


def inject_summaries(docs: DataFrame, charts: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs with each chart's summary on a line of its own below its image, and n_injected; rows without charts stay as they are.

    Only image lines join the charts; lines and summaries of a text merge by one sort."""
    lines = T.lines(T.lf(F.col(text)))
    images = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), stem_of(F.nullif(F.regexp_extract(x, IMAGE, 1), F.lit(""))).alias("stem"))), lambda r: r["stem"].isNotNull())
    summary = chunking.chart_snippet(F.col("name"), F.col("kind"), F.col("description"), F.col("legend"))
    rows = docs.select(F.col(id).alias("doc"), F.xxhash64(text).alias("mark"), F.explode(images).alias("r")).select("doc", "mark", "r.at", "r.stem").distinct()
    put = rows.join(charts.select("doc", "stem", summary.alias("summary")), ["doc", "stem"])
    put = put.groupBy("doc", "mark").agg(F.collect_list(F.struct(F.col("at").alias("at"), F.lit(1).alias("n"), F.col("summary").alias("line"))).alias("__put"))
    marked = docs.withColumns({"__doc": F.col(id), "__mark": F.xxhash64(text)}).join(put.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), "__put"), ["__doc", "__mark"], "left")
    own = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.lit(0).alias("n"), x.alias("line")))
    merged = F.array_join(F.transform(F.array_sort(F.concat(own, F.col("__put"))), lambda r: r["line"]), "\n")
    columns = [F.when(F.col("__put").isNull(), F.col(c)).otherwise(merged).alias(c) if c == text else F.col(c) for c in docs.columns]
    return marked.select(*columns, F.when(F.col("__put").isNull(), 0).otherwise(F.size("__put")).alias("n_injected"))


#: How a chart is found, in order of trust.
RULES = ("image", "ids", "anchor", "name", "weak")
#: Least similarity of a hint and a chart's words for a weak match.
WEAK = 0.22


def resolve(hits: DataFrame, charts: DataFrame, most: int, hints: DataFrame | None = None) -> DataFrame:
    """query_id, doc, stem, reason, place, n (from 1) of the charts that the hits of each query bring, `most` at most.

    hits: query_id, place, doc_id, content, chart_ids (JSON list or commas); charts: as from `usable`. A chart is found by
    an image's stem, the hit's chart ids, an anchor or a summary's name; it comes once, with the first hit and rule.
    hints (query_id, hint), if given, let hits that name charts without finding one take the most similar one of their document.
    """
    plain = lambda x: F.regexp_replace(x, "^chart_", "")

    def asked(rule: str, kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k, i: F.struct(F.lit(RULES.index(rule)).alias("rule"), i.alias("at"), F.lit(kind).alias("kind"), k.alias("key")))

    text = F.coalesce("content", F.lit(""))
    images = F.filter(F.transform(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), stem_of), lambda x: x.isNotNull())
    names = F.transform(F.regexp_extract_all(text, F.lit(SUMMARY), F.lit(1)), T.norm_compact)
    ids = hybrid.parse_ids(F.coalesce("chart_ids", F.lit("")))
    refs = F.concat(asked("image", "stem", images), asked("ids", "stem", F.transform(ids, plain)), asked("anchor", "stem", F.transform(M.anchor_ids(text), plain)), asked("name", "name", names))
    keyed = lookup(charts).join(charts.select("doc", "stem", "node"), ["doc", "node"])
    found = hits.select("query_id", "place", F.col("doc_id").alias("doc"), F.explode(refs).alias("r")).select("query_id", "place", "doc", "r.*").join(keyed, ["doc", "kind", "key"]).select("query_id", "doc", "stem", "place", "rule", "at")
    if hints is not None:
        open_ = hits.where(text.rlike(IMAGE) | text.rlike(SUMMARY)).select("query_id", "place", F.col("doc_id").alias("doc")).join(found.select("query_id", "place").distinct(), ["query_id", "place"], "left_anti")
        first = open_.groupBy("query_id", "doc").agg(F.min("place").alias("place")).join(hints, "query_id")
        first = kept(first, "open-hits")
        named = setjoin.sets(charts, "stem", F.concat_ws(" ", "name", "description"), "doc")
        best = setjoin.best(setjoin.sets(first, "query_id", F.col("hint"), "doc"), named, WEAK)
        near = best.select(F.col("group").alias("doc"), F.col("a").alias("query_id"), F.col("b").alias("stem")).join(first.select("query_id", "doc", "place"), ["query_id", "doc"])
        found = found.unionByName(near.select("query_id", "doc", "stem", "place", F.lit(RULES.index("weak")).alias("rule"), F.lit(0).alias("at")))
    once = found.groupBy("query_id", "doc", "stem").agg(F.min(F.struct("place", "rule", "at")).alias("f"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("f", "doc", "stem"))).where(F.col("n") <= most)
    reason = F.get(F.array(*[F.lit(r) for r in RULES]), F.col("f.rule"))
    return ranked.select("query_id", "doc", "stem", reason.alias("reason"), F.col("f.place").alias("place"), "n")
