"""Titles, content lists and HTML of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import markdown as M
from docengine.functions import text as T

# Elements of a rendered document.
SECTION = r"(?is)<section\b[^>]*>(.*?)</section>"
SECTION_TITLE = r"(?is)<h2\b[^>]*class=['\"]section-title['\"][^>]*>(.*?)</h2>"
SECTION_CONTENT = r"(?is)<div\b[^>]*class=['\"]section-content['\"][^>]*>(.*?)</div>"
CONTAINER = r"(?i)<div\b[^>]*class=['\"]chart-container['\"][^>]*\bid=['\"]([^'\"]+)['\"][^>]*>"
CONTAINER_CLASSES = ["class='chart-container'", 'class="chart-container"']
PARAGRAPH_START, PARAGRAPH_END = "(?i)<p>", "(?i)</p>"
SOURCES_TITLE = "参考来源"

LAYOUT = "struct<pdf_info:array<struct<preproc_blocks:array<struct<type:string,lines:array<struct<spans:array<struct<type:string,content:string>>>>>>>>>"
CONTENT_LIST = "array<struct<type:string,text:string,text_level:int,img_path:string,image_caption:array<string>>>"


def layout_title(layout: Column) -> Column:
    """Text of the first title block of a layout (JSON) that has any."""
    none = F.array().cast("array<string>")
    blocks = F.flatten(F.transform(F.filter(F.from_json(layout, LAYOUT)["pdf_info"], lambda p: p["preproc_blocks"].isNotNull()), lambda p: p["preproc_blocks"]))

    def title(b: Column) -> Column:
        spans = F.flatten(F.transform(F.filter(b["lines"], lambda x: x["spans"].isNotNull()), lambda x: x["spans"]))
        return T.collapse(F.array_join(F.transform(F.filter(spans, lambda s: s["type"] == "text"), lambda s: T.strip(s["content"])), " "))

    titles = F.transform(F.filter(blocks, lambda b: b["type"] == "title"), title)
    return F.get(F.filter(F.coalesce(titles, none), lambda t: t != ""), F.lit(0))


def markdown_title(md: Column) -> Column:
    """The heading that a text begins with; null if it begins otherwise."""
    line = T.strip(F.regexp_extract(T.lf(F.coalesce(md, F.lit(""))), r"(?U)\A\s*([^\n]*)", 1))
    return F.when(line.startswith("#"), F.nullif(T.strip(F.regexp_replace(line, "^#+", "")), F.lit("")))


def content_list_title(items: Column) -> Column:
    """The first text of level 1 in a content list (JSON)."""
    texts = F.filter(F.from_json(items, CONTENT_LIST), lambda x: (x["type"] == "text") & (x["text_level"] == 1) & x["text"].isNotNull())
    return F.get(F.filter(F.transform(texts, lambda x: T.collapse(x["text"])), lambda t: t != ""), F.lit(0))


def document_title(layout: Column, md: Column, items: Column, folder: Column) -> Column:
    """Title of the layout, else the text's first heading, else the content list's, else the folder's name."""
    return F.coalesce(layout_title(layout), markdown_title(md), content_list_title(items), folder)


def filter_content_list(items: Column, cleaned: Column) -> Column:
    """ARRAY of a content list's items (JSON) that stay: no image that the cleaned text does not use or that looks like a QR code, no noise text, nothing discarded."""
    name = lambda path: F.regexp_extract(path, "[^/]*$", 0)
    used = F.transform(F.regexp_extract_all(F.coalesce(cleaned, F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), name)

    def stays(x: Column, used: Column) -> Column:
        image = F.coalesce(x["img_path"], F.lit("")) != ""
        file = name(F.coalesce(x["img_path"], F.lit("")))
        captions = F.array_join(F.coalesce(x["image_caption"], F.array().cast("array<string>")), " ")
        kind = F.coalesce(x["type"], F.lit(""))
        return ~(image & (~F.array_contains(used, file) | T.is_qr(F.lit(""), captions, file))) & ~((kind == "text") & T.is_noise(F.coalesce(x["text"], F.lit("")))) & (kind != "discarded")

    return T.let(used, lambda u: F.filter(F.from_json(items, CONTENT_LIST), lambda x: stays(x, u)))


def escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def section_html(id: Column, title: Column, content: Column, sources: Column) -> Column:
    """One section: heading, content (HTML) and an ordered list of its sources, if it has any."""
    listed = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("<li>"), escaped(s), F.lit("</li>"))), "\n")
    cited = F.concat(F.lit(f"<div class='sources'>\n<h4>{SOURCES_TITLE}</h4>\n<ol>\n"), listed, F.lit("\n</ol>\n</div>\n"))
    head = F.concat(F.lit("<section id='"), escaped(id.cast("string")), F.lit("' class='section'>\n<h2 class='section-title'>"), escaped(title), F.lit("</h2>\n<div class='section-content'>"), content, F.lit("</div>\n"))
    return F.concat(head, F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, cited).otherwise(F.lit("")), F.lit("</section>"))


def document_html(sections: DataFrame, key: str, position: str, title: Column, style: str = "") -> DataFrame:
    """key, n_sections, html: the sections (columns key, position, id, title, content, sources) of each document in order.

    A document's sections are gathered in one row, as its HTML is one value."""
    rows = sections.select(key, F.struct(position, section_html(F.col("id"), F.col("title"), F.col("content"), F.col("sources")).alias("html")).alias("s"), title.alias("document_title"))
    grouped = rows.groupBy(key).agg(F.min("document_title").alias("t"), F.array_sort(F.collect_list("s")).alias("l"))
    head = F.concat(F.lit("<!DOCTYPE html>\n<html lang='zh-CN'>\n<head>\n<meta charset='UTF-8'>\n<meta name='viewport' content='width=device-width, initial-scale=1.0'>\n<title>"), escaped(F.col("t")), F.lit(f"</title>\n<style>\n{style}\n</style>\n</head>\n<body>\n<div class='container'>\n<h1 class='document-title'>"), escaped(F.col("t")), F.lit("</h1>\n"))
    return grouped.select(key, F.size("l").alias("n_sections"), F.concat(head, F.array_join(F.transform("l", lambda s: s["html"]), "\n"), F.lit("\n</div>\n</body>\n</html>")).alias("html"))


def text_at(html: Column) -> Column:
    """Place (from 1) of the first paragraph with a letter or digit in its text; 0 without one.

    Each part that ends in a paragraph's end is looked at once, from where its first paragraph begins."""
    parts = F.split(html, PARAGRAPH_END, -1)

    def part(s: Column, x: Column) -> Column:
        before = F.length(F.regexp_extract(x, f"(?s)^(.*?){PARAGRAPH_START}", 1))
        body = F.regexp_replace(x, f"(?s)^.*?{PARAGRAPH_START}", "")
        here = x.rlike(PARAGRAPH_START) & M.has_text(M.strip_tags(body))
        then = F.struct((s["at"] + F.length(x) + 4).alias("at"), F.when(here, s["at"] + before + 1).otherwise(0).alias("found"))
        return F.when(s["found"] > 0, s).otherwise(then)

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("found"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), zero, part, lambda s: s["found"])


def chart_at(html: Column) -> Column:
    """Place (from 1) of the first chart container, one in single quotes before any other; 0 without one."""
    single, double = (F.instr(html, x) for x in CONTAINER_CLASSES)
    return F.when(single > 0, single).otherwise(double)


def html_quality(html: Column) -> Column:
    """STRUCT of section_total, empty_sections, chart_containers, unresolved_anchors (distinct, sorted) and chart_before_text (titles of sections)."""

    def section(s: Column, i: Column) -> Column:
        content = F.regexp_extract(s, SECTION_CONTENT, 1)
        title = F.coalesce(F.nullif(M.strip_tags(F.regexp_extract(s, SECTION_TITLE, 1)), F.lit("")), F.concat(F.lit("SECTION_"), (i + 1).cast("string")))
        return T.let(content, lambda c: F.struct(title.alias("title"), M.has_text(M.strip_tags(c)).alias("has_text"), chart_at(c).alias("chart_at"), text_at(c).alias("text_at")))

    def titles(rows: Column, where) -> Column:
        return F.transform(F.filter(rows, where), lambda s: s["title"])

    def metrics(rows: Column) -> Column:
        anchors = F.regexp_extract_all(html, F.lit(r"(?i)\[Chart:\s*([^\]]+?)\s*\]"), F.lit(1))
        return F.struct(
            F.size(rows).alias("section_total"), titles(rows, lambda s: ~s["has_text"]).alias("empty_sections"), F.size(F.regexp_extract_all(html, F.lit(CONTAINER), F.lit(1))).alias("chart_containers"),
            F.array_sort(F.array_distinct(anchors)).alias("unresolved_anchors"), titles(rows, lambda s: (s["chart_at"] > 0) & (s["text_at"] > 0) & (s["chart_at"] < s["text_at"])).alias("chart_before_text"),
        )

    return T.let(F.transform(F.regexp_extract_all(html, F.lit(SECTION), F.lit(1)), section), metrics)
