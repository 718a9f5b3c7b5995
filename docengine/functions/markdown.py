"""Markdown and HTML text functions as column expressions: outlines, sections, placeholders, headings, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.text import WHITE, lf, lines, strip

# Forms of outline lines and of chart anchors.
LIST_ITEM = r"^(\s*)(?:[-*]\s+|\d+[.)]\s+)(.*)$"
HEAD_ITEM = r"^(\s*)(#{3,6})\s+(.+)$"
BARE_ITEM = r"^(\s*)(\d+(?:\.\d+)+)\s+(.+)$"
NUMBERED = r"^(\d+(?:\.\d+)*)\s+(.*)$"
ANCHOR = r"\[Chart:\s*([^\]]+?)\s*\]"
GLOSSARY = r"(?i)glossary|术语"


def outline_item(line: Column) -> Column:
    """STRUCT<raw, number, title, depth> of an outline line; null for another line.

    List items count four spaces of indent a level, headings their hashes beyond two, bare numbers their dots."""

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract(line, f"(?U){pattern}", n)

    def levels(pattern: str) -> Column:
        return F.floor(F.length(group(pattern, 1)) / 4)

    is_list, is_head, is_bare = (line.rlike(f"(?U){p}") for p in (LIST_ITEM, HEAD_ITEM, BARE_ITEM))
    number = group(BARE_ITEM, 2)
    raw = F.when(is_list, strip(group(LIST_ITEM, 2))).when(is_head, strip(group(HEAD_ITEM, 3))).when(is_bare, F.concat(number, F.lit(" "), strip(group(BARE_ITEM, 3))))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    depth = F.when(is_list, 1 + levels(LIST_ITEM)).when(is_head, F.greatest(F.lit(1), F.length(group(HEAD_ITEM, 2)) - 2) + levels(HEAD_ITEM)).when(is_bare, F.greatest(F.lit(1), dots) + levels(BARE_ITEM))
    found = F.regexp_extract(raw, f"(?U){NUMBERED}", 1)
    title = F.when(found != "", strip(F.regexp_extract(raw, f"(?U){NUMBERED}", 2))).otherwise(raw)
    return F.when(title != "", F.struct(raw.alias("raw"), F.nullif(found, F.lit("")).alias("number"), title.alias("title"), depth.cast("int").alias("depth")))


def outline_items(section: Column) -> Column:
    """ARRAY of the outline items of a section, in order."""
    return F.filter(F.transform(lines(lf(section)), outline_item), lambda x: x.isNotNull())


def display(item: Column) -> Column:
    return F.concat_ws(" ", item["number"], item["title"])


def skeleton(items: Column) -> Column:
    """Indented list of the items, with an indented empty line for the text of each."""

    def two(it: Column) -> Column:
        indent = F.repeat(F.lit("    "), F.greatest(F.lit(0), it["depth"] - 1))
        return F.concat(F.rtrim(F.concat(indent, F.lit("- "), display(it))), F.lit("\n"), indent, F.lit("    "))

    return F.regexp_replace(F.array_join(F.transform(items, two), "\n"), r"\s+$", "")


def item_heading(shown: Column, depth: Column) -> Column:
    return strip(F.concat(F.lit("###"), F.repeat(F.lit("#"), F.greatest(F.lit(0), depth - 1)), F.lit(" "), strip(shown)))


def source_block(shown: Column, content: Column, most: int, ends: str = WHITE) -> Column:
    """【来源】 heading and the content, shortened with an ellipsis; neither has characters of `ends` at its ends."""
    body = F.btrim(content, F.lit(ends))
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("…"))).otherwise(body)
    return F.btrim(F.concat(F.lit("【来源】"), F.coalesce(shown, F.lit("")), F.lit("\n"), cut), F.lit(ends))


def outline_query(section: Column, above: Column, item: Column) -> Column:
    """Search text of an item: section, titles above it, item; an appendix or glossary takes the section alone."""
    plain = F.concat_ws(" ", section, F.array_join(above, " "), item)
    return F.when(section.rlike(f"{GLOSSARY}|(?i)appendix|附录"), section).otherwise(strip(plain))


def sections(md: Column) -> Column:
    """ARRAY<STRUCT<title, body>> of the parts that begin with '## '; what stands before the first is left out."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), lf(md)), "\n## ", -1), 2, 1_000_000)
    return F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "\n", 1)).alias("title"), strip(F.regexp_replace(p, r"\A[^\n]*\n?", "")).alias("body")))


def placeholders(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{\{\s*([^}]+?)\s*\}\}"), F.lit(1))


def template_check(content: Column) -> Column:
    """STRUCT<status, placeholders, has_heading>: dangling {{ or empty is an error, no heading a warning."""
    dangling = content.rlike(r"\{\{[^}]*$")
    heading = F.exists(lines(content), lambda x: x.startswith("#"))
    status = F.when(dangling | (strip(content) == ""), "error").when(~heading, "warning").otherwise("passed")
    return F.struct(status.alias("status"), F.size(placeholders(content)).alias("placeholders"), heading.alias("has_heading"))


def polish_ok(original: Column, polished: Column) -> Column:
    """List lines are the same and every outline line is still there."""

    def listed(x: Column) -> Column:
        return F.filter(F.transform(lines(lf(x)), strip), lambda r: r.rlike(r"^(?:[-*]|\d+[.)])\s"))

    def heads(x: Column) -> Column:
        return F.filter(F.transform(lines(lf(x)), strip), lambda r: r.startswith("#"))

    return (listed(original) == listed(polished)) & (F.size(F.array_except(heads(original), heads(polished))) == 0)


def chart_id_of(text: Column) -> Column:
    """The id of a [Chart: id] first line; null otherwise."""
    first = strip(F.substring_index(strip(lf(text)), "\n", 1))
    return F.nullif(strip(F.regexp_extract(first, r"^\[Chart:(.*)\]$", 1)), F.lit(""))


def anchor_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(1))


def strip_tags(html: Column) -> Column:
    """Text without scripts, styles and tags, common entities decoded, white space collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def has_text(text: Column) -> Column:
    return text.rlike("[A-Za-z0-9一-鿿]")


def drop_glossary_placeholders(md: Column) -> Column:
    """Without lines that only promise a glossary."""
    return F.array_join(F.filter(lines(md), lambda x: ~x.rlike(r"(?i)^\s*[（(\[]?\s*(?:glossary|术语表?)\s*(?:to be added|待补充|placeholder)\s*[)）\]]?\s*$")), "\n")
