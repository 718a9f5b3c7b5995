"""Text functions as Spark column expressions (no Python in the plan).

Patterns carry the flags that give Unicode classes and line-feed-only line ends: (?U) for classes, (?m) for
anchors at lines, (?d) so that only line feeds end a line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the cleaning rules, in their order of application.
AD_PATTERNS = ["广告", "Sponsored", "广告位", "推广", "VIP", "开通会员", "扫码关注", "微信公众号", "客服电话", "咨询热线"]
NOISE_PATTERNS = [
    r"第\s*\d+\s*页",
    r"Page\s*\d+",
    r"^\s*[\d\-]+\s*$",
    r"^[-—=]{3,}$",
    r"版权声明",
    r"版权所有",
    r"联系电话：\d+",
    r"地址：",
    r"^目\s*录\s*$",
    r"^表\s*次\s*$",
    r"^目\s*次\s*$",
    r"^第[一二三四五六七八九十]+章",
    r"^第[一二三四五六七八九十]+节",
    r"^\d+[.、]\s+\S+.{0,30}$",
    r"^\s*\.{3,}\s*\d+\s*$",
]
HEAD_NOISE_PATTERNS = [r"^\s*(汇报人|报告人|主讲人|演讲人)\s*[:：].*$"]
HEAD_LINES = 80
STOP_TITLES = ["证券研究报告", "研究报告", "年度报告", "报告"]
PUNCTUATION = "，。；：、,.!?:;\"'“”‘’（）()【】\\[\\]{}<>"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
TOKEN = "[a-z0-9_]+|[、-〿㐀-䶿一-鿿]"
QR_WORDS = ["二维码", "扫码", "扫一扫", "公众号", "微信", "qrcode"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; written out, it would run wherever the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends. Only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE))


def lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


_BUT_BLANK = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space that is not one blank already.
_RUN = f"[{_BUT_BLANK}][ {_BUT_BLANK}]*+| [ {_BUT_BLANK}]++"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single blanks, nearly all, are not matched."""
    return F.trim(F.regexp_replace(text, _RUN, " "))


_LED = r"^\s*"


def remove(text: Column, patterns: Iterable[str], flags: str) -> Column:
    """Delete each pattern in turn.

    Where a pattern begins with the white space from a line's beginning on, runs of white space that nothing follows match
    too and are put back: the search goes on behind them, not on each of their lines again."""
    for p in patterns:
        led = p.startswith(_LED)
        text = F.regexp_replace(text, f"(?{flags})^\\s*+{p[len(_LED) :]}|^(?<run>\\s++)" if led else f"(?{flags}){p}", "${run}" if led else "")
    return text


def found(text: Column, pattern: str, flags: str) -> Column:
    """Whether a pattern stands in a text; white space that leads it is looked at on its own line alone, which finds the same."""
    return text.rlike(f"(?{flags})" + (f"^[\\s&&[^\n]]*+{pattern[len(_LED) :]}" if pattern.startswith(_LED) else pattern))


def remove_ads(text: Column) -> Column:
    return remove(text, AD_PATTERNS, "iu")


def remove_head_noise(text: Column, first: int = HEAD_LINES) -> Column:
    """Speaker lines, in the first lines only."""

    def line(x: Column, i: Column) -> Column:
        return F.when(i < first, remove(x, HEAD_NOISE_PATTERNS, "mdU")).otherwise(x)

    return F.array_join(F.transform(lines(text), line), "\n")


def remove_noise(text: Column) -> Column:
    return remove(text, NOISE_PATTERNS, "mdU")


def normalize_whitespace(text: Column) -> Column:
    """Blanks and tabs as one space, lines trimmed, at most one blank line in a row."""
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.array_join(F.transform(lines(text), strip), "\n")
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def dedup_lines(text: Column, keep_blank: bool = False) -> Column:
    """First occurrence of each line, by its trimmed lower-case form; blank lines go, unless kept.

    The lines are sorted by form and position, so that first ones differ from their neighbour, and back: n log n."""
    return F.array_join(F.transform(first_lines(text, keep_blank), lambda x: x["line"]), "\n")


def first_lines(text: Column, keep_blank: bool = False) -> Column:
    """ARRAY<STRUCT<pos, line>> of the lines that `dedup_lines` keeps."""
    every = F.transform(lines(text), lambda x, i: F.struct(F.lower(strip(x)).alias("form"), i.alias("pos"), x.alias("line")))
    filled = F.array_sort(F.filter(every, lambda x: x["form"] != ""))
    first = let(filled, lambda f: F.filter(F.transform(f, lambda x, i: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), (F.coalesce(F.get(f, i - 1)["form"], F.lit("")) != x["form"]).alias("first"))), lambda x: x["first"]))
    bare = lambda rows: F.transform(rows, lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line")))
    if keep_blank:
        return F.array_sort(F.concat(bare(first), bare(F.filter(every, lambda x: x["form"] == ""))))
    return F.array_sort(bare(first))


_BREAKS = WHITE + PUNCTUATION.replace("\\", "")


def normalize_for_fingerprint(text: Column) -> Column:
    """Lower case, punctuation and white space as single spaces; null and blank texts give an empty string."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), _BREAKS, " " * len(_BREAKS))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


#: First 16 hex digits of the MD5 of no text.
NO_TEXT = "d41d8cd98f00b204"


def fingerprint(text: Column, blank: str = "") -> Column:
    """First 16 hex digits of the MD5 of the normalized text; `blank` for an empty one."""
    return let(normalize_for_fingerprint(text), lambda norm: F.when(norm == "", F.lit(blank)).otherwise(F.substring(F.md5(F.encode(norm, "UTF-8")), 1, 16)))


def dedup_group_id(text: Column, chunk_type: Column, chart_id: Column | None = None, blank: str = "") -> Column:
    """chart:<id>, <type>:<fingerprint> or <fingerprint>; empty without content, unless `blank` is the fingerprint of none."""
    kind = F.lower(strip(F.coalesce(chunk_type, F.lit(""))))
    plain = let(fingerprint(text, blank), lambda mark: F.when(mark == "", F.lit("")).when(kind == "", mark).otherwise(F.concat(kind, F.lit(":"), mark)))
    if chart_id is None:
        return plain
    cid = strip(F.coalesce(chart_id, F.lit("")))
    return F.when((kind == "chart") & (cid != ""), F.concat(F.lit("chart:"), cid)).otherwise(plain)


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and single CJK characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_noise(text: Column) -> Column:
    """Blank, an advert, a speaker line, or a noise pattern in a short text or as the whole of it."""
    s = strip(F.coalesce(text, F.lit("")))
    ad = F.lit(False)
    for p in AD_PATTERNS:
        ad = ad | s.rlike(f"(?iu){p}")
    noise = F.lit(False)
    for p in NOISE_PATTERNS:
        whole = found(s, p, "mdU") if p.startswith("^") and p.endswith("$") else s.rlike(f"(?mdU)^(?:{p})$")
        noise = noise | ((F.length(s) < 20) & found(s, p, "mdU")) | whole
    for p in HEAD_NOISE_PATTERNS:
        noise = noise | found(s, p, "mdU")
    return (s == "") | ad | noise


def is_bad_title(title: Column) -> Column:
    """Blank, a UUID, digits, a stop title or under four characters."""
    s = strip(F.coalesce(title, F.lit("")))
    return (s == "") | s.rlike(UUID) | s.rlike(r"(?U)^\d+$") | s.isin(*STOP_TITLES) | (F.length(s) < 4)


def source_display(title: Column, filename: Column, path: Column) -> Column:
    """A good title, else the file name's stem, else the last part of the path, else empty."""
    t, f, p = (collapse(F.coalesce(x, F.lit(""))) for x in (title, filename, path))
    stem = F.regexp_replace(F.element_at(F.split(f, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.when((t != "") & ~is_bad_title(t), t).when(f != "", stem).when(p != "", F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1)).otherwise("")


def normalize_path(path: Column) -> Column:
    """Forward slashes; no quotes around, no ./ in front, no fragment or query."""
    s = F.regexp_replace(strip(F.replace(path, F.lit("\\"), F.lit("/"))), "^[\"']+|[\"']+$", "")
    s = F.regexp_replace(s, r"[#?].*$", "")
    return F.regexp_replace(s, r"^(?:\./)+", "")


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(strip(name), r'[\\/:*?"<>|\s]+', "_")


def slugify(name: Column) -> Column:
    """Lower case, other characters than letters and digits as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_think(text: Column) -> Column:
    """Model output without its reasoning: think blocks, thinking fences, reasoning headings and a leading thinking part."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?isu)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?isu)```(?:thinking|thought|analysis)[\s\S]*?```", "")
    s = F.regexp_replace(s, r"(?imdu)^(?:#+\s*)?(?:思考|推理|Chain-of-Thought|CoT|Thoughts?)\s*[:：].*$", "")
    head = F.lower(F.regexp_replace(s, r"(?U)^\s+", ""))
    led = head.startswith("思考") | head.startswith("thinking") | head.startswith("analysis")
    parts = F.split(s, r"\n\s*\n", 2)
    s = F.when(led & (F.size(parts) == 2), F.get(parts, F.lit(1))).otherwise(s)
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


def norm_compact(text: Column) -> Column:
    return F.lower(collapse(text))


def bigrams(text: Column) -> Column:
    """Distinct character pairs of the compacted text."""
    s = F.replace(norm_compact(text), F.lit(" "), F.lit(""))
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    return F.array_distinct(F.when(F.length(s) >= 2, pairs).when(F.length(s) == 1, F.array(s)).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def truncate(text: Column, most: int) -> Column:
    return F.when(text.isNull() | F.lit(most <= 0), F.lit("")).otherwise(F.substring(text, 1, max(0, most)))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def cleaning_stats(original: Column, cleaned: Column) -> Column:
    """Characters and non-blank lines before and after, and what went (never below zero)."""

    def filled(text: Column) -> Column:
        return F.size(F.filter(lines(text), lambda x: strip(x) != ""))

    before, after = filled(original), filled(cleaned)
    return F.struct(
        F.length(original).alias("original_chars"),
        F.length(cleaned).alias("cleaned_chars"),
        F.greatest(F.lit(0), F.length(original) - F.length(cleaned)).alias("removed_chars"),
        before.alias("original_paragraphs"),
        after.alias("cleaned_paragraphs"),
        F.greatest(F.lit(0), before - after).alias("removed_paragraphs"),
    )


def is_chart_image(kind: Column, path: Column, width: Column, height: Column, words: Iterable[str] = ("chart", "graph", "figure", "table", "diagram")) -> Column:
    """A chart by its type, its path, or a side ratio strictly between 0.3 and 5."""
    ratio = width / F.when(height != 0, height)
    return F.coalesce(F.lower(kind).isin(*words), F.lit(False)) | F.coalesce(F.lower(path).rlike("|".join(words)), F.lit(False)) | F.coalesce((ratio > 0.3) & (ratio < 5), F.lit(False))


def is_qr(alt: Column, context: Column, filename: Column) -> Column:
    said = F.concat_ws(" ", alt, context)
    found = F.lit(False)
    for w in QR_WORDS:
        found = found | F.lower(said).contains(w)
    return found | F.lower(F.coalesce(filename, F.lit(""))).contains("qr")
