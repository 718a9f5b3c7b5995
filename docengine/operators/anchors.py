"""Chart anchors in Markdown as array expressions: paragraphs and charts are rows of one array, sorted once.

A chart is STRUCT<id, hint>. What shares words with its hint attracts it; the place of each chart depends on the text
alone, not on the charts placed before it, so all of a text's charts find their places at once. Everything runs
inside one row: no shuffle, no Python. A null text counts as empty; null or blank ids name no chart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions import markdown as M
from docengine.functions import text as T
from docengine.functions.text import let

# Characters between the words of a hint, weights of a whole hint and of a long paragraph.
HINT_BREAKS = r"(?U)[\s，。；：:、,()（）\[\]“”\"'【】]+"
WHOLE_HINT, LONG_PARAGRAPH, LONG = 1.5, 0.2, 120
ANY_ANCHOR = r"\[Chart:\s*[^\]]+\]"


def charts(ids: Column, hints: Column | None = None) -> Column:
    """ARRAY<STRUCT<id, hint>> from an array of ids and a map of hints."""
    named = F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: T.strip(x)), lambda x: x.isNotNull() & (x != ""))
    hint = (lambda x: F.coalesce(T.collapse(F.try_element_at(hints, x)), F.lit(""))) if hints is not None else (lambda x: F.lit(""))
    return F.transform(named, lambda x: F.struct(x.alias("id"), hint(x).alias("hint")))


def strip_anchors(md: Column) -> Column:
    """Without anchors; the gaps that they leave close."""

    def bare(s: Column) -> Column:
        return T.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, ANY_ANCHOR, ""), "[ \t]{2,}", " "), "\n{3,}", "\n\n"))

    return let(T.lf(F.coalesce(md, F.lit(""))), lambda s: F.when(T.strip(s) == "", s).otherwise(F.concat(bare(s), F.lit("\n"))))


def paragraphs(md: Column) -> Column:
    """ARRAY<STRUCT<i, text, body, heading>>: blocks between blank lines, and each with white space collapsed."""
    blocks = F.filter(F.transform(F.split(T.lf(md), "\n{2,}", -1), lambda p: F.btrim(p, F.lit("\n"))), lambda p: T.strip(p) != "")
    return F.transform(blocks, lambda p, i: F.struct(i.alias("i"), p.alias("text"), T.collapse(p).alias("body"), p.rlike(r"(?U)^\s*#{1,6}\s+\S").alias("heading")))


def _shared(hint: Column, body: Column) -> Column:
    words = F.filter(F.split(hint, HINT_BREAKS, -1), lambda w: (F.length(w) > 1) & F.contains(body, w))
    return F.size(words).cast("double")


def _best(rows: Column, score) -> Column:
    """STRUCT<score, i>: the best of the paragraphs, the first of equals; null of none."""
    found = F.array_max(F.transform(rows, lambda p: F.struct(score(p).alias("score"), (-p["i"]).alias("back"))))
    return F.when(found.isNotNull(), F.struct(found["score"].alias("score"), (-found["back"]).alias("i")))


def _assembled(rows: Column, placed: Column, between: str) -> Column:
    """Paragraphs in order, each followed by its charts (STRUCT<i, n, text>) after `between`."""
    own = F.transform(rows, lambda p: F.struct(p["i"].alias("i"), F.lit(-1).alias("n"), F.concat(F.when(p["i"] > 0, F.lit("\n\n")).otherwise(F.lit("")), T.rstrip(p["text"])).alias("text")))
    put = F.transform(placed, lambda c: F.struct(c["i"].alias("i"), c["n"].alias("n"), F.concat(F.lit(between), c["text"]).alias("text")))
    return F.concat(T.strip(F.array_join(F.transform(F.array_sort(F.concat(own, put)), lambda x: x["text"]), "")), F.lit("\n"))


def _mark(id: Column) -> Column:
    return F.concat(F.lit("[Chart: "), id, F.lit("]"))


def place_anchors(md: Column, wanted: Column, first: int = 1) -> Column:
    """Each chart once, behind the paragraph (no heading) that suits its hint best; weak matches not before paragraph `first`."""
    return F.get(place_each(md, [wanted], first), F.lit(0))


def place_each(md: Column, each: list[Column], first: int = 1) -> Column:
    """`place_anchors` for several lists of charts, as an array of texts; the text is taken apart once."""

    def place(c: Column, plain: Column) -> Column:
        def score(p: Column) -> Column:
            whole = F.when((c["hint"] != "") & F.contains(p["body"], c["hint"]), WHOLE_HINT).otherwise(0.0)
            return _shared(c["hint"], p["body"]) + whole + F.when(F.length(p["body"]) >= LONG, LONG_PARAGRAPH).otherwise(0.0)

        later = F.get(F.filter(plain, lambda p: p["i"] >= first), F.lit(0))["i"]
        fallback = F.coalesce(later, F.element_at(plain, -1)["i"])
        return let(_best(plain, score), lambda b: F.when(b.isNull(), 0).when((b["i"] < first) & (b["score"] < 1.0), fallback).otherwise(b["i"]))

    def put(wanted: Column, rows: Column, text: Column) -> Column:
        alone = F.concat(F.array_join(F.transform(wanted, lambda c: _mark(c["id"])), "\n\n"), F.lit("\n"))
        placed = let(F.filter(rows, lambda p: ~p["heading"]), lambda plain: F.transform(wanted, lambda c, n: F.struct(place(c, plain).alias("i"), n.alias("n"), _mark(c["id"]).alias("text"))))
        return F.when(F.size(wanted) == 0, text).when(F.size(rows) == 0, alone).otherwise(_assembled(rows, placed, "\n\n"))

    return let(strip_anchors(md), lambda text: let(paragraphs(text), lambda rows: F.array(*[put(w, rows, text) for w in each])))


def ensure_anchors(md: Column, wanted: Column) -> Column:
    """Adds the charts without an anchor: behind the paragraph that shares most words with the hint, else the first."""

    def put(missing: Column, rows: Column, text: Column) -> Column:
        def place(c: Column) -> Column:
            return let(_best(rows, lambda p: _shared(c["hint"], p["body"])), lambda b: F.when(b["score"] > 0, b["i"]).otherwise(0))

        placed = F.transform(missing, lambda c, n: F.struct(place(c).alias("i"), n.alias("n"), _mark(c["id"]).alias("text")))
        alone = F.concat(F.array_join(F.transform(missing, lambda c: _mark(c["id"])), "\n"), F.lit("\n"))
        return F.when(F.size(missing) == 0, text).when(F.size(rows) == 0, alone).otherwise(_assembled(rows, placed, "\n"))

    def missing_of(text: Column) -> Column:
        return let(M.anchor_ids(text), lambda there: F.filter(wanted, lambda c: ~F.array_contains(there, c["id"])))

    return let(F.coalesce(md, F.lit("")), lambda text: let(missing_of(text), lambda missing: let(paragraphs(text), lambda rows: put(missing, rows, text))))


def spread_tail(md: Column, wanted: Column, tail: int = 20) -> Column:
    """Charts whose anchors pile up in the last `tail` lines (two, or half of them) go back next to their text."""

    def decide(text: Column) -> Column:
        lines = T.lines(text)
        piled = F.size(F.array_distinct(M.anchor_ids(F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - max(1, tail) + 1), max(1, tail)), "\n"))))
        there = let(M.anchor_ids(text), lambda found: F.forall(wanted, lambda c: F.array_contains(found, c["id"])))
        bare = T.strip(F.array_join(F.filter(lines, lambda x: ~x.rlike(ANY_ANCHOR)), "\n"))
        enough = piled >= F.greatest(F.lit(2), F.floor(F.size(wanted) / 2))
        # One call of ensure_anchors for both cases: which text it gets decides.
        given = F.when((piled > 0) & there & enough, bare).otherwise(text)
        return F.when(F.size(wanted) == 0, text).when((piled > 0) & there & ~enough, text).otherwise(ensure_anchors(given, wanted))

    return let(T.lf(F.coalesce(md, F.lit(""))), decide)
