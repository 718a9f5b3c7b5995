"""Document cleaning: rule stages, line de-duplication, table protection, segments and packing.

Stages that only replace or filter are column expressions. Where the result depends on the order of what was
seen before (tables, segments, packing, outline items) a text goes through one Python function in Arrow
batches; each text is on its own, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from docengine.functions import sequential as S
from docengine.functions import text as T
from docengine.functions.names import unused


_INT = IntegerType()


def map_text(df: DataFrame, text: str, apply: Callable[[dict], list[tuple]], added: list[StructField], also: list[str] | None = None) -> DataFrame:
    """Rows of `apply` (a function of a row's values) for each row: other columns stay, `text` is replaced by the first value.

    `apply` gets the values of `text` and `also` by name and returns tuples (text, *added)."""
    names = df.columns
    used = [text, *(also or [])]
    schema = StructType([StructField(text, StringType()) if f.name == text else f for f in df.schema.fields] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                given = {c: batch.column(names.index(c)).to_pylist() for c in used}
                at, out = [], []
                for i in range(batch.num_rows):
                    for row in apply({c: v[i] for c, v in given.items()}):
                        at.append(i)
                        out.append(row)
                taken = batch.take(pa.array(at, pa.int64()))
                columns = [pa.array([r[0] for r in out], pa.string()) if n == text else taken.column(k) for k, n in enumerate(names)]
                for k, field in enumerate(added):
                    columns.append(pa.array([r[k + 1] for r in out], {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}[field.dataType.simpleString()]))
                yield pa.RecordBatch.from_arrays(columns, [*names, *(f.name for f in added)])

    return df.mapInArrow(run, schema)


def rule_clean(df: DataFrame, text: str = "text", ads: bool = True, noise: bool = True, whitespace: bool = True, duplicates: bool = True) -> DataFrame:
    """All rules in order; tables are taken out first and put back untouched.

    Python finds the table spans and puts tables back; between the two, the stages are column expressions."""
    held, = unused(df.columns, "tables")
    rows = map_text(df, text, lambda r: [S.protect_tables(r[text] or "")], [StructField(held, StringType())])
    body = F.col(text)
    if ads:
        body = T.remove_ads(body)
    if noise:
        body = T.remove_noise(T.remove_head_noise(body))
    if whitespace:
        body = T.normalize_whitespace(body)
    if duplicates:
        body = T.dedup_lines(body)
    rows = rows.withColumn(text, body)
    return map_text(rows, text, lambda r: [(S.restore_tables(r[text], r[held]),)], [], [held]).drop(held)


def dedup_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """First occurrence of each non-blank line of a row, by its trimmed lower-case form; adds n_lines (kept).

    Every row stays, repeated ones too; a null text stays null with no line, one without filled lines becomes empty."""
    names = df.columns
    first = T.first_lines(F.col(text))
    pair = T.let(first, lambda kept: F.struct(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("t"), F.size(kept).cast("long").alias("n")))
    held, = unused(names, "kept")
    rows = df.select(*names, F.when(F.col(text).isNotNull(), pair).alias(held))
    return rows.select(*[F.col(held)["t"].alias(c) if c == text else F.col(c) for c in names], F.coalesce(F.col(held)["n"], F.lit(0).cast("long")).alias("n_lines"))


def duplicate_paragraphs(df: DataFrame, text: str = "text", top: int = 20) -> DataFrame:
    """The most repeated lines (count, then length, both falling), shown up to 220 characters."""
    p = F.lower(T.collapse(F.col("line")))
    counts = df.select(F.explode(T.lines(F.col(text))).alias("line")).select(p.alias("p")).where("p != ''").groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    best = counts.orderBy(F.desc("n"), F.desc(F.length("p")), "p").limit(top)
    return best.select("n", F.when(F.length("p") > 220, F.concat(F.substring("p", 1, 220), F.lit("..."))).otherwise(F.col("p")).alias("sample"))


def duplicate_ratio(df: DataFrame, text: str = "text") -> DataFrame:
    p = F.lower(T.collapse(F.col("line")))
    counts = df.select(F.explode(T.lines(F.col(text))).alias("line")).select(p.alias("p")).where("p != ''").groupBy("p").agg(F.count("*").alias("n"))
    total, repeated = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return counts.agg(total.alias("paragraph_total"), repeated.alias("duplicate_paragraph_total"), F.round(F.when(total > 0, repeated / total).otherwise(0.0), 6).alias("duplicate_ratio"))


def segments(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each segment: `position`, `kind` (text, image, qr_image, table, chart), `segment`."""
    added = [StructField("position", _INT), StructField("kind", StringType())]
    return map_text(df, text, lambda r: [(s, i, k) for i, (k, s) in enumerate(S.segments(r[text] or ""))], added).withColumnRenamed(text, "segment")


def pack(df: DataFrame, text: str = "text", most: int = 8192) -> DataFrame:
    """Sentences and lines packed in order to `most` characters; a longer sentence stands alone: `part`, `piece`."""
    return map_text(df, text, lambda r: [(p, i) for i, p in enumerate(S.pack(r[text] or "", most))], [StructField("part", _INT)]).withColumnRenamed(text, "piece")


def prompt(template: Column, instructions: Column, text: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{instructions}"), instructions), F.lit("{text}"), text)


def model_clean(df: DataFrame, clean: Callable[[str], str] | None = None, text: str = "text", strict: bool = False) -> DataFrame:
    """Each text through a model hook, its white space at both ends preserved; a failure leaves the text (or, strict, fails).

    Without a hook texts stay as they are."""

    def apply(row: dict) -> list[tuple]:
        body = row[text]
        if body is None or clean is None or not body.strip():
            return [(body,)]
        core = body.strip()
        at = body.index(core)
        try:
            return [(body[:at] + clean(core) + body[at + len(core) :],)]
        except Exception:
            if strict:
                raise
            return [(body,)]

    return map_text(df, text, apply, [])


def strip_title_heading(text: Column, title: Column) -> Column:
    """Without a first heading that equals the title apart from white space and colons."""

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"(?U)[\s:：]+", "")

    body = T.lf(F.coalesce(text, F.lit("")))
    head = F.regexp_extract(body, r"(?U)\A\s*#{1,6}\s+([^\n]+)", 1)
    rest = F.regexp_replace(body, r"(?U)\A\s*#{1,6}\s+[^\n]+\n?", "")
    return F.when((head != "") & (bare(head) == bare(title)), T.strip(rest)).otherwise(T.strip(text))


def strip_outline_items(df: DataFrame, text: str, skeleton: str, orphans: bool) -> DataFrame:
    """Without list items of the skeleton that nothing deeper follows; `orphans`: only those that exist as headings too. Adds removed."""
    return map_text(df, text, lambda r: [S.strip_outline_items(r[text] or "", r[skeleton] or "", orphans)], [StructField("removed", _INT)], [skeleton])


def resolve_reference(base: Column, reference: Column) -> Column:
    """Path of a reference below its base folder; null for URLs, data URIs, NUL characters and null."""
    ref = T.normalize_path(reference)
    bad = reference.rlike(r"(?i)^\s*(?:https?:|data:)") | F.contains(reference, F.lit("\0"))
    return F.when(~bad & (ref != ""), F.when(ref.startswith("/"), ref).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), ref)))



def remove_images(df: DataFrame, deleted: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Without the Markdown images whose reference is among `deleted` (ref): id, text.

    References join the deleted ones as rows; a text only gathers its own."""
    held, = unused([id, text], "gone")
    refs = df.select(id, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)))).alias("ref"))
    gone = refs.join(deleted.select("ref"), "ref", "left_semi").groupBy(id).agg(F.collect_set("ref").alias(held))
    rows = df.select(id, text).join(gone, id, "left")
    parts = F.split(F.col(text), r"(?=!\[[^\]]*\]\([^)]+\))", -1)

    def part(p: Column) -> Column:
        ref = F.regexp_extract(p, r"^!\[[^\]]*\]\(([^)]+)\)", 1)
        return F.when(F.array_contains(held, ref), F.regexp_replace(p, r"^!\[[^\]]*\]\([^)]+\)", "")).otherwise(p)

    return rows.select(id, F.when(F.col(held).isNull(), F.col(text)).otherwise(F.array_join(F.transform(parts, part), "")).alias(text))


def prune_references(df: DataFrame, removed: DataFrame, json: str = "json", id: str = "doc_id") -> DataFrame:
    """df without references in `json` to the removed files (id, ref: relative paths) of its document, and changed.

    A document meets only its own removed files, gathered as one set."""
    key, names = unused(df.columns, "id", "gone")
    gone = removed.groupBy(F.col(id).alias(key)).agg(F.collect_set("ref").alias(names))
    rows = df.join(gone, F.col(id) == F.col(key), "left").drop(key)

    def apply(row: dict) -> list[tuple]:
        text, held = S.prune_json(row[json], set(row[names] or ()))
        return [(text, held)]

    return map_text(rows, json, apply, [StructField("changed", BooleanType())], [names]).drop(names)


def clean_documents(df: DataFrame, model: Callable[[str], str] | None = None, text: str = "text", **rules) -> DataFrame:
    """The whole cleaning: rules, then the model hook, statistics of both together.

    Adds original_chars, cleaned_chars, removed_chars, success and error; a failure of the hook is a row with success
    false, the error and the text as the rules left it, and a null text is one without text."""
    original, stat = unused(df.columns, "original", "stats")
    ruled = rule_clean(df.withColumn(original, F.col(text)), text, **rules)

    def apply(row: dict) -> list[tuple]:
        if row[original] is None:
            return [(None, False, "no text")]
        body = row[text]
        try:
            return [(model(body) if model and body.strip() else body, True, None)]
        except Exception as e:  # noqa: BLE001  (the row carries it)
            return [(body, False, str(e)[:400])]

    out = map_text(ruled, text, apply, [StructField("success", BooleanType()), StructField("error", StringType())], [original])
    stats = T.cleaning_stats(F.coalesce(original, F.lit("")), F.coalesce(text, F.lit("")))
    counted = out.withColumn(stat, stats).select("*", *[F.col(stat)[n].alias(n) for n in ("original_chars", "cleaned_chars", "removed_chars")])
    return counted.drop(stat, original)
