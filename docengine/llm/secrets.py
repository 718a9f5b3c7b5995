"""Secret scan with multipart credential linking (operator 8), built-in expressions only.

Base spans are the matches of three patterns (assign, access, hex). Weak parts - client identifiers, bare
40-character tokens, endpoints - are no finding alone. An interval join inside each text keeps a weak part
only where the parts that complete it lie within SCOPE code points:

    ident     needs a secret (an assign span or a bare token)
    token     needs an identifier (an access span or an ident)
    endpoint  needs both an identifier and a secret

Spans are code points, end exclusive. Regex offsets come from the lengths of the matches and of the gaps
between them, so no shuffle takes place and each row is on its own: one hot source, repeated rows and null
or repeated ids change nothing. The join looks each weak part up among the sorted starts and ends of the parts that
complete it (halving), so a text costs n log n of its spans. A null text counts as empty: no spans. Other columns are not carried over.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import let

#: Code points that may lie between two parts of one credential.
SCOPE = 200

# Kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
WEAK = [
    ("ident", r"""(?i)\b(?:client_?id|access_?key_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", 1, 3),
    ("token", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    ("endpoint", r"(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?", 0, 8),
]
#: What tells cheaply that a pattern can match at all.
GATE = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA",
    "hex": "[0-9a-f]{32}",
    "ident": r"(?i)(?:id|name|login|account)[\"']?\x20*[:=]",
    "token": "[A-Za-z0-9+/]{40}",
    "endpoint": "://",
}
KINDS = [k[0] for k in BASE + WEAK]
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
#: Matches whose offsets are added up in one fold (a fold copies what it has so far).
_BLOCK = 256


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Matches, their counted groups and the gaps around them, where the gate lets the text through."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    return F.when(text.rlike(GATE[kind]), found)


def _spans(found: Column, kind: int, least: int) -> Column:
    """Spans of the matches whose counted group has `least` characters; the others still take their place."""
    pieces = F.transform(
        found["whole"],
        lambda x, i: F.struct(
            F.length(F.get(found["gaps"], i)).cast("bigint").alias("gap"), F.length(x).cast("bigint").alias("size"), F.length(F.get(found["part"], i)).alias("counted")
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end"))
        return F.struct((begin + x["size"]).alias("at"), F.when(x["counted"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(at: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])

    def placed(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _BLOCK).cast("int")), lambda b: F.slice(all_, b * _BLOCK + 1, _BLOCK))
        zero = F.array(F.lit(0).cast("bigint"))
        long = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x["gap"] + x["size"])
        return let(parts, lambda p: F.flatten(F.zip_with(F.slice(F.aggregate(p, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + long(x)))), 1, F.size(p)), p, block)))

    return F.when(F.size(pieces) > 0, let(pieces, placed)).otherwise(F.array().cast(_SPAN))


def _below(keys: Column, bound: Column) -> Column:
    """How many of the sorted keys are less than bound, by halving."""
    state = F.struct(F.lit(0).alias("low"), F.size(keys).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        return let(F.floor((acc["low"] + acc["high"]) / 2).cast("int"), lambda mid: F.when(acc["low"] >= acc["high"], acc).when(F.get(keys, mid) < bound, F.struct((mid + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), mid.alias("high"))))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(F.size(keys) + 1)).cast("int")), state, halve, lambda acc: acc["low"])


def _near(others: Column, scope: int, parts: Column) -> Column:
    """The parts that have one of `others` within `scope` code points and not overlapping them."""

    def found(starts: Column, ends: Column) -> Column:
        after = lambda p: F.coalesce(F.get(starts, _below(starts, p["end"])) - p["end"] <= scope, F.lit(False))
        before = lambda p: F.coalesce(p["start"] - F.get(ends, _below(ends, p["start"] + 1) - 1) <= scope, F.lit(False))
        return F.filter(parts, lambda p: after(p) | before(p))

    return let(F.array_sort(F.transform(others, lambda o: o["start"])), lambda starts: let(F.array_sort(F.transform(others, lambda o: o["end"])), lambda ends: found(starts, ends)))


def _outside(parts: Column, strong: Column) -> Column:
    """The parts that overlap none of `strong`, which are of one kind: in order, and they don't overlap each other."""

    def kept(starts: Column) -> Column:
        return F.filter(parts, lambda p: F.coalesce(F.get(strong, _below(starts, p["end"]) - 1)["end"] <= p["start"], F.lit(True)))

    return F.when((F.size(strong) == 0) | (F.size(parts) == 0), parts).otherwise(let(F.transform(strong, lambda b: b["start"]), kept))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, text: str = "text", id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """id, base and linked (arrays of start, kind number, end) of every row."""
    rows = df.select(F.col(id).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.select("key", *[_matches(F.col("body"), kind, pattern, group).alias(f"m_{kind}") for kind, pattern, group, _ in BASE + WEAK])
    rows = rows.select("key", *[_spans(F.col(f"m_{kind}"), n, least).alias(kind) for n, (kind, _, _, least) in enumerate(BASE + WEAK)])
    for strong, *_ in BASE:
        rows = rows.withColumns({k: _outside(F.col(k), F.col(strong)) for k, *_ in WEAK})
    ids, keys = F.concat("access", "ident"), F.concat("assign", "token")
    linked = F.concat(_near(keys, scope, F.col("ident")), _near(ids, scope, F.col("token")), _near(keys, scope, _near(ids, scope, F.col("endpoint"))))
    linked = F.when(F.size("ident") + F.size("token") + F.size("endpoint") > 0, linked).otherwise(F.array().cast(_SPAN))
    rows = rows.select("key", F.concat("assign", "access", "hex").alias("strong"), linked.alias("linked"))
    return rows.select(F.col("key").alias(id), F.col("strong").alias("base"), "linked")


def report(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts of the base spans, digest of their list, and the list of all spans."""
    def count(kind: int, name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")

    counts = [count(k, name) for k, (name, *_) in enumerate(BASE)]
    return found.select(id, *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.concat("base", "linked")).alias("spans"))


def report_sql(table: str = "documents", scope: int = SCOPE) -> str:
    """`report(find_secrets(...))` as DuckDB SQL (ids must be unique). A bare token is a run of its characters of that length."""
    forms = [(k, p, g, n, "true") for k, p, g, n in BASE + WEAK]
    forms[len(BASE) + 1] = ("token", "[A-Za-z0-9+/=]+", 0, 40, "length(part) = 40 AND NOT contains(part, '=')")
    kinds = []
    for n, (_, pattern, group, least, more) in enumerate(forms):
        quoted = "'" + pattern.replace("'", "''") + "'"
        kinds.append(f"""SELECT doc_id, {n} AS kind, pos AS start, pos + length(whole) AS stop FROM (
          SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) - length(whole) AS pos FROM (
            SELECT doc_id, i, g[i] AS gap, w[i] AS whole, p[i] AS part FROM (SELECT doc_id, string_split_regex(t, {quoted}) AS g, regexp_extract_all(t, {quoted}, 0) AS w, regexp_extract_all(t, {quoted}, {group}) AS p FROM d) m, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)))
        WHERE length(part) >= {least} AND {more}""")
    near = lambda part: f"EXISTS (SELECT 1 FROM {part} o WHERE o.doc_id = w.doc_id AND ((o.start >= w.stop AND o.start - w.stop <= {scope}) OR (w.start >= o.stop AND w.start - o.stop <= {scope})))"
    names = "['" + "', '".join(KINDS) + "']"
    text = f"string_agg({names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind, stop)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
    s AS ({" UNION ALL ".join(kinds)}),
    base AS (SELECT * FROM s WHERE kind < {len(BASE)}),
    weak AS (SELECT * FROM s w WHERE kind >= {len(BASE)} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.stop AND w.start < b.stop)),
    ids AS (SELECT * FROM base WHERE kind = 1 UNION ALL SELECT * FROM weak WHERE kind = 3),
    keys AS (SELECT * FROM base WHERE kind = 0 UNION ALL SELECT * FROM weak WHERE kind = 4),
    linked AS (SELECT * FROM weak w WHERE (kind = 3 AND {near("keys")}) OR (kind = 4 AND {near("ids")}) OR (kind = 5 AND {near("ids")} AND {near("keys")})),
    b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, {text} AS body FROM base GROUP BY doc_id),
    e AS (SELECT doc_id, {text} AS body FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b.body, '')) AS base_sha256, coalesce(e.body, '') AS spans
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)"""
