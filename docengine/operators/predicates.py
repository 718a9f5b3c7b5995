"""Metadata predicates as one Spark column: {"key": value} or {"key": {"$gt": value, ...}}, all of them together."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


def compile(conditions: dict[str, Any] | None, of: Callable[[str], Column] = F.col, first_only: bool = False) -> Column:
    """Condition over `of(key)`; plain columns reach the Parquet scan as pushed filters.

    first_only: of several operators on one key only the first known one counts. Unknown operators compare for
    equality with the text of the dictionary; no conditions let everything through."""
    out = []
    for key, wanted in (conditions or {}).items():
        column = of(key)
        if not isinstance(wanted, dict):
            out.append(column.isNull() if wanted is None else column == wanted)
            continue
        known = [(op, wanted[op]) for op in OPERATORS if op in wanted]
        if not known:
            out.append(column.cast("string") == str(wanted))
        for op, value in known[:1] if first_only else known:
            out.append(OPERATORS[op](column, value))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def equals(conditions: dict[str, Any] | None, of: Callable[[str], Column] = F.col) -> Column:
    """Equality only; a missing key is not equal to a value."""
    return reduce(lambda a, b: a & b, [of(k).eqNullSafe(F.lit(v)) for k, v in (conditions or {}).items()], F.lit(True))
