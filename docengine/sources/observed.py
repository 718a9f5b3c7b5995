"""Statistics of what is written, counted in the same pass as the write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation


def write_observed(df: DataFrame, write: Callable[[DataFrame], None], **measures: Column) -> dict:
    """Values of the aggregates `measures` over df, taken while `write` writes it: the data are read once.

    Rows of tasks that run again are counted again where a stage is repeated; a write that ends without lost executors is exact."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return seen.get
