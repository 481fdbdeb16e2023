"""Columns that are worked out once per row.

The optimizer copies a projected expression into every filter and projection above it. For
a parsed document, read by a dozen others, that multiplies the parsing. A generator over a
single-element array is a step it does not copy through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns, each evaluated exactly once per row."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [F.col(name) for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value worked out once, also where the body repeats it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
