"""Aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    return F.count(F.lit(1))


def count_if(condition: Column) -> Column:
    """Rows for which the condition is true; NULL does not count, an empty input gives 0."""
    return F.count_if(condition)


def pct_of(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent as a double, two digits; NULL for an empty whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 2)


def pct_null(column: Column) -> Column:
    """Share of NULLs in percent; NULL for an empty table."""
    return pct_of(count_if(column.isNull()), row_count())


def share_percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; 0 for an empty whole."""
    return F.coalesce(pct_of(part, whole), F.lit(0.0))
