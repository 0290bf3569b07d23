"""Rows per key: latest version, top N, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oresmith.functions.aggregates import row_count

_RANK = "__rank"
_ALONE = "__alone"


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def latest_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str = "ingestion_timestamp",
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: the one with the greatest ``order_by``, NULLs last.

    Rows that tie are decided by ``tie_break`` columns, greatest first; without any, by all
    other columns, so only identical rows are interchangeable. The rank filter lets Spark keep
    one candidate per key in every task before the shuffle, so a key that owns much of the
    table never meets in one task. NULL keys count as equal.
    """
    if tie_break is None:
        tie_break = [c for c in df.columns if c not in keys and c != order_by]
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in (order_by, *tie_break)])
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) == 1).drop(_RANK)


def latest_of_complete_keys(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str = "ingestion_timestamp",
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """``latest_by_key`` that leaves every row with a missing key part as it is.

    Such rows identify nothing, so they are no versions of each other. A number of its own beside
    the key keeps each of them alone, and lets them spread over all tasks; complete keys all have
    0. So one pass over the table does for both kinds.
    """
    if tie_break is None:
        tie_break = [c for c in df.columns if c not in keys and c != order_by]
    alone = F.when(all_present(keys), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    return latest_by_key(df.withColumn(_ALONE, alone), [*keys, _ALONE], order_by, tie_break).drop(_ALONE)


def top_n(
    df: DataFrame, n: int, partition_by: Sequence[str], order_by: Sequence[Column], rank: str
) -> DataFrame:
    """The first ``n`` rows of every partition, with their position in column ``rank``."""
    window = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def duplicate_row_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat a key already seen. NULL keys count as equal."""
    per_key = df.groupBy(*keys).agg(row_count().alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))
