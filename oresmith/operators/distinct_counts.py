"""Exact distinct counts that loads add to, by bitmaps of their keys.

A load leaves bitmaps behind, one row for each 32,768 neighbouring keys that it has any of. Bitmaps
of several loads are merged by OR, and the distinct keys are their bits, so rows of earlier loads
are never read again. Keys are whole numbers, of either sign; keys that lie close make it small,
as numbered keys do. Counts combine in every task, so a frequent key or load does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_bitmaps(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bucket, bitmap): the keys of a load, per group; NULL keys are none."""
    present = df.where(F.col(key).isNotNull()).withColumn("bucket", F.bitmap_bucket_number(F.col(key)))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key)))
    return present.groupBy(*by, "bucket").agg(bits.alias("bitmap"))


def merged(*loads: DataFrame) -> DataFrame:
    """The bitmaps of all loads together, in the same shape as those of one."""
    together = loads[0]
    for load in loads[1:]:
        together = together.unionByName(load)
    by = [c for c in together.columns if c != "bitmap"]
    return together.groupBy(*by).agg(F.bitmap_or_agg(F.col("bitmap")).alias("bitmap"))


def distinct_keys(bitmaps: DataFrame) -> DataFrame:
    """(by..., distinct_keys): how many keys the merged bitmaps hold, per group."""
    by = [c for c in bitmaps.columns if c not in {"bucket", "bitmap"}]
    bits = F.coalesce(F.sum(F.bitmap_count(F.col("bitmap"))), F.lit(0))
    return bitmaps.groupBy(*by).agg(bits.alias("distinct_keys"))
