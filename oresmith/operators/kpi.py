"""Grouped indicators: means by scope, shares, reuse, change between scales, impact of rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oresmith.functions.aggregates import count_if, row_count, share_percent
from oresmith.functions.measures import percent_change

SCOPES = ("all", "main", "quality")


def replicate(df: DataFrame, factor: int, offset_keys: Mapping[str, Column] | None = None) -> DataFrame:
    """Every row ``factor`` times, numbered 1.. in ``scale_factor_copy``; the input is read once.

    ``offset_keys`` gives, per key column, the distance between the keys of two copies, so that
    a later deduplication does not undo the scaling.
    """
    copies = df.withColumn("scale_factor_copy", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    shift = F.col("scale_factor_copy") - 1
    for key, distance in (offset_keys or {}).items():
        copies = copies.withColumn(key, F.col(key) + shift * distance)
    return copies


def left_fill(left: DataFrame, right: DataFrame, on: Sequence[str], fill: Mapping[str, int]) -> DataFrame:
    """Left join; the named right columns become ints with a default for rows without a match."""
    joined = left.join(right, list(on), "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)).cast("int") for c, v in fill.items()}
    return joined.withColumns(filled)


def group_means(
    df: DataFrame, by: Sequence[str], measures: Mapping[str, str], quality: Column, digits: int = 2
) -> DataFrame:
    """Rounded means per group in three scopes: all rows, rows outside and rows inside ``quality``.

    ``measures`` maps output names to columns. All scopes come from one aggregation; a scope
    without rows yields no output row.
    """
    mask = F.coalesce(quality, F.lit(False))
    inside = {"all": F.lit(True), "main": ~mask, "quality": mask}
    totals = [count_if(inside[s]).alias(f"{s}__rows") for s in SCOPES]
    means = [
        F.round(F.avg(F.when(inside[s], F.col(column))), digits).alias(f"{s}__{name}")
        for s in SCOPES
        for name, column in measures.items()
    ]
    wide = df.groupBy(*by).agg(*totals, *means)
    scopes = [
        F.struct(
            F.lit(s).alias("scope"),
            F.col(f"{s}__rows").alias("group_rows"),
            *[F.col(f"{s}__{name}").alias(name) for name in measures],
        )
        for s in SCOPES
    ]
    return wide.select(*by, F.inline(F.array(*scopes))).where(F.col("group_rows") > 0).drop("group_rows")


def share_of_total(df: DataFrame, by: Sequence[str], value: str, subset: Column, member: str) -> DataFrame:
    """Per group: total, subset total, the subset's share, and distinct members of both.

    Rows are first summed per member, so distinct members need no second pass over the input.
    """
    inside = F.coalesce(subset, F.lit(False))
    per_member = df.groupBy(*by, member).agg(
        F.sum(value).alias("total"),
        F.sum(F.when(inside, F.col(value))).alias("subset_total"),
        F.max(inside).alias("in_subset"),
    )
    counted = F.col(member).isNotNull()
    totals = per_member.groupBy(*by).agg(
        F.sum("total").alias("total_value"),
        F.coalesce(F.sum("subset_total"), F.lit(0)).alias("subset_value"),
        count_if(counted).alias("num_members"),
        count_if(counted & F.col("in_subset")).alias("num_subset_members"),
    )
    return totals.withColumn("subset_percentage", share_percent(F.col("subset_value"), F.col("total_value")))


def reuse(df: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Per group: distinct items, uses, repeated uses, uses per item, repeats per item."""
    per_item = df.where(F.col(item).isNotNull()).groupBy(*by, item).agg(row_count().alias("uses"))
    totals = per_item.groupBy(*by).agg(
        row_count().alias("unique_items"),
        F.sum("uses").alias("total_uses"),
        F.sum(F.col("uses") - 1).alias("duplicate_instances"),
    )
    return totals.withColumn("reuse_ratio", _ratio("total_uses")).withColumn(
        "duplicate_instance_ratio", _ratio("duplicate_instances")
    )


def _ratio(column: str) -> Column:
    unique = F.nullif(F.col("unique_items"), F.lit(0))
    return F.coalesce(F.col(column).cast("double") / unique, F.lit(0.0))


def mean_where(df: DataFrame, by: Sequence[str], value: str, condition: Column, name: str) -> DataFrame:
    """Mean of a column over the rows that satisfy a condition."""
    return df.groupBy(*by).agg(F.avg(F.when(condition, F.col(value))).alias(name))


def pivot_labels(
    df: DataFrame,
    row: str,
    label: str,
    labels: Sequence[str],
    value: str,
    row_order: Sequence[str],
    other: str | None = None,
) -> DataFrame:
    """One row per ``row`` value and one column per label, the sum of the cell's values.

    Rows outside ``row_order`` come last. The labels are given, so Spark needs no extra pass to
    find them; ``other`` names a column for the sum of all further labels.
    """
    cells = [F.sum(F.when(F.col(label) == name, F.col(value))).alias(name) for name in labels]
    if other:
        known = F.coalesce(F.col(label).isin(*labels), F.lit(False))
        cells.append(F.sum(F.when(~known, F.col(value))).alias(other))
    position = F.coalesce(order_position(row, row_order), F.lit(len(row_order) + 1))
    return df.groupBy(row).agg(*cells).withColumn("position", position).orderBy("position", row)


def order_position(column: str, order: Sequence[str]) -> Column:
    """Position of a value in a fixed order, from 1; NULL for other values."""
    position = F.when(F.lit(False), F.lit(0))
    for n, value in enumerate(order, start=1):
        position = position.when(F.col(column) == value, F.lit(n))
    return position


def change_between(
    df: DataFrame, by: Sequence[str], label: str, before: object, after: object, measures: Mapping[str, Column]
) -> DataFrame:
    """Sums at two values of ``label`` and the relative change in percent, per group."""
    scales = {"before": F.lit(before), "after": F.lit(after)}
    sums = [
        F.sum(F.when(F.col(label) == scale, measure)).alias(f"{name}_{when}")
        for name, measure in measures.items()
        for when, scale in scales.items()
    ]
    both = df.where(F.col(label).isin(before, after)).groupBy(*by).agg(*sums)
    changes = {
        f"{name}_change_pct": percent_change(
            F.col(f"{name}_before").cast("double"), F.col(f"{name}_after").cast("double")
        )
        for name in measures
    }
    return both.withColumns(changes)


def growth(df: DataFrame, by: Sequence[str], scale: str, measures: Sequence[str]) -> DataFrame:
    """One row per group, measure and scale: its value, the change since the scale before, and the
    exponent with which the measure grows over all scales.

    ``df`` holds one row per group and scale, a positive number, with the measures as columns.
    ``change_pct`` is NULL at the smallest scale. ``growth_exponent`` is the slope of the
    logarithms: 1 for a measure in proportion to the scale, 0 for one that stays; NULL with less
    than two scales that have a positive value.
    """
    names = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    rows = df.select(*by, F.col(scale).cast("double").alias("scale"), F.inline(F.array(*names)))
    group = Window.partitionBy(*by, "measure")
    before = group.orderBy("scale")
    positive = (F.col("value") > 0) & (F.col("scale") > 0)
    logs = [F.when(positive, F.log(c)) for c in ("value", "scale")]
    found = rows.withColumns(
        {
            "previous_scale": F.lag("scale").over(before),
            "previous_value": F.lag("value").over(before),
            "growth_exponent": F.regr_slope(*logs).over(group),
        }
    )
    return found.withColumn("change_pct", percent_change(F.col("previous_value"), F.col("value")))


@dataclass(frozen=True)
class Scenario:
    """A planned change: the catalog rules it touches."""

    name: str
    touched: str


CHANGE_SCENARIOS = (
    Scenario("every_customer_table", "object_name LIKE '%customer%'"),
    Scenario("all_key_completeness_rules", "rule_group = 'KEY_COMPLETENESS'"),
    Scenario("first_silver_rule", "rule_id = 'DP_SILVER_001'"),
)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Object name and row count of several tables."""
    frames = [
        df.agg(row_count().alias("row_count")).select(F.lit(name).alias("object_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def rule_impact(catalog: DataFrame, counts: DataFrame, scenarios: Sequence[Scenario] = CHANGE_SCENARIOS) -> DataFrame:
    """What a change touches: rules, objects, their product as a score, and the rows behind them.

    ``counts`` holds the row count per object; the catalog is a few dozen rows.
    """
    hits = F.array_compact(F.array(*[F.when(F.expr(s.touched), F.lit(s.name)) for s in scenarios]))
    touched = catalog.select("rule_id", "object_name", F.explode(hits).alias("change_scenario"))
    per_object = (
        touched.groupBy("change_scenario", "object_name")
        .agg(row_count().alias("touch_points"))
        .join(counts, "object_name", "left")
    )
    totals = per_object.groupBy("change_scenario").agg(
        row_count().alias("objects_touched"),
        F.sum("touch_points").alias("touch_points"),
        # One object without a count leaves the sum unknown.
        F.when(F.count("row_count") == F.count(F.lit(1)), F.sum("row_count")).alias("rows_governed"),
    )
    return totals.withColumn("complexity_score", F.col("objects_touched") * F.col("touch_points"))


def summary(on: str, base: DataFrame, *others: DataFrame, zero: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``base`` with the columns of every indicator table.

    Groups another table does not know keep their row; the ``zero`` columns are 0 for them.
    """
    combined = reduce(lambda a, b: a.join(b, on, "left"), others, base)
    return combined.fillna(0, list(zero)) if zero else combined
