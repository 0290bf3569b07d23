"""Numeric measures and bands."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) and labels of the bands.
PRICE_BANDS = (
    ("10", "Low (< 10)"),
    ("50", "Medium (10-50)"),
    ("100", "High (50-100)"),
)
PRICE_TOP = "Premium (>= 100)"

STORE_SIZE_BANDS = (
    ("100", "Small (< 100)"),
    ("200", "Medium (100-200)"),
    ("300", "Large (200-300)"),
)
STORE_SIZE_TOP = "Very Large (>= 300)"

AGE_BANDS = (
    ("25", "Gen Z (< 25)"),
    ("40", "Millennials (25-39)"),
    ("55", "Gen X (40-54)"),
    ("75", "Baby Boomers (55-74)"),
)
AGE_TOP = "Silent Generation (75+)"
AGE_UNKNOWN = "Unknown"

# Upper bounds (inclusive) of the discount ratio.
DISCOUNT_BANDS = (
    ("0.10", "Small (0-10%)"),
    ("0.25", "Medium (10-25%)"),
    ("0.50", "Large (25-50%)"),
)
DISCOUNT_NONE = "No Discount"
DISCOUNT_TOP = "Very Large (> 50%)"
DISCOUNT_NO_LIST = "No List Price"


def nullif_zero(column: Column) -> Column:
    return F.nullif(column, F.lit(0))


def below_bands(
    column: Column,
    bands: Sequence[tuple[str, str]],
    top: str,
    unknown: str | None = None,
) -> Column:
    """Label of the first bound the value stays under.

    NULL takes ``unknown``, or the top label where no ``unknown`` is given.
    """
    label = F.when(column.isNull(), F.lit(top if unknown is None else unknown))
    for bound, name in bands:
        label = label.when(column < F.lit(Decimal(bound)), F.lit(name))
    return label.otherwise(F.lit(top))


def price_band(column: Column, unknown: str | None = None) -> Column:
    return below_bands(column, PRICE_BANDS, PRICE_TOP, unknown)


def store_size_band(column: Column, unknown: str | None = None) -> Column:
    return below_bands(column, STORE_SIZE_BANDS, STORE_SIZE_TOP, unknown)


def age_band(column: Column) -> Column:
    return below_bands(column, AGE_BANDS, AGE_TOP, AGE_UNKNOWN)


def age_at(as_of: Column, birth_year: Column) -> Column:
    """Whole years between the birth year and the year of ``as_of``; NULL if unknown."""
    return F.year(as_of) - birth_year


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent with two digits; NULL for a zero or missing whole."""
    return F.round(part / nullif_zero(whole) * 100, 2)


def margin_percent(price: Column, cost: Column) -> Column:
    return percent(price - cost, price)


def discount_ratio(list_price: Column, sales_price: Column) -> Column:
    return (list_price - sales_price) / nullif_zero(list_price)


def discount_percent(list_price: Column, sales_price: Column) -> Column:
    return percent(list_price - sales_price, list_price)


def per_unit(amount: Column, quantity: Column) -> Column:
    return F.round(amount / nullif_zero(quantity), 2)


def discount_band(list_price: Column, sales_price: Column) -> Column:
    """Discount label; a missing or zero list price has its own label."""
    ratio = discount_ratio(list_price, sales_price)
    label = F.when(nullif_zero(list_price).isNull(), F.lit(DISCOUNT_NO_LIST)).when(
        ratio == 0, F.lit(DISCOUNT_NONE)
    )
    for bound, name in DISCOUNT_BANDS:
        label = label.when(ratio <= F.lit(Decimal(bound)), F.lit(name))
    return label.otherwise(F.lit(DISCOUNT_TOP))


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def seconds_to_minutes(column: Column) -> Column:
    return column / 60


def percent_change(before: Column, after: Column) -> Column:
    """Relative change in percent, two digits; NULL when there is nothing to compare with."""
    return F.round((after / nullif_zero(before) - 1) * 100, 2)
