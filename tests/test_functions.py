from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from oresmith.functions import aggregates as a
from oresmith.functions import measures as m
from oresmith.functions import text as t


def values(spark, column, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column).collect()]


def test_trim_to_null(spark):
    rows = [("  a b ",), ("",), ("   ",), (None,), ("\t",)]
    assert values(spark, t.trim_to_null("s"), rows, "s string") == ["a b", None, None, None, "\t"]


def test_year_month_and_quarter(spark):
    rows = [(1999, 3), (2001, 12), (None, 1), (1999, None)]
    assert values(spark, t.year_month("y", "m"), rows, "y int, m int") == ["1999-03", "2001-12", None, None]
    assert values(spark, t.quarter_year("m", "y"), rows, "y int, m int") == ["Q3 1999", "Q12 2001", None, None]


def test_flags(spark):
    rows = [("Y",), ("N",), (None,), ("y",)]
    assert values(spark, t.yes_flag("s"), rows, "s string") == [True, False, False, False]
    rows = [(None, None), (1, None), (None, 1)]
    assert values(spark, t.open_ended("a", "b"), rows, "a int, b int") == [True, False, False]


def test_address_lines_skip_missing_parts(spark):
    rows = [("1", "Main", "St", None, "X", None), (None, None, None, None, None, None)]
    schema = "n string, s string, k string, u string, city string, zip string"
    assert values(spark, t.spaced("n", "s", "k"), rows, schema) == ["1 Main St", ""]
    assert values(spark, t.postal_line(("n", "s", "k", "u"), "city", "zip"), rows, schema) == ["1 Main St, X", ""]


def test_normalize_for_clones(spark):
    rows = [("call(\"a\", 'b')  +  12",), ("x1 1x 12\n\n3",), ("don't 'stop",), ("é12 12",), ("",)]
    assert values(spark, t.normalize_for_clones("s"), rows, "s string") == [
        "call(STR, STR) + NUM",
        "x1 1x NUM NUM",
        "donSTRstop",
        "é12 NUM",
        "",
    ]


def test_path_labels(spark):
    rows = [("/a/data_quality/02_x.y.py",), ("03_gold",), ("C:\\p\\01_b.py",), ("/a/.hidden",)]
    name = t.file_name("p")
    assert values(spark, name, rows, "p string") == ["02_x.y.py", "03_gold", "01_b.py", ".hidden"]
    assert values(spark, t.file_stem("p"), rows, "p string") == ["02_x.y", "03_gold", "01_b", ".hidden"]
    assert values(spark, t.layer_of(name), rows, "p string") == ["silver", "gold", "bronze", "unknown"]
    assert values(spark, t.layer_of(name, "catalog"), rows, "p string")[3] == "catalog"
    assert values(spark, t.is_quality_path("p"), rows, "p string") == [True, False, False, False]


def test_variant_label(spark):
    rows = [("Declarative",), ("dec",), ("imp",), (None,)]
    assert values(spark, t.variant_label("s"), rows, "s string") == [
        "declarative",
        "declarative",
        "imperative",
        "imperative",
    ]


def test_price_band_boundaries(spark):
    rows = [(Decimal(v),) for v in ("-1", "9.99", "10", "49.99", "50", "99.99", "100")] + [(None,)]
    assert values(spark, m.price_band(F.col("p")), rows, "p decimal(7,2)") == [
        "Low (< 10)",
        "Low (< 10)",
        "Medium (10-50)",
        "Medium (10-50)",
        "High (50-100)",
        "High (50-100)",
        "Premium (>= 100)",
        "Premium (>= 100)",
    ]
    assert values(spark, m.price_band(F.col("p"), "Unknown"), rows, "p decimal(7,2)")[-1] == "Unknown"


def test_store_size_band_boundaries(spark):
    rows = [(99,), (100,), (199,), (200,), (299,), (300,), (None,)]
    assert values(spark, m.store_size_band(F.col("n")), rows, "n int") == [
        "Small (< 100)",
        "Medium (100-200)",
        "Medium (100-200)",
        "Large (200-300)",
        "Large (200-300)",
        "Very Large (>= 300)",
        "Very Large (>= 300)",
    ]


def test_age(spark):
    age = m.age_at(F.lit(date(2024, 6, 1)), F.col("y"))
    rows = [(2000,), (1999,), (1985,), (1984,), (1970,), (1969,), (1950,), (1949,), (None,)]
    assert values(spark, age, rows, "y int") == [24, 25, 39, 40, 54, 55, 74, 75, None]
    assert values(spark, m.age_band(age), rows, "y int") == [
        "Gen Z (< 25)",
        "Millennials (25-39)",
        "Millennials (25-39)",
        "Gen X (40-54)",
        "Gen X (40-54)",
        "Baby Boomers (55-74)",
        "Baby Boomers (55-74)",
        "Silent Generation (75+)",
        "Unknown",
    ]


def test_ratios(spark):
    schema = "l decimal(7,2), s decimal(7,2)"
    rows = [
        (Decimal("100"), Decimal(v)) for v in ("100", "90", "89.99", "75", "74.99", "50", "49.99", "120")
    ] + [(Decimal("0"), Decimal("1")), (None, Decimal("1")), (Decimal("1"), None)]
    listed, sold = F.col("l"), F.col("s")
    assert values(spark, m.discount_band(listed, sold), rows, schema) == [
        "No Discount",
        "Small (0-10%)",
        "Medium (10-25%)",
        "Medium (10-25%)",
        "Large (25-50%)",
        "Large (25-50%)",
        "Very Large (> 50%)",
        "Small (0-10%)",
        "No List Price",
        "No List Price",
        "Very Large (> 50%)",
    ]
    percents = values(spark, m.discount_percent(listed, sold), rows, schema)
    assert percents[:2] == [Decimal("0.00"), Decimal("10.00")]
    assert percents[7:] == [Decimal("-20.00"), None, None, None]
    settled = values(spark, m.or_zero(m.discount_percent(listed, sold)), rows, schema)
    assert settled[8:] == [Decimal("0.00")] * 3


def test_margin_and_per_unit(spark):
    rows = [(Decimal("3.00"), Decimal("1.00"), 7), (Decimal("0.00"), Decimal("1.00"), 0), (None, None, None)]
    schema = "p decimal(7,2), c decimal(7,2), q int"
    assert values(spark, m.margin_percent(F.col("p"), F.col("c")), rows, schema) == [Decimal("66.67"), None, None]
    assert values(spark, m.per_unit(F.col("p"), F.col("q")), rows, schema) == [Decimal("0.43"), None, None]


def test_percent_change(spark):
    rows = [(843.2, 751.67), (1417.6, 1487.33), (0.0, 1.0), (None, 1.0)]
    assert values(spark, m.percent_change(F.col("a"), F.col("b")), rows, "a double, b double") == [
        -10.86,
        4.92,
        None,
        None,
    ]
    assert values(spark, m.seconds_to_minutes(F.col("a")), rows[:1], "a double, b double") == [
        pytest.approx(14.0533, abs=1e-4)
    ]


def test_counts_on_empty_and_null(spark):
    empty = spark.createDataFrame([], "x int")
    row = empty.agg(a.count_if(F.col("x") > 0), a.pct_null(F.col("x")), a.row_count()).first()
    assert tuple(row) == (0, None, 0)
    some = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert tuple(some.agg(a.count_if(F.col("x") > 0), a.pct_null(F.col("x"))).first()) == (1, 33.33)
