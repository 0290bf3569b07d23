"""String clean-up and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions of the clone normaliser, in the order they apply. Looking for
# a digit first changes no match; it spares the costlier word-border test at other characters.
CLONE_PATTERNS = (
    (r""""[^"\n]*"|'[^'\n]*'""", "STR"),
    (r"(?U)(?=\d)\b\d+\b", "NUM"),
    (r"(?U)\s+", " "),
)


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def trim_to_null(column: str | Column) -> Column:
    """Trim spaces; an empty result becomes NULL."""
    return F.nullif(F.trim(_col(column)), F.lit(""))


def year_month(year: str | Column, month: str | Column) -> Column:
    """``YYYY-MM``; NULL if either part is NULL."""
    return F.concat(
        _col(year).cast("string"), F.lit("-"), F.lpad(_col(month).cast("string"), 2, "0")
    )


def quarter_year(quarter: str | Column, year: str | Column) -> Column:
    """``Qn YYYY``; NULL if either part is NULL."""
    return F.concat(
        F.lit("Q"), _col(quarter).cast("string"), F.lit(" "), _col(year).cast("string")
    )


def yes_flag(column: str | Column) -> Column:
    """True for 'Y'; False for anything else, NULL included."""
    return F.coalesce(_col(column) == "Y", F.lit(False))


def open_ended(*columns: str | Column) -> Column:
    """True when none of the end markers is set."""
    result = F.lit(True)
    for column in columns:
        result = result & _col(column).isNull()
    return result


def spaced(*columns: str | Column) -> Column:
    """Join the non-NULL parts with single spaces."""
    return F.concat_ws(" ", *[_col(c) for c in columns])


def postal_line(street: tuple, *rest: str | Column) -> Column:
    """Street parts joined by spaces, then the other parts joined by commas; NULL parts vanish."""
    return F.concat_ws(", ", spaced(*street), *[_col(c) for c in rest])


def normalize_for_clones(column: str | Column) -> Column:
    """Replace quoted text by STR, numbers by NUM, and squeeze white space."""
    text = _col(column)
    for pattern, replacement in CLONE_PATTERNS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def layer_of(file_name: str | Column, default: str = "unknown") -> Column:
    """Layer named by the two-digit prefix of a file name."""
    name = _col(file_name)
    return (
        F.when(name.startswith("01_"), "bronze")
        .when(name.startswith("02_"), "silver")
        .when(name.startswith("03_"), "gold")
        .otherwise(default)
    )


def file_name(path: str | Column) -> Column:
    """Last part of a path."""
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def file_stem(path: str | Column) -> Column:
    """Last part of a path without its final extension; a leading dot belongs to the stem."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def is_quality_path(path: str | Column) -> Column:
    return F.contains(F.replace(_col(path), F.lit("\\"), F.lit("/")), F.lit("data_quality"))


def variant_label(column: str | Column) -> Column:
    """``dec…`` in any case is declarative, everything else imperative."""
    return F.when(F.lower(_col(column)).startswith("dec"), "declarative").otherwise("imperative")
