"""Text tables: corpus scan, pattern lines, identifiers, repeated blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oresmith.functions.aggregates import row_count
from oresmith.functions.text import (
    file_name,
    file_stem,
    is_quality_path,
    layer_of,
    normalize_for_clones,
)
from oresmith.session import shared_folder, stored

# Line ends, and the white space that may surround a line.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
SKIPPED_LINE = r"(?U)^\s*(#|$)"


def text_files(spark: SparkSession, folder: str, suffix: str = ".py") -> DataFrame:
    """One row per file below a folder: its path and whole text."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .text(folder, wholetext=True)
    )
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, folder: str, suffix: str = ".py") -> DataFrame:
    """One row per line of the files below a folder: path, line_number from 0, line.

    Files larger than a task are read by block, by as many tasks as they have blocks, so a file may
    be of any size. A line is numbered within its block; the counts of the blocks before, a few per
    file, give every block its start. Lines end at line feeds, carriage returns or both.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            F.col("value").alias("line"),
        )
    )
    in_block = Window.partitionBy("path", "block").orderBy("place")
    numbered = lines.withColumn("in_block", F.row_number().over(in_block) - 1)
    counts = lines.groupBy("path", "block").agg(row_count().alias("lines"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    found = numbered.join(starts, ["path", "block"])
    return found.select("path", (F.col("start") + F.col("in_block")).alias("line_number"), "line")


def file_counts(lines: DataFrame, patterns: Sequence[str], id_patterns: Sequence[str]) -> DataFrame:
    """Per file of ``text_lines``: lines, code lines, code lines with a pattern, identifiers.

    The counts are those of the whole text, as no pattern reaches over the end of a line; they are
    added up in every task, so a large file does not meet in one.
    """
    counted = pattern_lines(lines, "line", patterns)
    found = F.size(identifiers(F.col("line"), id_patterns))
    return counted.groupBy("path").agg(
        row_count().alias("lines"),
        F.sum("code_lines").alias("code_lines"),
        F.sum("pattern_lines").alias("pattern_lines"),
        F.sum(found).alias("identifiers"),
    )


def with_path_labels(df: DataFrame, path: str = "path", default_layer: str = "unknown") -> DataFrame:
    """Add what a file's path says about it: name, job, layer, and whether it checks quality."""
    return df.withColumns(
        {
            "file_name": file_name(path),
            "job": file_stem(path),
            "layer": layer_of(file_name(path), default_layer),
            "is_data_quality": is_quality_path(path),
        }
    )


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor comments."""
    return F.filter(F.split(text, LINE_END, -1), lambda line: ~line.rlike(SKIPPED_LINE))


def matches_any(patterns: Sequence[str]):
    """Predicate on a line: one of the patterns occurs in it."""
    either = "|".join(f"(?:{p})" for p in patterns)
    return lambda line: line.rlike(either)


def pattern_lines(df: DataFrame, text: str, patterns: Sequence[str]) -> DataFrame:
    """Add the number of code lines and of code lines with a pattern; no shuffle."""
    lines = df.withColumn("__lines", code_lines(F.col(text)))
    counts = {
        "code_lines": F.size("__lines"),
        "pattern_lines": F.size(F.filter("__lines", matches_any(patterns))),
    }
    return lines.withColumns(counts).drop("__lines")


def identifiers(text: Column, patterns: Sequence[str]) -> Column:
    """All matches of the patterns' first group in a text."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])


def extracted(df: DataFrame, text: str, patterns: Sequence[str], name: str) -> DataFrame:
    """One row per match of the patterns' first group, beside the other columns."""
    found = identifiers(F.col(text), patterns)
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(found).alias(name))


def identifier_counts(df: DataFrame, document: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """Occurrences of each identifier and the documents it occurs in."""
    ids = extracted(df.select(document, text), text, patterns, "identifier")
    per_document = ids.groupBy("identifier", document).agg(row_count().alias("n"))
    return per_document.groupBy("identifier").agg(
        F.sum("n").alias("occurrences"), row_count().alias("documents")
    )


def normalized_blocks(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per non-blank line: the fingerprint of its text, normalised so that literals do
    not matter. Sixteen bytes travel through the shuffles instead of the line."""
    block = normalize_for_clones("line")
    lines = df.select(*keep, F.explode(F.split(F.col(text), LINE_END, -1)).alias("line"))
    blocks = lines.select(*keep, block.alias("text")).where(F.col("text") != "")
    return blocks.select(*keep, F.unhex(F.md5("text")).alias("block"))


def _pairs_of(n: Column) -> Column:
    """Pairs among ``n`` equal things, as a decimal: a common line has more than fit a bigint."""
    twice = n.cast("decimal(19,0)") * (n - 1).cast("decimal(19,0)")
    return (twice / 2).cast("decimal(38,0)")


def clone_report(df: DataFrame, text: str, by: str) -> DataFrame:
    """Repeated blocks per group: blocks, distinct blocks, distinct blocks that recur anywhere.

    A block that occurs once in all groups is charged to the one group it is in, so nothing is
    joined back on the block and no two copies of a block have to meet. Pairs of equal blocks
    inside a group follow from their number. The counts per block and group are stored, so the
    texts are read once; the call runs that job.
    """
    per_group = normalized_blocks(df, text, [by]).groupBy("block", by).agg(row_count().alias("n"))
    per_group = stored(per_group, shared_folder(df.sparkSession, "clones"), "blocks")
    totals = per_group.groupBy(by).agg(
        F.sum("n").alias("total_blocks"),
        row_count().alias("distinct_blocks"),
        F.sum(_pairs_of(F.col("n"))).alias("equal_pairs"),
    )
    lonely = (
        per_group.groupBy("block")
        .agg(F.sum("n").alias("n"), F.min(by).alias(by))
        .where(F.col("n") == 1)
        .groupBy(by)
        .agg(row_count().alias("lonely_blocks"))
    )
    return totals.join(lonely, by, "left").select(
        by,
        "total_blocks",
        (F.col("distinct_blocks") - F.coalesce("lonely_blocks", F.lit(0))).alias("duplicated_blocks"),
        "equal_pairs",
    )
