"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is dropped when an earlier line of the corpus (smaller document id, then smaller line
number) is equal to it or at most one edit away: one character inserted, deleted or replaced.
The earlier line counts whether or not it is itself dropped.

Two lines one replacement apart become equal when the same character position is deleted from
both; two lines one insertion apart become equal when one character is deleted from the longer.
So each line emits the hashes of its deletion variants, with the deleted position, and of
itself, and equal keys are joined. Lines that share variant and position are all one edit from
each other, so each is compared with the earliest of them only, and at most one line is equal
to a variant: the work is linear in the variants, also where thousands of lines are alike.
Found pairs are verified by edit distance.

Variants are many, so only lines with a chance of a partner emit them: lines one edit apart
agree in one of two halves, and in seven of eight equal parts (of the shorter length), so a line
that shares no half, or no seven eighths, with another has no partner. Lines are told apart by
two 64-bit hashes, variants by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oresmith.llm.common import semi_join, step_folder, stored

MIN_CHARS = 10
_LINE = ["h1", "h2"]
_FEW = 2_000_000  # rows of one or two hashes


def _two_hashes(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def _first_line(id_column: str, line_number: str = "line_number") -> Column:
    """Sorts occurrences: by document id (NULL last), then line number."""
    return F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("doc"), F.col(line_number))


def text_lines(docs: DataFrame, id_column: str, text_column: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_hash, line_number, line, n, h1, h2) for the lines that take part.

    Lines end at line feeds and are numbered from 0. Those shorter than ``min_chars`` without
    white space around them take no part: they are never dropped and drop nothing.
    """
    text = F.col(text_column)
    lines = docs.select(
        F.col(id_column).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n"))
    )
    lines = lines.select("doc", "text_hash", F.col("pos").alias("line_number"), F.col("col").alias("line"))
    lines = lines.where(F.char_length(F.trim("line")) >= min_chars)
    h1, h2 = _two_hashes(F.col("line"))
    return lines.select("*", F.char_length("line").alias("n"), h1.alias("h1"), h2.alias("h2"))


def _shared_parts(parts: int) -> Column:
    """Hashes of the line without one of ``parts`` equal parts, for pairs whose shorter line has
    ``n`` or ``n - 1`` characters. Lines one edit apart agree outside the part with the edit."""
    line, keys = F.col("line"), []
    for shorter in (F.col("n"), F.col("n") - 1):
        for part in range(parts):
            left = F.floor(shorter * part / parts).cast("int")
            right = (shorter - F.floor(shorter * (part + 1) / parts)).cast("int")
            ends = F.substring(line, F.lit(1), left), F.substring(line, F.col("n") - right + 1, right)
            keys.append(F.xxhash64(F.lit(part), shorter, *ends))
    return F.array(*keys)


def _deletions() -> Column:
    """(position, key): hash of every deletion variant, and of the line itself at -1."""
    line = F.col("line")

    def variant(i: Column) -> Column:
        shorter = F.concat(F.substring(line, F.lit(1), i), F.substring(line, i + 2, F.col("n")))
        return F.struct(i.alias("position"), F.xxhash64(F.when(i < 0, line).otherwise(shorter)).alias("key"))

    return F.transform(F.sequence(F.lit(-1), F.col("n") - 1), variant)


def _sharing(lines: DataFrame, keys: Column, folder: str, name: str) -> DataFrame:
    """(h1, h2) of the lines that share one of their keys with a different line."""
    spread = lines.select(*_LINE, F.explode(keys).alias("key"))
    line = F.struct(*_LINE)
    shared = spread.groupBy("key").agg(F.min(line).alias("a"), F.max(line).alias("b")).where("a <> b")
    shared = stored(shared.select("key"), folder, f"{name}-keys")
    return stored(semi_join(spread, shared, ["key"], _FEW).select(*_LINE).distinct(), folder, name)


def dropped_lines(docs: DataFrame, id_column: str, text_column: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_hash, line_number) of the line occurrences that have an earlier equal or near line.

    The steps are stored, and the call runs the jobs that fill them.
    """
    spark = docs.sparkSession
    folder = step_folder(spark, "line-dedup")

    # Every distinct line once, with its first occurrence and its half keys; no text moves.
    occurrences = text_lines(docs, id_column, text_column, min_chars)
    distinct = occurrences.select(*_LINE, "n", _first_line("doc").alias("first"), _shared_parts(2).alias("halves"))
    distinct = distinct.groupBy(*_LINE).agg(
        F.count(F.lit(1)).alias("times"), F.min("first").alias("first"), F.first("halves").alias("halves")
    )
    distinct = stored(distinct, folder, "lines")

    # The texts of lines that share a half, and of those the ones that share seven eighths.
    hopeful = _sharing(distinct, F.col("halves"), folder, "sharing-halves")
    with_text = semi_join(occurrences.select(*_LINE, "n", "line"), hopeful, _LINE, _FEW)
    with_text = with_text.groupBy(*_LINE).agg(F.first("n").alias("n"), F.first("line").alias("line"))
    texts = stored(with_text.join(distinct.select(*_LINE, "first"), _LINE), folder, "texts")
    likely = _sharing(texts, _shared_parts(8), folder, "sharing-eighths")
    spread = texts.join(likely, _LINE, "left_semi").repartition(*_LINE)
    spread = spread.select(*_LINE, "first", F.explode(_deletions()).alias("v"))
    variants = spread.select("v.position", "v.key", F.struct("first", *_LINE).alias("line"))
    variants = stored(variants, folder, "variants")

    deleted = variants.where("position >= 0")
    earliest = deleted.groupBy("key", "position").agg(F.min("line").alias("other"), F.count(F.lit(1)).alias("lines"))
    earliest = stored(earliest.where("lines > 1").drop("lines"), folder, "replaced")
    replaced = deleted.join(earliest, ["key", "position"]).select("line", "other")
    whole = variants.where("position = -1").select("key", F.col("line").alias("whole"))
    inserted = stored(deleted.join(whole, "key").select("line", "whole").distinct(), folder, "inserted")
    pairs = replaced.union(inserted.toDF("line", "other"))
    pairs = pairs.union(inserted.select(F.col("whole").alias("line"), F.col("line").alias("other")))
    pairs = pairs.where("other < line").distinct()

    # Verified by edit distance, each line against the earlier ones found for it.
    mine = texts.select(*_LINE, F.col("line").alias("text"))
    theirs = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other_text"))
    flat = pairs.select("line.h1", "line.h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    flat = stored(flat, folder, "pairs")
    checked = flat.join(mine, _LINE).join(theirs, ["o1", "o2"])
    distance = F.levenshtein(F.col("text"), F.col("other_text"), 1)
    near = stored(checked.where(distance >= 0).select(*_LINE).distinct(), folder, "near")

    # Lines of a single occurrence that are near no earlier one need no second look.
    doubtful = distinct.select(*_LINE, "times", "first").join(near.withColumn("near", F.lit(True)), _LINE, "left")
    doubtful = stored(doubtful.where("times > 1 OR near"), folder, "doubtful")
    found = occurrences.select("doc", "text_hash", "line_number", *_LINE).join(doubtful, _LINE)
    later = _first_line("doc") > F.col("first")
    return found.where(F.col("near") | later).select("doc", "text_hash", "line_number")


def without_repeated_lines(
    docs: DataFrame, id_column: str, text_column: str, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Every row of ``docs`` with all its columns, its text without the dropped lines.

    Three columns follow: ``n_lines`` and ``n_dropped`` (int), and ``emptied``, true where
    lines were dropped and no visible character is left. Texts that are NULL stay NULL with 0
    lines. Rows that repeat an id and its text are treated alike; rows that repeat an id only
    are told apart by their texts. Columns of those three names are replaced.
    """
    dropped = dropped_lines(docs, id_column, text_column, min_chars)
    dropped = dropped.groupBy("doc", "text_hash").agg(F.collect_set("line_number").alias("numbers"))
    dropped = dropped.select(
        F.struct(F.col("doc").alias("id"), F.col("text_hash").alias("hash")).alias("key"), F.col("numbers")
    )
    text, lines = F.col(f"row.{text_column}"), F.col("lines")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = packed.withColumn("key", F.struct(F.col(f"row.{id_column}").alias("id"), F.xxhash64(text).alias("hash")))
    # A NULL inside a struct equals a NULL there, so rows without an id find theirs too.
    joined = packed.join(dropped, packed["key"].eqNullSafe(dropped["key"]), "left")
    joined = joined.select("row", "numbers", F.split(text, "\n").alias("lines"))
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("numbers", i)), "\n")
    new_text = F.when(F.col("numbers").isNull(), text).otherwise(kept)
    results = {
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)),
        "n_dropped": F.when(F.col("numbers").isNull(), 0).otherwise(F.size("numbers")),
    }
    columns = [
        (new_text if c == text_column else F.col(f"row.`{c}`")).alias(c)
        for c in docs.columns
        if c not in {*results, "emptied"}
    ]
    result = joined.select(*columns, *[v.alias(k) for k, v in results.items()])
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.translate(text_column, "\n\t\r", "")) == "")
    return result.withColumn("emptied", F.coalesce(emptied, F.lit(False)))
