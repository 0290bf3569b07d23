"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Texts are one group when they are identical; a digest only says where they meet. Every stage that
merges rows has the whole text among its grouping keys, so no two texts are ever taken for one:

1. locally: every task merges the equal texts it has read (the map side of the aggregation);
2. salted: what is left meets by digest and salt. A digest of few rows has one salt, so it is
   settled here. One of many rows has a salt per reading task, so that no task gets more of its
   texts than a share of the reading tasks;
3. globally: the winners of the salts, one text per digest and salt, are merged once more.

How many rows a digest has is counted before, on digests alone, and combined in every task. The
bound of "many" grows with the table, so that there are never more than ``MOST_HOT`` such digests;
these alone are broadcast. All others are joined back by a shuffle, in which no digest has many.

A digest that ends with one text has been compared on all its rows, so these rows are found by
digest alone. Only the rows of a digest with several texts are joined back by digest and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oresmith.llm.common import step_folder, stored

HOT, MOST_HOT = 1_000, 100_000


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salts(docs: DataFrame) -> int:
    return max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _last_row() -> Column:
    """The greatest id, and of its rows the first."""
    return F.max(F.struct("id", (-F.col("row")).alias("minus_row"))).alias("last")


def _collided(marked: DataFrame, colliding: DataFrame, folder: str) -> DataFrame:
    """Result rows of the digests that stand for several texts, told apart by their texts."""
    rows = marked.join(colliding, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, folder, "collided")
    groups = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), _last_row())
    return rows.join(groups, ["digest", "text"]).select("id", "digest", "row", "n", "last")


def exact_groups(
    docs: DataFrame,
    id_column: str,
    text: str | Column,
    digest: Callable[[Column], Column] = sha256_digest,
    hot: int = HOT,
) -> DataFrame:
    """id, keep_id, group_size, kept, digest: one row for every row of ``docs``.

    Rows with identical texts are one group, of any size; a NULL text counts as empty. The row
    with the greatest id stays (``kept``), a NULL id only where no row of the group has one. Of
    rows that repeat an id and its text one stays. ``text`` may be an expression that normalises
    the text before. An empty table gives an empty result; other columns play no part. The steps
    are stored, and the call runs the jobs that fill them.
    """
    folder = step_folder(docs.sparkSession, "exact-dedup")
    text = F.col(text) if isinstance(text, str) else text
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    marked = source.withColumn("digest", digest(F.col("text")))

    # Rows without their texts, and how often every digest comes.
    rows = marked.select("id", "digest").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, folder, "rows")
    tally = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), _last_row())
    tally = stored(tally, folder, "tally")
    many = max(hot, -(-rows.count() // MOST_HOT))
    frequent = stored(tally.where(F.col("rows") >= many).select("digest"), folder, "frequent")

    # Stages 1 and 2. Settled texts are not needed any more.
    spread = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(_salts(docs))) + 1
    dealt = marked.join(F.broadcast(frequent.withColumn("many", F.lit(True))), "digest", "left")
    dealt = dealt.select("id", "text", "digest", F.when(F.col("many"), spread).otherwise(0).alias("salt"))
    salted = dealt.groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    open_text = F.when(F.col("salt") > 0, F.col("text")).alias("text")
    salted = stored(salted.select("digest", "salt", open_text, "keep_id", "n"), folder, "salted")

    # Stage 3, of the salts' winners.
    settled = salted.where("salt = 0").select("digest", "keep_id", "n", F.lit(False).alias("many"))
    winners = salted.where("salt > 0").groupBy("digest", "text")
    winners = winners.agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = settled.union(winners.select("digest", "keep_id", "n", F.lit(True).alias("many")))
    groups = stored(groups, folder, "groups")

    # Digests of one text give their rows the group; the place of the kept row is in the tally.
    texts = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    colliding = stored(texts.where("texts > 1").select("digest"), folder, "colliding")
    single = groups
    if colliding.limit(1).count():
        single = groups.join(colliding, "digest", "left_anti")
    single = stored(single.join(tally, "digest").select("digest", "n", "many", "last"), folder, "single")
    few = rows.join(F.broadcast(frequent), "digest", "left_anti").join(single.where("NOT many"), "digest")
    hot_rows = rows.join(F.broadcast(single.where("many")), "digest")
    columns = ["id", "digest", "row", "n", "last"]
    found = few.select(*columns).union(hot_rows.select(*columns))
    if colliding.limit(1).count():
        found = found.union(_collided(marked, colliding, folder).select(*columns))
    return found.select(
        F.col("id").alias(id_column),
        F.col("last.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("last.minus_row") == -F.col("row")).alias("kept"),
        "digest",
    )


def without_copies(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that repeat an id and its text, the first that Spark meets is the one returned.
    """
    groups = exact_groups(docs, id_column, text_column).where("kept")
    stay = groups.select(F.struct(F.col(id_column).alias("id"), F.col("digest")).alias("stay"))
    # Whatever the columns are called, they come back beside the key.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, plain))
    text = F.coalesce(F.col(names[text_column]), F.lit(""))
    key = F.struct(F.col(names[id_column]).alias("id"), sha256_digest(text).alias("digest"))
    keyed = docs.toDF(*plain).withColumn("key", key)
    # A NULL inside a struct equals a NULL there.
    kept = keyed.join(stay, keyed["key"] == stay["stay"], "left_semi").dropDuplicates(["key"])
    return kept.select(*plain).toDF(*docs.columns)
