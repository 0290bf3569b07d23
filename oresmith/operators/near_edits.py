"""Texts that an earlier text turns into by few edits.

Similarity of two texts is 1 - d / n, with their edit distance d over characters and the greater
length n. The result is one row per redundant text, never one per pair. Equal texts are counted
out first. Two texts that reach the share ``t`` are at most k = (1 - t) n edits apart, and an edit
changes at most q of the q-grams, so at least c = n - q + 1 - k q grams of both stay, in the same
order, each shifted by k places at most. Exact filters follow, all of them conditions of one join:

* prefix: with grams ordered by rarity, the rarest that stays is among the first
  |grams| - c + 1 of either text;
* position: its places in the two texts differ by k at most;
* length: the shorter text has at least t n characters.

Texts too short to keep a gram of q characters are joined by their characters instead. Candidates
are verified by an edit distance that stops at k. They are compared in rounds: first with the
earliest text under each of their grams, which settles the members of a large family of near
copies in one comparison each, then those still open with all other texts that pass the filters.
That step grows with the square of the texts that share rare grams without being similar; a
share near 1 makes prefixes short and the step small.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oresmith.functions.aggregates import row_count
from oresmith.functions.text import normalize_for_clones
from oresmith.session import shared_folder, stored

GRAM = 3


def least_length(share: Fraction, gram: int) -> int:
    """The length from which on texts that reach the share keep a gram of that many characters."""
    enough = int(gram / (1 - gram * (1 - share))) + 1
    without = [n for n in range(1, enough) if n - gram + 1 - int((1 - share) * n) * gram < 1]
    return max(without, default=0) + 1


def _grams(texts: DataFrame, share: Column, smallest: Fraction, gram: int) -> DataFrame:
    """(id, n, q, token, place, first, last): per text its rarest grams that can be the one kept.

    ``place`` is the gram's first position among the text's grams, rarest first; ``first`` and
    ``last`` are its places in the text. A gram that repeats is one row.
    """
    from_length = least_length(smallest, gram)

    def spread(rows: DataFrame, q: int) -> DataFrame:
        places = F.sequence(F.lit(1), F.col("n") - q + 1)
        each = rows.where(F.col("n") >= q).select("id", "n", F.col("text"), F.explode(places).alias("at"))
        token = F.xxhash64(F.lit(q), F.col("text").substr(F.col("at"), F.lit(q)))
        per_gram = each.select("id", "n", token.alias("token"), "at").groupBy("id", "n", "token")
        found = per_gram.agg(F.min("at").alias("first"), F.max("at").alias("last"), row_count().alias("times"))
        return found.withColumn("q", F.lit(q))

    # A pair is compared by the grams that its longer text needs, so texts near the border have both.
    long = spread(texts.where(F.col("n") >= F.ceil(share * from_length)), gram)
    short = spread(texts.where(F.col("n") < from_length), 1)
    grams = long.union(short)
    frequency = grams.groupBy("token").agg(row_count().alias("texts")).where("texts > 1")
    # Grams of a single text come before all shared ones and fill the prefix for them.
    of_text = Window.partitionBy("id", "q")
    rarest = of_text.orderBy("texts", "token").rowsBetween(Window.unboundedPreceding, -1)
    shared = grams.join(frequency, "token")
    ranked = shared.withColumns(
        {
            "before": F.coalesce(F.sum("times").over(rarest), F.lit(0)),
            "shared": F.sum("times").over(of_text),
        }
    )
    place = F.col("before") + (F.col("n") - F.col("q") + 1 - F.col("shared")) + 1
    # No partner needs more: each further character of it allows less than 1 / q of an edit.
    most = (F.floor((1 - share) * F.col("n")) + 1) * F.col("q") + 1
    return ranked.withColumn("place", place).where(F.col("place") <= most).select(
        "id", "n", "q", "token", "place", "first", "last"
    )


def _comparable(share: Column, from_length: int, other: str) -> Column:
    """Whether two texts can reach the share through this gram; the other's columns are prefixed."""

    def o(name: str) -> Column:
        return F.col(f"{other}{name}")

    q, n, m = F.col("q"), F.col("n"), o("n")
    most, least = F.greatest(n, m), F.least(n, m)
    k = F.floor((1 - share) * most)
    kept = most - q + 1 - k * q
    prefix = (F.col("place") <= n - q + 1 - kept + 1) & (o("place") <= m - q + 1 - kept + 1)
    position = (F.col("first") - k <= o("last")) & (o("first") - k <= F.col("last"))
    # Each pair under one kind of gram only.
    kind = F.when(most >= from_length, q > 1).otherwise(q == 1)
    return (o("id") < F.col("id")) & (least >= share * most) & prefix & position & kind


def _close(pairs: DataFrame, texts: DataFrame, share: Column) -> DataFrame:
    """Ids of the pairs (id, earlier) whose texts reach the share."""
    mine = texts.select("id", F.col("n"), F.col("text").alias("a"))
    theirs = texts.select(F.col("id").alias("earlier"), F.col("n").alias("m"), F.col("text").alias("b"))
    both = pairs.join(mine, "id").join(theirs, "earlier")
    bounded = both.withColumn("k", F.floor((1 - share) * F.greatest("n", "m")).cast("int"))
    # Beyond its third argument the distance is not computed to the end, and is -1.
    return bounded.where(F.expr("levenshtein(a, b, k) >= 0")).select("id").distinct()


def near_edits(
    df: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, gram: int = GRAM
) -> DataFrame:
    """Ids of the texts for which an earlier text (smaller id) reaches ``threshold``.

    Texts are compared after ``normalize_for_clones`` over lower case; NULL counts as empty, and
    empty texts equal each other. Ids must differ and not be NULL. ``threshold`` must be at least 1 - 1 / gram.
    The steps go to the shared folder; the call runs the jobs that fill them.
    """
    smallest = Fraction(Decimal(str(threshold)))
    if gram * (1 - smallest) >= 1:
        raise ValueError(f"texts that reach {threshold} need not keep a gram of {gram} characters")
    folder = shared_folder(df.sparkSession, "near-edits")
    share = F.lit(Decimal(str(threshold)))
    text = F.coalesce(normalize_for_clones(F.lower(text_column)), F.lit(""))
    every = df.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("mark", F.sha2("text", 256))
    every = stored(every.withColumn("n", F.char_length("text")), folder, "texts")
    originals = stored(every.groupBy("mark").agg(F.min("id").alias("first_id")), folder, "originals")
    copies = every.select("id", "mark").join(originals, "mark").where(F.col("id") > F.col("first_id")).select("id")

    texts = every.join(originals.select(F.col("first_id").alias("id")), "id", "left_semi")
    grams = stored(_grams(texts.select("id", "n", "text"), share, smallest, gram), folder, "grams")
    comparable = _comparable(share, least_length(smallest, gram), "o_")

    other = [F.col(c).alias(f"o_{c}") for c in ("id", "n", "place", "first", "last")]
    heads = grams.groupBy("token").agg(F.min(F.struct("id", "n", "place", "first", "last")).alias("head"))
    heads = heads.select("token", *[F.col(f"head.{c}").alias(f"o_{c}") for c in ("id", "n", "place", "first", "last")])
    first_pairs = grams.join(heads, "token").where(comparable).select("id", F.col("o_id").alias("earlier")).distinct()
    settled = stored(_close(first_pairs, every, share), folder, "settled")
    tried = stored(first_pairs, folder, "tried")
    open_grams = grams.join(settled, "id", "left_anti")
    rest = open_grams.join(grams.select("token", *other), "token").where(comparable)
    rest = rest.select("id", F.col("o_id").alias("earlier")).distinct().join(tried, ["id", "earlier"], "left_anti")
    late = _close(rest, every, share)
    return copies.union(settled).union(late).select(F.col("id").alias(id_column))
