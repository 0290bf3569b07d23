"""Foreign keys of a fact against its dimensions.

No join is hinted: Spark broadcasts a dimension's key column only below its configured size
limit and otherwise shuffles both sides, where a hot key is split by the adaptive skew join.
Keys are compared in their own type. Rows without a foreign key would all meet in one shuffle
partition, so a salt travels beside the key: 0 with every key, scattered for missing ones.

Spark's size of a stored dimension is that of its compressed files, by which keys that take
hundreds of megabytes in the driver pass for a few. ``counted`` references do not depend on it:
many keys become words of 64 neighbours, broadcast or shuffled by their true number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oresmith.session import broadcast_limit

_SPREAD = 1 << 20
_KEY = "__reference_key"
_SALT = "__reference_salt"
_FOUND = "__reference_found"
_WORD = "__reference_word"
_BITS = "__reference_bits"
_WHOLE = ("tinyint", "smallint", "int", "bigint")
# Two numbers and the NULL bits, as Spark lays out a row.
_ROW_BYTES = 24
# Beyond the words of all keys, which are their upper 58 bits.
_NO_WORD = 1 << 57


@dataclass(frozen=True)
class Reference:
    """A foreign-key column, the dimension it points to, and whether it may be missing.

    ``words`` is the number of the dimension's key words, where ``counted`` found many keys.
    """

    column: str
    dimension: DataFrame
    key: str
    flag: str
    required: bool = False
    words: int | None = None


def key_words(dimension: DataFrame, key: str) -> DataFrame:
    """(word, bits): whole-number keys, up to 64 neighbours in a row; never more rows than keys."""
    number = F.col(key).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(63).cast("int"))
    keys = dimension.where(F.col(key).isNotNull()).select(F.shiftright(number, 6).alias(_WORD), bit.alias(_BITS))
    return keys.groupBy(_WORD).agg(F.bit_or(_BITS).alias(_BITS))


def _numbered_rows(frames: Mapping[int, DataFrame]) -> dict[int, int]:
    """The rows of each frame, counted in one job."""
    rows = [df.select(F.lit(n).alias("n")) for n, df in frames.items()]
    found = reduce(DataFrame.union, rows).groupBy("n").count().collect() if rows else []
    return dict.fromkeys(frames, 0) | {r["n"]: r["count"] for r in found}


def counted(references: Sequence[Reference]) -> list[Reference]:
    """The references, those to many keys with their key words counted; for stored dimensions, which are read for it.

    Keys that Spark may broadcast by their true number stay as they are, and so do those that are
    no whole numbers.
    """
    whole = {n: r for n, r in enumerate(references) if dict(r.dimension.dtypes)[r.key] in _WHOLE}
    rows = _numbered_rows({n: r.dimension for n, r in whole.items()})
    many = {n: r for n, r in whole.items() if not _fits(r.dimension, rows[n])}
    words = _numbered_rows({n: key_words(r.dimension, r.key) for n, r in many.items()})
    return [replace(r, words=words.get(n)) for n, r in enumerate(references)]


def _fits(frame: DataFrame, rows: int) -> bool:
    """Whether so many keys or words are within Spark's limit for broadcasts."""
    return rows * _ROW_BYTES <= broadcast_limit(frame.sparkSession)


def _in_words(fact: DataFrame, ref: Reference) -> bool:
    return ref.words is not None and dict(fact.dtypes)[ref.column] in _WHOLE


def _with_bits(fact: DataFrame, ref: Reference) -> tuple[DataFrame, Column]:
    """The fact beside its key's word, and whether the key is in it (NULL without a word).

    Words are broadcast where Spark's limit admits their number, else both sides are shuffled;
    a missing key goes to a word that no key has, another one from row to row.
    """
    words = key_words(ref.dimension, ref.key).hint("broadcast" if _fits(fact, ref.words) else "merge")
    number = F.col(ref.column).cast("bigint")
    scatter = F.pmod(F.xxhash64(*_spread_columns(fact, ref.column)), F.lit(_SPREAD))
    word = F.coalesce(F.shiftright(number, 6), F.lit(_NO_WORD) + scatter)
    found = F.getbit(_BITS, number.bitwiseAND(63).cast("int")) == 1
    return fact.join(words, word == F.col(_WORD), "left"), found


def _lookup(dimension: DataFrame, key: str, unique: bool) -> DataFrame:
    keys = dimension.where(F.col(key).isNotNull()).select(F.col(key).alias(_KEY))
    if not unique:
        keys = keys.distinct()
    return keys.withColumn(_SALT, F.lit(0).cast("bigint")).withColumn(_FOUND, F.lit(True))


def _salt(column: str, spread_by: Sequence[str]) -> Column:
    """0 for a present key; from 1 on, differing from row to row, for a missing one."""
    scatter = F.pmod(F.xxhash64(*spread_by), F.lit(_SPREAD)) + 1
    return F.when(F.col(column).isNull(), scatter).otherwise(F.lit(0).cast("bigint"))


def _flagged(fact: DataFrame, ref: Reference, unique: bool) -> DataFrame:
    if _in_words(fact, ref):
        joined, valid = _with_bits(fact, ref)
    else:
        lookup = _lookup(ref.dimension, ref.key, unique)
        salt = _salt(ref.column, _spread_columns(fact, ref.column))
        joined = fact.join(lookup, (F.col(ref.column) == F.col(_KEY)) & (salt == F.col(_SALT)), "left")
        valid = F.col(_FOUND).isNotNull()
    if not ref.required:
        valid = valid | F.col(ref.column).isNull()
    return joined.withColumn(ref.flag, F.when(valid, 1).otherwise(0)).drop(_KEY, _SALT, _FOUND, _WORD, _BITS)


def _spread_columns(fact: DataFrame, column: str, at_most: int = 4) -> list[str]:
    """A few integer columns that together vary from row to row, the widest type first."""
    keys = [n for t in ("bigint", "int") for n, kind in fact.dtypes if kind == t and n != column]
    return keys[:at_most] or fact.columns


def reference_flags(fact: DataFrame, references: Sequence[Reference], unique: bool = True) -> DataFrame:
    """Add one 0/1 column per reference.

    A missing optional key counts as valid. ``unique`` says that dimension keys do not repeat,
    which holds for silver tables; otherwise they are made distinct first.
    """
    for ref in references:
        fact = _flagged(fact, ref, unique)
    return fact


def keep_required(fact: DataFrame, ref: Reference) -> DataFrame:
    """Rows whose key is present and resolves."""
    if _in_words(fact, ref):
        joined, found = _with_bits(fact, ref)
        return joined.where(found).select(*fact.columns)
    return fact.join(
        ref.dimension.select(F.col(ref.key).alias(_KEY)), F.col(ref.column) == F.col(_KEY), "left_semi"
    )


def keep_optional(fact: DataFrame, ref: Reference, unique: bool = True) -> DataFrame:
    """Rows whose key is missing or resolves."""
    columns = fact.columns
    flagged = _flagged(fact, ref, unique)
    return flagged.where(F.col(ref.flag) == 1).select(*columns)


def keep_resolved(fact: DataFrame, references: Sequence[Reference], unique: bool = True) -> DataFrame:
    """Rows that satisfy every reference; the required ones are checked first."""
    for ref in sorted(references, key=lambda r: not r.required):
        fact = keep_required(fact, ref) if ref.required else keep_optional(fact, ref, unique)
    return fact


def orphans(fact: DataFrame, ref: Reference) -> DataFrame:
    """Rows whose key is present but does not resolve."""
    present = fact.where(F.col(ref.column).isNotNull())
    if _in_words(fact, ref):
        joined, found = _with_bits(present, ref)
        return joined.where(~F.coalesce(found, F.lit(False))).select(*fact.columns)
    return present.join(
        ref.dimension.select(F.col(ref.key).alias(_KEY)), F.col(ref.column) == F.col(_KEY), "left_anti"
    )
