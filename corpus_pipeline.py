"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that ``run`` writes as Parquet and
reads again for the next one. All but the last return the columns of ``documents``:

1. toxicity: documents that the factorization machine scores at 0.3 or more go;
2. language: documents without a letter go, and those whose language stays open;
3. line_dedup: lines with an earlier equal or near line go, and with them documents of which
   nothing visible is left; ``n_chars`` follows the text;
4. jaccard_join: of each group of near-duplicate documents (Jaccard index of 0.8 or more over
   5-word shingles) one row stays, that of the smallest id, NULL last;
5. packing: pieces of token sequences of 1024 ids.

A NULL text counts as empty: it is not toxic, has no language, and so goes in stage 2. Rows are
judged one by one, whether they repeat an id or have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oresmith.llm import language, line_dedup, packing, partenum, toxicity
from oresmith.llm.common import bounded, remove_folder, ship_package, step_folder, steps_removed, stored
from oresmith.llm.queries import PACK_TOKENIZER

TOXIC_FROM = 0.3
LANGUAGE_FROM = 0.3
NEAR_PERCENT, NEAR_WIDTH = 80, 5
_FEW = 300_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.learn(docs, labels)
    return docs.where(toxicity.toxicity(F.col("text"), machine) < TOXIC_FROM)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = language.language(F.col("text"), language.learn(docs))
    return docs.where((found["lang"] != language.UNKNOWN) & (found["score"] >= LANGUAGE_FROM))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    # Whatever the columns are called, they come back beside the counts.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, plain))
    left = line_dedup.without_repeated_lines(docs.toDF(*plain), names["doc_id"], names["text"]).where("NOT emptied")
    left = left.select(*plain).toDF(*docs.columns)
    return left.withColumn("n_chars", F.char_length("text").cast("long"))


def _with_row_keys(docs: DataFrame, folder: str) -> DataFrame:
    """The rows with ``row_key``, which stays the same whenever they are read again: the file and
    the place in it, or, where rows are not read from files, a number stored with them."""
    try:
        place = docs.metadataColumn("_metadata")
        key = F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))
        return docs.select("*", key.alias("row_key"))
    except AnalysisException:
        return stored(docs.withColumn("row_key", F.monotonically_increasing_id()), folder, "rows")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    # Whatever the columns are called, they come back beside the row's own key.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, plain))
    rows = _with_row_keys(docs, step_folder(spark, "one-of-each-group")).toDF(*plain, "row_key")
    # Ordered by document id, NULL last, then by key, so a group's least row is the one that stays.
    doc = F.col(names["doc_id"])
    order = F.struct(doc.isNull().alias("no_id"), doc.alias("doc"), "row_key").alias("place")
    placed = rows.select(order, F.col(names["text"]).alias("text"))
    groups = partenum.jaccard_components(placed, "place", "text", percent=NEAR_PERCENT, width=NEAR_WIDTH)
    others = groups.where("place <> component_id").select("place.row_key")
    others = stored(others, step_folder(spark, "others-of-groups"), "others")
    # The keys that go are broadcast only where a count shows that they are few.
    others = F.broadcast(others) if bounded(others, _FEW) else others
    return rows.join(others, "row_key", "left_anti").select(*plain).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    digest = F.crc32("ids").alias("ids_crc32")
    return packing.pack_documents(docs, "doc_id", "text", PACK_TOKENIZER, digest)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("packing", pack),
]

# Learned models decide in the first two stages, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next.

    What a stage stored on its way is removed as soon as its result is stored, and so is the
    result before; the last one stays.
    """
    folder = step_folder(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        with steps_removed(spark):
            docs = stored(stage(spark, docs, sf_dir), folder, name)
        if at:
            remove_folder(spark, f"{folder}/{STAGES[at - 1][0]}")
    return docs
