"""Approximate nearest neighbours by a permutation index.

A vector is represented by the ordered pivots nearest to it: the first ``POSTED`` of a fixed set,
by angle. Each pivot has an inverted file of the vectors that hold it among those, with the place
it has there. A query reads the files of its own ``ASKED`` nearest pivots only and adds up, over
these files, how far the places differ from its own (Spearman's footrule, where an absent pivot
has the place behind the last). The vectors of smallest footrule are compared with the query
exactly.

Angles alone do not tell the largest inner product where vectors differ in length, so the index
is cut by length, into bands of factor ``BAND``: within a band the order by angle is nearly that
by inner product, and every band gives its share of vectors to compare. Vectors of different
numbers of components are indexed apart and never compared. Bands are cut into blocks by a hash
of the ids, each with the inverted files of its vectors; a search task meets one block of the
index and one block of queries. The share of a block that is compared exactly is the same for all
blocks, and never less than ``10 k`` vectors, so recall does not depend on their number. Pivots
are a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oresmith.llm.common import step_folder, stored
from oresmith.llm.vectors import sample_matrices, stacked, unit, usable_vectors

PIVOTS, POSTED, ASKED = 512, 64, 48
BAND = 2**0.5
BLOCK, QUERY_BLOCK = 8192, 1024


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest pivots of every vector by angle, in order; of equal ones the first."""
    near = np.empty((len(vectors), min(most, len(pivots))), dtype=np.int16)
    for first in range(0, len(vectors), 1024):
        cosines = unit(vectors[first : first + 1024]) @ pivots.T
        near[first : first + 1024] = np.argsort(-cosines, axis=1, kind="stable")[:, :most]
    return near


class InvertedFiles:
    """Per pivot the rows that hold it among their nearest, and its place there."""

    def __init__(self, near: np.ndarray, pivots: int):
        by_pivot = np.argsort(near.ravel(), kind="stable")
        self.rows = (by_pivot // near.shape[1]).astype(np.int32)
        self.places = (by_pivot % near.shape[1]).astype(np.int32)
        self.starts = np.searchsorted(near.ravel()[by_pivot], np.arange(pivots + 1))
        self.count, self.posted = near.shape

    def agreement(self, asked: np.ndarray) -> np.ndarray:
        """How much smaller every row's footrule to a query is than that of a row without any of
        the query's pivots; 0 for rows that no file of theirs holds."""
        gain = np.zeros(self.count, dtype=np.int32)
        for place, pivot in enumerate(asked):
            part = slice(self.starts[pivot], self.starts[pivot + 1])
            # An absent pivot counts as place ``posted``, which is that much further off.
            gain[self.rows[part]] += np.maximum(self.posted - np.abs(self.places[part] - place), 0)
        return gain


def search_block(
    ids: np.ndarray, vectors: np.ndarray, files: InvertedFiles, query_ids: np.ndarray, queries: np.ndarray,
    asked: np.ndarray, k: int, share: float,
) -> pd.DataFrame:
    """The ``k`` nearest of a block for each query: those of smallest footrule, compared exactly."""
    compared = min(len(ids), max(int(np.ceil(share * len(ids))), 10 * k) + 1)
    found = []
    for query, vector, pivots in zip(query_ids, queries, asked):
        near = np.argpartition(-files.agreement(pivots), compared - 1)[:compared]
        near = near[ids[near] != query]
        scores = vectors[near] @ vector
        best = np.lexsort((ids[near], -scores))[:k]
        found.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][best], "score": scores[best]}))
    return pd.concat(found, ignore_index=True)


def _band(vector: Column) -> Column:
    """The number of the band that the vector's length lies in."""
    largest = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
    return F.floor((F.log(largest) + 0.5 * F.log(squares)) / float(np.log(BAND))).cast("int")


def nearest(
    df: DataFrame, is_query: str, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20,
    pivots: int = PIVOTS, share: float = 0.15,
) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the ``k`` nearest found for each query.

    ``is_query`` is a SQL condition on ``id``; all other rows with as many components are
    candidates for all queries. Nearness is the largest inner product in double precision, ties
    go to the smaller id. A vector that is NULL, zero or holds NULL or non-finite components takes
    no part, nor does a row without an id. Rows that repeat a query's id are not its candidates; a
    candidate id that repeats counts once, with its best score. The steps are stored.
    """
    spark = df.sparkSession
    folder = step_folder(spark, "permutation-index")
    rows = usable_vectors(df, id_column, vector_column)
    vectors = stored(rows.withColumn("band", _band(F.col("vector"))), folder, "vectors")
    pivot_matrix = {length: unit(found) for length, found in sample_matrices(vectors, pivots).items()}

    # The blocks of a length are numbered through all its bands: a few rows per length and band.
    sizes = vectors.groupBy("length", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    before = Window.partitionBy("length").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    sizes = stored(sizes, folder, "sizes")
    queries = vectors.where(is_query).dropDuplicates(["id"])
    totals = sizes.groupBy("length").agg(F.sum("parts").cast("int").alias("blocks"))
    asking = queries.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks"))
    totals = stored(totals.join(asking, "length"), folder, "totals")

    def packed(most: int):
        """One row per block: its ids, its vectors and their ``most`` nearest pivots."""

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("id", kind="stable")
            matrix, length = stacked(group["vector"]), int(group["length"].iat[0])
            row = {
                "length": length,
                "block": group["block"].iat[0],
                "ids": group["id"].to_numpy(np.int64).tobytes(),
                "vectors": matrix.tobytes(),
                "near": nearest_pivots(matrix, pivot_matrix[length], most).tobytes(),
            }
            return pd.DataFrame([row])

        return pack

    packed_schema = "length int, block int, ids binary, vectors binary, near binary"

    def in_blocks(dealt: DataFrame, most: int) -> DataFrame:
        rows = dealt.select("id", "vector", "length", "block")
        return rows.groupBy("length", "block").applyInPandas(packed(most), packed_schema)

    def dealt(start: Column, parts: str) -> Column:
        return (start + F.pmod(F.xxhash64(F.lit(7), "id"), F.col(parts))).cast("int")

    index = vectors.join(sizes, ["length", "band"]).withColumn("block", dealt(F.col("start"), "parts"))
    index = stored(in_blocks(index, POSTED), folder, "index")
    asked = queries.join(totals, "length").withColumn("block", dealt(F.lit(0), "query_blocks"))
    asked = stored(in_blocks(asked, ASKED), folder, "queries")
    asked = asked.toDF("length", "query_block", "query_ids", "query_vectors", "query_near")
    # Every block of queries meets every block of the index: the stated queries against all rows.
    every_query_block = F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block")
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    index = index.join(totals, "length").select("length", "block", "ids", "vectors", "near", every_query_block)
    asked = asked.join(totals, "length").select("length", "query_block", "query_ids", "query_vectors", "query_near", every_block)
    meetings = index.join(asked, ["length", "block", "query_block"])

    def matrix(data: bytes, ids: np.ndarray, kind=float) -> np.ndarray:
        return np.frombuffer(data, dtype=kind).reshape(len(ids), -1)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in batch.itertuples():
                ids, query_ids = np.frombuffer(m.ids, np.int64), np.frombuffer(m.query_ids, np.int64)
                vectors, queries = matrix(m.vectors, ids), matrix(m.query_vectors, query_ids)
                files = InvertedFiles(matrix(m.near, ids, np.int16), len(pivot_matrix[m.length]))
                yield search_block(ids, vectors, files, query_ids, queries, matrix(m.query_near, query_ids, np.int16), k, share)

    found = meetings.mapInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
