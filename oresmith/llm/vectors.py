"""What the vector operators share: which vectors take part, and bounded samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part: not NULL or zero, without NULL or non-finite components."""
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    nonzero = F.exists(column, lambda x: x != 0)
    return F.coalesce(finite & nonzero, F.lit(False))


def usable_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector of doubles, length) of the rows that take part; ids must not be NULL.

    Vectors can only be compared at one number of components, ``length``.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector"))
    return rows.withColumn("length", F.size("vector"))


def sample_matrices(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """For every length at most ``rows`` vectors (id, vector, length), those of smallest hash of the
    id, as a matrix on the driver."""
    first = Window.partitionBy("length").orderBy(F.xxhash64("id"), "id")
    chosen = vectors.withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows)
    found: dict[int, list] = {}
    for r in sorted(chosen.select("length", "id", "vector").collect(), key=lambda r: (r["id"], r["vector"])):
        found.setdefault(r["length"], []).append(r["vector"])
    return {length: np.array(of_length, dtype=float) for length, of_length in found.items()}


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1, whatever their size."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])
