"""Language identification with a string kernel.

Two texts are as alike as their sets of character n-grams: the blended-spectrum presence kernel
counts the n-grams of lengths 1 to 3 that both hold, divided by the geometric mean of the two
set sizes. A kernel ridge regression, one against the rest for every language, learns from it
with Nystrom landmarks: texts are represented by their kernel values with a fixed number of
landmark texts, so learning and scoring are products with matrices whose size does not grow.
N-grams are told apart by a hash of ``BITS`` bits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oresmith.llm.common import held_out

BITS = 18
LENGTHS = (1, 2, 3)
UNKNOWN = "und"
_not_letters = re.compile(r"[\W\d_]+")
_BATCH = 128


def presence(text: str | None) -> np.ndarray | None:
    """Hash places of the n-grams of a whole text, ascending; None if it has no letter.

    Letters count in lower case; everything between words is one blank.
    """
    words = _not_letters.sub(" ", (text or "").lower()).strip()
    if not words:
        return None
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    found = []
    gram = np.zeros(len(codes), dtype=np.uint64)
    for n in LENGTHS:
        gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    places = np.sort(np.concatenate(found))
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


def column_of(columns: np.ndarray) -> np.ndarray:
    """For every hash place its number among ``columns``, -1 for the others."""
    found = np.full(1 << BITS, -1, dtype=np.int32)
    found[columns] = np.arange(len(columns), dtype=np.int32)
    return found


def presence_rows(places: list[np.ndarray], column: np.ndarray, width: int) -> np.ndarray:
    """One row per text with 1/sqrt(set size) at its places among the columns."""
    rows = np.zeros((len(places), width), dtype=np.float32)
    for row, p in zip(rows, places):
        at = column[p]
        row[at[at >= 0]] = 1.0 / np.sqrt(len(p))
    return rows


@dataclass(frozen=True)
class StringKernelClassifier:
    languages: list[str]
    columns: np.ndarray  # hash places that some landmark has
    landmarks: np.ndarray  # those columns of the landmarks' rows, transposed
    weights: np.ndarray  # landmark values -> one decision value per language

    def decide(self, places: list[np.ndarray]) -> np.ndarray:
        kernel = presence_rows(places, column_of(self.columns), len(self.columns)) @ self.landmarks
        return kernel.astype(float) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score from 0 to 1) of each text; UNKNOWN and 0 without letters."""
        languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return languages, scores
        for first in range(0, len(texts), _BATCH):
            found = [(i, presence(texts[i])) for i in range(first, min(first + _BATCH, len(texts)))]
            found = [(i, p) for i, p in found if p is not None]
            if not found:
                continue
            values = np.exp(4.0 * np.clip(self.decide([p for _, p in found]), -3, 3))
            shares = values / values.sum(1, keepdims=True)
            for (i, _), share in zip(found, shares):
                best = int(share.argmax())
                languages[i], scores[i] = self.languages[best], share[best]
        return languages, scores


def fit(places: list[np.ndarray], languages: list[str], landmarks: int = 160, ridge: float = 1e-4) -> StringKernelClassifier:
    """Kernel ridge regression on texts given by their places, in the order given.

    Landmarks are the first texts of each language, as many of each as there are. The Nystrom
    map is the inverse square root of the landmarks' own kernel, without its null directions.
    """
    names = sorted(set(languages))
    if not names:
        return StringKernelClassifier([], np.empty(0, int), np.empty((0, 0)), np.empty((0, 0)))
    of_language = [[i for i, name in enumerate(languages) if name == n] for n in names]
    most = -(-landmarks // len(names))
    chosen = [i for rows in of_language for i in rows[:most]]
    columns = np.unique(np.concatenate([places[i] for i in chosen]))
    column = column_of(columns)
    marks = np.ascontiguousarray(presence_rows([places[i] for i in chosen], column, len(columns)).T)
    own = (marks.T @ marks).astype(float)
    values, vectors = np.linalg.eigh(own)
    held = values > 1e-6 * values.max()
    to_features = vectors[:, held] / np.sqrt(values[held])
    kernel = np.concatenate(
        [presence_rows(places[i : i + _BATCH], column, len(columns)) @ marks for i in range(0, len(places), _BATCH)]
    ).astype(float)
    features = kernel @ to_features
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    gram = features.T @ features + ridge * len(places) * np.eye(features.shape[1])
    weights = to_features @ np.linalg.solve(gram, features.T @ target)
    return StringKernelClassifier(names, columns, marks, weights)


def learn(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = 3_000, at_least: int = 20
) -> StringKernelClassifier:
    """Fit on at most ``sample`` documents with a language that are not held out.

    Every language gives as many, those with the ids of smallest hash, so a rare one has its
    landmarks, too; with more than ``sample`` / ``at_least`` languages each still gives that many.
    Documents without an id, a language or a letter
    teach nothing; of an id with several languages, the first by name counts. Only hash places
    of the sample reach the driver.
    """
    known = docs.where(F.col(lang_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.min(lang_column).alias("lang"))
    languages = known.select("lang").distinct().count()
    each = max(at_least, sample // max(1, languages))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).select("id", "lang")

    @F.pandas_udf("binary")
    def places(texts: pd.Series) -> pd.Series:
        found = [presence(t) for t in texts]
        return pd.Series([None if p is None else p.astype("<i4").tobytes() for p in found], dtype=object)

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # As many rows of an id and a name as are learned from, so the broadcast is bounded.
    rows = texts.join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("h"), "id", "lang", places("text").alias("places"))
    learned = [r for r in rows.collect() if r["places"]]
    learned.sort(key=lambda r: (r["h"], r["id"], len(r["places"])))
    return fit([np.frombuffer(r["places"], dtype="<i4") for r in learned], [r["lang"] for r in learned])


def language(text: str | Column, classifier: StringKernelClassifier) -> Column:
    """struct(lang, score) of each whole text: UNKNOWN with score 0 if it is NULL or has no letter."""

    @F.pandas_udf(T.StructType().add("lang", "string").add("score", "double"))
    def predicted(texts: pd.Series) -> pd.DataFrame:
        languages, scores = classifier.predict(list(texts))
        return pd.DataFrame({"lang": languages, "score": scores})

    return predicted(text)


def predict_documents(
    docs: DataFrame, classifier: StringKernelClassifier, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, held_out, lang_pred, score for every row, repeated rows included; nothing is shuffled."""
    found = docs.select(
        F.col(id_column), held_out(id_column).alias("held_out"), language(F.col(text_column), classifier).alias("found")
    )
    return found.select(id_column, "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
