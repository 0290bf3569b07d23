"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and of the first letters of its longer words, which inflected
forms share, each hashed to one of ``2 ** bits`` places. The model is

    bias + sum of w[j] x[j] + sum over pairs of <v[i], v[j]> x[i] x[j],

so a pair of terms, such as an insult and the mention of a group, can count for more than its
two terms. Terms that say nothing about the label in the learning sample have x = 0, so long clean
texts score like short ones. Used are terms whose share among toxic texts differs from their
share among the others by several standard errors, scaled by their log ratio, and frequent terms
that tell nothing alone but do so together with another one: the share of texts with both differs.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oresmith.llm.common import held_out

STEM = 4
_words = re.compile(r"[^\W\d_]+").findall


def term_places(text: str | None, bits: int) -> list[int]:
    """Hash places of the distinct lower-case terms of a whole text, in no order."""
    if not text:
        return []
    mask = (1 << bits) - 1
    crc = zlib.crc32
    words = set(_words(text.lower()))
    terms = words | {w[:STEM] + "-" for w in words if len(w) > STEM}
    return list({crc(t.encode("utf-8", "replace")) & mask for t in terms})


@dataclass(frozen=True)
class FactorizationMachine:
    bits: int
    bias: float
    rows: dict[int, int]  # hash place -> row of the arrays below
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, text: str | None) -> float:
        rows = [self.rows[p] for p in term_places(text, self.bits) if p in self.rows]
        if not rows:
            return self.bias
        v = self.factors[rows]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return self.bias + float(self.linear[rows].sum()) + pairs

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(text), -40, 40))))


def paired_terms(places: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, z: float, least: int = 8) -> np.ndarray:
    """Those of the terms that tell the labels apart together with another of them.

    The texts with both terms of a pair are counted, for all pairs; ``z`` is how many standard
    errors their share must differ between the labels, ``least`` how many there must be.
    """
    column = {int(t): i for i, t in enumerate(terms)}
    holds = np.zeros((len(places), len(terms)), dtype=np.float32)
    for row, p in zip(holds, places):
        row[[column[t] for t in p.tolist() if t in column]] = 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    both_1, both_0 = (holds[labels == y].T @ holds[labels == y] for y in (1, 0))
    p1, p0, both = (both_1 + 0.5) / (n1 + 1), (both_0 + 0.5) / (n0 + 1), (both_1 + both_0 + 1) / (n1 + n0 + 2)
    telling = (np.abs(p1 - p0) > z * np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))) & (both_1 + both_0 >= least)
    np.fill_diagonal(telling, False)
    return terms[telling.any(1)]


def fit(
    places: list[np.ndarray],
    labels: np.ndarray,
    bits: int,
    rank: int = 8,
    z: float = 3.5,
    frequent: int = 400,
    pair_z: float = 5.5,
    epochs: int = 400,
    rate: float = 0.05,
    decay: float = 1e-4,
    seed: int = 7,
) -> FactorizationMachine:
    """Learn from hash places of texts and labels of 0 and 1 by Adam on the logistic loss.

    ``z`` is how many standard errors a term's share must differ between the labels, ``pair_z``
    how many that of two terms together, of the ``frequent`` most frequent others. Without
    texts of both labels, the score is the share of label 1 (smoothed), whatever the text.
    """
    labels = np.asarray(labels, dtype=float)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    none = FactorizationMachine(bits, prior, {}, np.empty(0), np.empty((0, rank)))
    if not n1 or not n0:
        return none
    with_1, with_0 = np.zeros(1 << bits), np.zeros(1 << bits)
    for p, y in zip(places, labels):
        (with_1 if y else with_0)[p] += 1
    p1, p0 = (with_1 + 0.5) / (n1 + 1), (with_0 + 0.5) / (n0 + 1)
    both = (with_1 + with_0 + 1) / (n1 + n0 + 2)
    error = np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    telling = np.flatnonzero((np.abs(p1 - p0) > z * error) & (with_1 + with_0 >= 4))
    others = np.setdiff1d(np.flatnonzero(with_1 + with_0 >= 8), telling)
    others = others[np.argsort(-(with_1 + with_0)[others], kind="stable")][:frequent]
    paired = paired_terms(places, labels, others, pair_z)
    ratio = np.concatenate([np.clip(np.log(p1[telling] / p0[telling]), -4, 4), np.ones(len(paired))])
    telling = np.concatenate([telling, paired])
    if not len(telling):
        return none
    row_of = np.full(1 << bits, -1, dtype=np.int64)
    row_of[telling] = np.arange(len(telling))

    texts, terms = [], []
    for i, p in enumerate(places):
        rows = row_of[p]
        rows = rows[rows >= 0]
        texts.append(np.full(len(rows), i))
        terms.append(rows)
    text, term = np.concatenate(texts), np.concatenate(terms)
    x = ratio[term]
    rng = np.random.default_rng(seed)
    params = [np.zeros(1), np.full(len(telling), 0.3), rng.normal(0, 0.02, (len(telling), rank))]
    params[0][0] = prior
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = 1 / len(labels)

    def summed(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(index, weights=values, minlength=size)

    for step in range(1, epochs + 1):
        bias, w, v = params
        vx = v[term] * x[:, None]
        total = np.stack([summed(vx[:, f], text, len(labels)) for f in range(rank)], 1)
        squares = np.stack([summed(vx[:, f] ** 2, text, len(labels)) for f in range(rank)], 1)
        logits = bias + summed(w[term] * x, text, len(labels)) + 0.5 * (total**2 - squares).sum(1)
        slope = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - labels) * weight
        g = slope[text] * x
        to_factors = g[:, None] * (total[text] - vx)
        gradients = [
            np.array([slope.sum()]),
            summed(g, term, len(telling)) + decay * w,
            np.stack([summed(to_factors[:, f], term, len(telling)) for f in range(rank)], 1) + decay * v,
        ]
        for i, gradient in enumerate(gradients):
            first, second = moments[i]
            first[:] = 0.9 * first + 0.1 * gradient
            second[:] = 0.999 * second + 0.001 * gradient**2
            bigger = first / (1 - 0.9**step), second / (1 - 0.999**step)
            params[i] -= rate * bigger[0] / (np.sqrt(bigger[1]) + 1e-8)
    bias, w, v = params
    rows = {int(p): i for i, p in enumerate(telling)}
    return FactorizationMachine(bits, float(bias[0]), rows, w * ratio, v * ratio[:, None])


def learn(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", sample: int = 12_000, bits: int = 20,
) -> FactorizationMachine:
    """Fit on at most ``sample`` labelled documents that are not held out.

    The sample is the labelled ids of smallest hash, so it does not depend on row order. A
    label of several rows counts as toxic if one of them does; NULL labels and ids, and ids
    without a document, are left out. Only hash places of the sample reach the driver.
    """
    labelled = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    labelled = labelled.where(~held_out(id_column)).groupBy(F.col(id_column).alias("id"))
    labelled = labelled.agg(F.max(F.col(label_column)).alias("label"))
    chosen = labelled.orderBy(F.xxhash64("id"), "id").limit(sample)

    @F.pandas_udf("binary")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(sorted(term_places(t, bits)), dtype="<i4").tobytes() for t in texts], dtype=object)

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # At most ``sample`` rows of two numbers, so the broadcast is bounded.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", places("text").alias("places")).collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["places"])))
    return fit([np.frombuffer(r["places"], dtype="<i4") for r in rows], np.array([r["label"] for r in rows]), bits)


def toxicity(text: str | Column, machine: FactorizationMachine) -> Column:
    """Score of each whole text from 0 to 1; texts that are NULL or empty get the bias alone."""
    shared: list[FactorizationMachine] = [machine]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        score_one = shared[0].score
        return pd.Series([score_one(t) for t in texts], dtype=float)

    return score(text)


def score_documents(
    docs: DataFrame, machine: FactorizationMachine, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3
) -> DataFrame:
    """id, held_out, score, predicted for every row, repeated rows included; nothing is shuffled."""
    scored = docs.select(
        F.col(id_column), held_out(id_column).alias("held_out"), toxicity(F.col(text_column), machine).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast(T.IntegerType()))
