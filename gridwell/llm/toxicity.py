"""Toxicity by a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the n-grams that it has. Each is scaled by the logarithm of how much more
often toxic documents have it than others, as long as the difference is beyond chance, and a logistic
regression is trained on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, read, slices
from .grams import character_grams

#: Labelled documents of each class that the classifier is trained on, at most.
LEARNED_DOCS = 2000
BITS, SIZES = 18, (3, 5)
#: Standard errors by which the shares of documents must differ for an n-gram to count.
BEYOND_CHANCE = 3.5


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams that text has, each once, ascending, with one plus the logarithm of how often."""
    codes, times = character_grams(text, SIZES, BITS)
    return codes, 1 + np.log(times)


def train(rows: list[tuple[str, int]], positive_share: float, steps: int = 300, ridge: float = 1e-5) -> Model:
    """rows: texts and labels; both classes weigh the same. positive_share: what is predicted if rows have only one class or none."""
    size = 1 << BITS
    labels = np.array([y for _, y in rows], float)
    if not len(rows) or labels.min() == labels.max():
        share = positive_share if not len(rows) else float(labels[0])
        return Model(np.zeros(size, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    own = [features(t.encode()) for t, _ in rows]
    sums, n = np.zeros((2, size)), np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    for (codes, _), y in zip(own, labels.astype(int), strict=True):
        sums[y, codes] += 1
    rate = (sums + 0.5) / (n[:, None] + 1)
    pooled = (sums.sum(axis=0) + 0.5) / (n.sum() + 1)
    strength = (rate[1] - rate[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n).sum())
    ratio = np.where(np.abs(strength) >= BEYOND_CHANCE, np.log(rate[1] / rate[0]), 0.0)
    used = np.flatnonzero(ratio)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(own)), [len(c) for c, _ in own])
    column = place[np.concatenate([c for c, _ in own])]
    row, value, column = row[column >= 0], np.concatenate([v for _, v in own])[column >= 0], column[column >= 0]
    value = value * ratio[used][column]
    weight, bias = np.zeros(len(used)), 0.0
    balance = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])
    momentum, drift, pace = np.zeros(len(used)), 0.0, 0.0
    scale = np.sqrt(max(1.0, np.bincount(row, value**2, len(own)).mean()))
    value = value / scale
    for _ in range(steps):  # accelerated gradient steps on the ridge-penalised logistic loss
        at, at_bias = weight + pace * (weight - momentum), bias + pace * (bias - drift)
        margin = np.bincount(row, value * at[column], len(own)) + at_bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * balance
        momentum, drift = weight, bias
        weight = at - 4.0 * (np.bincount(column, value * error[row], len(used)) + ridge * at)
        bias = at_bias - 4.0 * error.sum()
        pace = 0.9
    full = np.zeros(size, np.float32)
    full[used] = weight * ratio[used] / scale
    return Model(full, float(bias))


def margin_of(text: bytes, model: Model) -> float:
    codes, values = features(text)
    return float(model.weights[codes] @ values) + model.bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text; others are ignored) to (doc_id, score). A null text is an empty one; all rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))  # 2**BITS numbers; a plain tuple, so that executors need no class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            margin = np.array([margin_of(t or b"", Model(*held.value)) for t in part.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from labelled ones that aren't held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = crc_mod("doc_id", 3) == 1
    share = labels.where(~out).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    model = train(labelled_sample(docs, labels, "toxic", ~out, LEARNED_DOCS), share)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
