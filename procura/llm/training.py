"""Bounded training samples and the optimiser that the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, per_label: dict[int, int], max_chars: int) -> DataFrame:
    """doc_id, text and y of at most per_label[y] labelled documents each, the first by a hash of their ids.

    train is a predicate over doc_id. Texts longer than max_chars are left out of the sample (not of the
    scoring), so that its size is bounded. Rows with null id or label, and ids with two labels, are left out.
    """
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    one = one.where(train).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    chosen = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in per_label.items()]
    ids = chosen[0]
    for more in chosen[1:]:
        ids = ids.union(more)
    # at most sum(per_label.values()) rows of 12 bytes
    return written(docs.where(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id"))


class Adam:
    def __init__(self, shapes: list[np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m = [np.zeros_like(x) for x in shapes]
        self.v = [np.zeros_like(x) for x in shapes]

    def step(self, values: list[np.ndarray], slopes: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(values, slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
