"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Positives are documents labelled 1; the unlabelled set is a sample of all documents, whose labels are
never looked at. The class prior is estimated from how much of the unlabelled set lies where positives
do. A small network over counts of characters, words and lines and over hashed words minimises
pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)]) with the logistic loss.

Training takes a bounded sample (POSITIVES and UNLABELLED documents, none longer than MAX_CHARS); scoring
reads whole texts.

Defined results: a null text counts as empty, and empty texts are scored like others; rows with equal
doc_id are scored separately; without positives or unlabelled rows the score is 1; other columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, map_slices
from .training import Adam, sample, sigmoid, softplus

POSITIVES = 6000
UNLABELLED = 12_000
MAX_CHARS = 50_000
THRESHOLD = 0.3
HIDDEN = 16
#: Buckets that words are counted in by their hashes.
BUCKETS = 64
#: By how much the word buckets count less than other features, as there are many of them.
WORD_SPREAD = 3.0
#: Factor on the estimated prior: one that is too high lets negatives pass, one that is too low costs little.
CAUTION = 0.98

#: Bytes that are counted together.
GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "space": (32,), "line": (10,), "stop": b".,;:", "loud": b"!?", "sign": b"#$%&*+@^~_=<>\\/|`", "quote": b"\"'()[]{}-"}
MEMBER = np.zeros((256, len(GROUPS)))
for _k, _bytes in enumerate(GROUPS.values()):
    MEMBER[list(_bytes), _k] = 1


def describe(text: str) -> np.ndarray:
    """Shares of byte groups, and how words and lines are built and repeated."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    lines = text.split("\n")
    n, k = max(1, len(raw)), max(1, len(words))
    shares = np.bincount(raw, minlength=256) @ MEMBER / n
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    loud = sum(map(str.isupper, words))
    bare = sum(map(str.isalpha, words))
    ends = sum(not w[-1].isalnum() for w in words)
    more = [np.log1p(len(words)), distinct / k, np.log1p(distinct) / np.log1p(k) if words else 0.0, same / k, loud / k, bare / k, ends / k, (len(text) - len(words)) / k / 10, len(set(lines)) / len(lines), np.log1p(k / len(lines)), float(not words)]
    content = np.bincount([zlib.crc32(w.lower().encode()) % BUCKETS for w in words], minlength=BUCKETS) / k
    return np.concatenate([np.sqrt(shares), more, np.sqrt(content)])


WIDTH = len(GROUPS) + 11 + BUCKETS


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.spread, -8, 8) @ w1 + b1) @ w2 + b2[0]


def described(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep (numbers) and the description of each text."""
    types = dict(df.dtypes)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([describe(t) for t in part.column("text").to_pylist()])
        values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * WIDTH, x.ravel())
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), values], names=[*keep, "x"])

    return map_slices(df.select(*keep, "text"), run, ", ".join([*(f"{c} {types[c]}" for c in keep), "x array<double>"]))


def matrix(table: pa.Table) -> np.ndarray:
    return table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)


def descend(x_p: np.ndarray, x_u: np.ndarray, prior: float | None, rounds: int, seed: int, decay: float) -> list[np.ndarray]:
    """The non-negative risk if a prior is given, else the plain one of positives against unlabelled rows."""
    random = np.random.default_rng(seed)
    layers = [random.normal(0, 0.3, (x_p.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.3, HIDDEN), np.zeros(1)]
    adam = Adam(layers, 0.01)
    n_p = len(x_p)
    x = np.vstack([x_p, x_u])
    for _ in range(rounds):
        w1, b1, w2, b2 = layers
        h = np.tanh(x @ w1 + b1)
        slope = risk_slope(h @ w2 + b2[0], n_p, prior)
        dh = slope[:, None] * w2 * (1 - h * h)
        adam.step(layers, [x.T @ dh + decay * w1, dh.sum(axis=0), h.T @ slope + decay * w2, np.array([slope.sum()])])
    return layers


def risk_slope(f: np.ndarray, n_p: int, prior: float | None) -> np.ndarray:
    """Slopes by which the outputs (n_p positives, then unlabelled rows) go down; without a prior, of positives against unlabelled rows."""
    up, down = -sigmoid(-f), sigmoid(f)  # slopes of the losses of label 1 and label 0
    slope, n_u = np.empty(len(f)), len(f) - n_p
    if prior is None:
        slope[:n_p], slope[n_p:] = up[:n_p] / n_p, down[n_p:] / n_u
    elif softplus(f[n_p:]).mean() >= prior * softplus(f[:n_p]).mean():
        slope[:n_p], slope[n_p:] = prior * (up[:n_p] - down[:n_p]) / n_p, down[n_p:] / n_u
    else:  # the risk of negatives has gone below zero: go back up
        slope[:n_p], slope[n_p:] = prior * down[:n_p] / n_p, -down[n_p:] / n_u
    return slope


def estimate_prior(p: np.ndarray, u: np.ndarray, doubt: float = 0.1) -> float:
    """The ratio of the shares of unlabelled and positive rows above a score, at the score of the least upper bound of that ratio."""
    cuts = np.quantile(p, np.linspace(0.02, 0.98, 97))
    above_p = np.maximum(1 - np.searchsorted(np.sort(p), cuts) / len(p), 1e-9)
    ratio = (1 - np.searchsorted(np.sort(u), cuts) / len(u)) / above_p
    wide = (np.sqrt(np.log(4 / doubt) / (2 * len(u))) + np.sqrt(np.log(4 / doubt) / (2 * len(p)))) / above_p
    return float(np.clip(ratio[np.argmin(ratio + wide)], 0.05, 0.99))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", only: Column | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, max_chars: int = MAX_CHARS, rounds: int = 200) -> Model:
    """Fits the network; `only` is a predicate over doc_id that both samples obey."""
    only = F.lit(True) if only is None else only
    p = matrix(described(sample(docs, labels, label_col, only, {1: positives}, max_chars), ["doc_id"]).toArrow())
    fits = docs.where(only & (F.length("text") <= max_chars)).select("doc_id", F.xxhash64("doc_id", F.lit("unlabelled")).alias("draw"))
    ids = fits.orderBy("draw", "doc_id").limit(unlabelled).select("doc_id").distinct()
    # at most `unlabelled` rows of 8 bytes
    drawn = docs.where(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id")
    u = matrix(described(drawn, ["doc_id"]).limit(unlabelled).toArrow())
    if not len(p) or not len(u):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), [np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), np.full(1, 30.0)], 1.0)
    mean, spread = u.mean(axis=0), u.std(axis=0) + 1e-3
    spread[-BUCKETS:] *= WORD_SPREAD
    scaled = [np.clip((x - mean) / spread, -8, 8) for x in (p, u)]
    return Model(mean, spread, descend(*scaled, prior := cross_fitted_prior(p, u, scaled, mean, spread, rounds), rounds, 2, 3e-3), prior)


def cross_fitted_prior(p: np.ndarray, u: np.ndarray, scaled: list[np.ndarray], mean: np.ndarray, spread: np.ndarray, rounds: int) -> float:
    """Mean of two estimates, each on the half that its classifier has not seen."""
    if min(len(p), len(u)) < 4:
        return 0.5
    found = []
    for half in (0, 1):
        plain = Model(mean, spread, descend(scaled[0][half::2], scaled[1][half::2], None, rounds, 1, 1e-2), 0.0)
        found.append(estimate_prior(plain.logit(p[1 - half :: 2]), plain.logit(u[1 - half :: 2])))
    return CAUTION * float(np.mean(found))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability of label 1 of every whole text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([describe(t) for t in part.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sigmoid(model.logit(x)))], names=["doc_id", "score"])

    return map_slices(documents(df, id_col, text_col), run, "doc_id bigint, score double")


def classify(df: DataFrame, labels: DataFrame, only: Column, **options) -> DataFrame:
    """Trains on the rows that `only` admits and scores all rows."""
    return score(df, train(documents(df), labels, only=only, **options)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
