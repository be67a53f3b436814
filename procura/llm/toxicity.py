"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is toxic if one of its sentences is: P = 1 - prod(1 - p_s), with a logistic p_s over a
sentence's words and word beginnings. Only documents are labelled; the loss of P trains the weights of
sentences. Scoring gives each document's P and the sentences that offend.

Training takes a bounded sample (PER_LABEL documents by label, none longer than MAX_CHARS) and at most
VOCABULARY features, chosen by the log-odds that are sure over the sample; scoring reads whole texts.

Defined results: a null or empty text counts as one empty sentence; rows with equal doc_id are scored
separately; without labelled rows of both kinds the score is the share of label 1 (0 if none); other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, held, map_slices, slices
from .training import Adam, sample, sigmoid, softplus

PER_LABEL = {1: 3000, 0: 6000}
MAX_CHARS = 20_000
VOCABULARY = 50_000
#: A feature's least number of documents, and least share of the sample.
MIN_DOCUMENTS = 4
MIN_SHARE = 0.0015
MIN_LOG_ODDS = 0.3
DEVIATES = 1.5
THRESHOLD = 0.3
DECAY = 2e-5
#: Share of labels 1 that no sentence explains; it keeps them from teaching chance words.
NOISE = 0.02
#: Words that a worker remembers the weight of.
CACHE = 1 << 18

SENTENCE = re.compile(r"[^.!?\u3002\uff01\uff1f\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings of four to eight letters, each marked by its length: stems that endings follow."""
    return (word, *(f"{k}{word[:k]}" for k in range(4, min(9, len(word)))))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def scorer(self):
        weights = self.weights

        class Words(dict):
            def __missing__(self, word: str) -> float:
                w = sum(weights.get(f, 0.0) for f in features(word))
                if len(self) >= CACHE:
                    self.clear()
                self[word] = w
                return w

        return Words()


def sentence_scores(text: str, words, bias: float) -> list[tuple[int, int, float]]:
    """(start, end, logit) of every sentence."""
    weigh, find = words.__getitem__, WORD.findall
    return [(m.start(), m.end(), bias + sum(map(weigh, find(m.group().lower())))) for m in SENTENCE.finditer(text)]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", only: Column | None = None, per_label: dict[int, int] | None = None, max_chars: int = MAX_CHARS, rounds: int = 300) -> Model:
    """Fits the sentence weights to document labels; `only` is a predicate over doc_id."""
    rows = sample(docs, labels, label_col, F.lit(True) if only is None else only, per_label or PER_LABEL, max_chars)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            ys: list[int] = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                own = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
                names += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_pydict({"feature": names, "y": ys}, schema=pa.schema([("feature", pa.string()), ("y", pa.int32())]))

    kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        share = kinds.get(1, 0) / max(1, sum(kinds.values()))
        return Model(bias=30.0 if share else -30.0)
    seen = rows.mapInArrow(words, "feature string, y int").groupBy("feature").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (kinds[1] + 1)) - F.log((F.col("neg") + 0.5) / (kinds[0] + 1))
    # what of the odds is left after so many standard errors
    doubt = DEVIATES * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    sure = F.signum(odds) * F.greatest(F.abs(odds) - doubt, F.lit(0.0))
    often = F.col("pos") + F.col("neg") >= max(MIN_DOCUMENTS, MIN_SHARE * (kinds[0] + kinds[1]))
    vocabulary = seen.where(often).withColumn("odds", sure).where(F.abs("odds") >= MIN_LOG_ODDS).orderBy(F.abs("odds").desc(), "feature").limit(VOCABULARY).collect()
    index = {r["feature"]: i for i, r in enumerate(vocabulary)}
    start = np.array([r["odds"] for r in vocabulary])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"y": batch.column("y").to_pylist(), "sizes": [], "ids": []}
            for text in batch.column("text").to_pylist():
                sentences = [[index[f] for w in WORD.findall(m.group().lower()) for f in features(w) if f in index] for m in SENTENCE.finditer(text)] or [[]]
                out["sizes"].append([len(s) for s in sentences])
                out["ids"].append([i for s in sentences for i in s])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("y", pa.int32()), ("sizes", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))]))

    found = rows.select("y", "text").mapInArrow(bags, "y int, sizes array<int>, ids array<int>").toArrow()
    # the sample is drawn by label; weights bring back the shares of the labelled rows
    shares = {r["y"]: r["n"] for r in labels.where(F.lit(True) if only is None else only).groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    y = found.column("y").to_numpy()
    worth = np.where(y == 1, shares[1] / kinds[1], shares[0] / kinds[0])
    return fit(found, y, worth / worth.mean(), start, list(index), rounds)


def fit(found: pa.Table, y: np.ndarray, worth: np.ndarray, start: np.ndarray, names: list[str], rounds: int) -> Model:
    """Gradient descent on the noisy-or likelihood; -log(1 - P) is the sum of softplus over sentences."""
    sizes = found.column("sizes").combine_chunks()
    per_doc = np.diff(sizes.offsets.to_numpy())
    lengths = sizes.flatten().to_numpy()
    ids = found.column("ids").combine_chunks().flatten().to_numpy()
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    doc = np.repeat(np.arange(len(y)), per_doc)
    w, b = np.clip(0.5 * start, -2, 2), np.array([math.log(0.1 / max(1.0, per_doc.mean()))])
    adam = Adam([w, b], 0.05)
    for _ in range(rounds):
        z = b[0] + np.bincount(sentence, weights=w[ids], minlength=len(lengths))
        not_any = np.bincount(doc, weights=softplus(z), minlength=len(y))
        p = -np.expm1(-not_any)
        pull = worth * np.where(y == 1, -np.exp(-not_any) / (NOISE / (1 - NOISE) + p), 1.0) / len(y)
        dz = pull[doc] * sigmoid(z)
        adam.step([w, b], [np.bincount(ids, weights=dz[sentence], minlength=len(w)) + DECAY * w, np.array([dz.sum()])])
    return Model(dict(zip(names, w.tolist(), strict=True)), float(b[0]))


SCHEMA = "doc_id bigint, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int32()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """Score of every whole text and the sentences (offsets in code points) of probability at_least or more."""
    bias, threshold = model.bias, math.log(at_least / (1 - at_least))
    mark = uuid.uuid4().hex

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = held("toxicity", mark, make=model.scorer)
        rows = []
        for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            found = sentence_scores(text, words, bias) or [(0, 0, bias)]
            total = sum_of([z for _, _, z in found])
            rows.append({"doc_id": key, "score": -math.expm1(-total), "n_sentences": len(found), "offending": [{"start": s, "end": e, "score": 1 / (1 + math.exp(-z))} for s, e, z in found if z >= threshold]})
        return pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return map_slices(documents(df, id_col, text_col), run, SCHEMA)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of documents that score below the threshold; no shuffle."""
    bias, at = model.bias, df.columns.index(text_col)
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held("toxicity", mark, make=model.scorer)
        for batch in batches:
            for part in slices(batch):
                totals = [sum_of([z for _, _, z in sentence_scores(t or "", words, bias)] or [bias]) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([-math.expm1(-t) < threshold for t in totals], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def sum_of(logits: list[float]) -> float:
    """-log(1 - P) of a document."""
    return float(softplus(np.array(logits)).sum())


def classify(df: DataFrame, labels: DataFrame, only: Column, **options) -> DataFrame:
    """Trains on the labelled rows that `only` admits and scores all rows."""
    return score(df, train(documents(df), labels, only=only, **options)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
