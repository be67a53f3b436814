"""Held-out accuracy of the two classifiers, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from fixtures import frame, rows
from pyspark.sql import functions as F

from procura.llm import quality, queries, toxicity
from procura.llm.common import documents


def area(y: np.ndarray, s: np.ndarray) -> float:
    r = pd.Series(s).rank().to_numpy()
    p, n = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * n)


@pytest.mark.parametrize(("name", "label"), [("op3_toxicity", "toxic"), ("op10_positive_unlabelled_quality", "quality")])
def test_held_out(spark, name, label):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = queries.queries()[name](spark, sf_dir)
    found = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    y = found["y"].to_numpy()
    assert area(y, found["score"].to_numpy()) > 0.95
    assert (found["predicted"].to_numpy() == y).mean() > 0.9
    whole = scored.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert whole[0] == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and 0 <= whole[1] <= whole[2] <= 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, module):
    df = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(100, 130)] + [(None, 1, 1, "y"), (1, None, None, "z"), (2, 0, 0, ""), (2, 1, 1, ""), (7, 1, 1, "")], "doc_id bigint, quality int, toxic int, text string")
    out = module.classify(df, labels, F.lit(True)).collect()
    assert len(out) == len(rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    by_id: dict = {}
    for r in out:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by_id[5]) == 1 and by_id[1] == by_id[2]  # equal texts, equal scores; null is empty
    assert module.classify(df.limit(0), labels, F.lit(True)).collect() == []
    none = module.classify(df, labels.limit(0), F.lit(True)).collect()
    assert len(none) == len(rows()) and len({r["predicted"] for r in none}) == 1


def test_labels_of_held_out_rows_are_not_read(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    only = F.col("doc_id") % 3 != 0
    other = labels.withColumn("toxic", F.when(only, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.train(documents(docs), x, only=only) for x in (labels, other))
    assert a.weights == b.weights and a.bias == b.bias


def test_noisy_or_and_offending_sentences(spark):
    model = toxicity.Model({"bad": 6.0, "worse": 9.0}, -5.0)
    df = spark.createDataFrame([(1, "Good one. A bad thing! Fine"), (2, None), (3, "worse. bad")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    p = lambda *z: 1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z)
    assert got[1]["score"] == pytest.approx(p(-5, 1, -5)) and got[2]["score"] == pytest.approx(p(-5)) and got[3]["score"] == pytest.approx(p(4, 1))
    assert [(o["start"], o["end"]) for o in got[1]["offending"]] == [(9, 21)]
    kept = toxicity.keep_clean(df, model)
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == df.columns


@pytest.mark.parametrize("shift", [0.0, 2.0, -2.0])
@pytest.mark.parametrize("prior", [None, 0.2, 0.7])
def test_slopes_of_the_risk(prior, shift):
    """The slopes against differences of the risk as it is defined; below zero, the part of negatives is followed upwards."""
    r = np.random.default_rng(3)
    f, n = r.normal(0, 1.5, 12), 5
    f[:n] += shift
    loss = lambda z: math.log1p(math.exp(-z))

    def risk(f: np.ndarray) -> float:
        p, u = f[:n], f[n:]
        if prior is None:
            return float(np.mean([loss(z) for z in p]) + np.mean([loss(-z) for z in u]))
        negative = float(np.mean([loss(-z) for z in u]) - prior * np.mean([loss(-z) for z in p]))
        return prior * float(np.mean([loss(z) for z in p])) + negative if negative >= 0 else -negative

    step = np.eye(len(f)) * 1e-6
    plain = [(risk(f + e) - risk(f - e)) / 2e-6 for e in step]
    assert quality.risk_slope(f, n, prior) == pytest.approx(plain, abs=1e-6)


def test_non_negative_risk_learns_without_negatives():
    """Two clouds; only some of one are labelled."""
    r = np.random.default_rng(0)
    p, u = r.normal(1.5, 1, (300, 5)), np.vstack([r.normal(1.5, 1, (400, 5)), r.normal(-1.5, 1, (600, 5))])
    prior = quality.cross_fitted_prior(p, u, [p, u], np.zeros(5), np.ones(5), 100)
    assert abs(prior - 0.4) < 0.1
    model = quality.Model(np.zeros(5), np.ones(5), quality.descend(p, u, prior, 200, 1, 1e-3), prior)
    assert ((model.logit(u) > 0) == (np.arange(1000) < 400)).mean() > 0.95
