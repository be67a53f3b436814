"""Ball k-means against Lloyd's rounds with Python's whole numbers, and the work that balls spare."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from procura.llm import ball_kmeans

SCHEMA = "vec_id bigint, embedding array<double>, label int, cluster int, vector string, squared string"


def plain(data, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> Counter:
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centres = [v for _, v in sorted(kept, key=lambda p: (digest(p[0]), p[1]))[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members: dict[int, list] = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(col) // len(members[j]) for col in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centres)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia: Counter = Counter()
    for _, d, j in final:
        inertia[j] += d
    long = lambda x: x if x < 1 << 63 else None
    return Counter((i, j, long(d), long(inertia[j]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in final)


def found(df) -> Counter:
    return Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, 7, "x", None) for i, v in data], SCHEMA).repartition(3)


def points(n: int, seed: int, spread: float = 1.0, scale: float = 1.0, groups: int = 12):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(groups)]
    return [(i, [scale * (c + r.gauss(0, spread)) for c in r.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "scale", "rounds"), [(1.0, 1.0, 10), (0.05, 1.0, 3), (0.3, 3000.0, 2), (0.3, 3e6, 3)])
def test_against_lloyd(spark, spread, scale, rounds):
    data = points(150, 4, spread, scale)
    assert found(ball_kmeans.cluster(frame(spark, data), rounds=rounds)) == plain(data, rounds=rounds)


def test_ties_repeats_and_unusable_vectors(spark):
    """A coarse grid is full of equal distances and equal centroids."""
    r = random.Random(9)
    data = [(i, [r.choice((0.0, 1 / 1024)) if j < 3 else 0.0 for j in range(64)]) for i in range(60)]
    data += data[:7] + [(None, data[3][1]), (90, None), (91, []), (92, [0.0] * 63), (93, [0.0] * 65), (94, [float("nan")] + [0.0] * 63), (95, [float("inf")] + [0.0] * 63), (96, [None] + [0.0] * 63)]
    assert found(ball_kmeans.cluster(frame(spark, data))) == plain(data)


def test_few_vectors_and_none(spark):
    data = points(3, 2)
    assert found(ball_kmeans.cluster(frame(spark, data), rounds=1)) == plain(data, rounds=1)
    assert ball_kmeans.cluster(frame(spark, [(1, None)])).collect() == []
    assert ball_kmeans.cluster(frame(spark, data).limit(0)).collect() == []


def test_distances_beyond_a_long_are_null(spark):
    data = [(i, [x * 5e12 for x in v]) for i, v in points(12, 3)]
    assert found(ball_kmeans.cluster(frame(spark, data), rounds=2)) == plain(data, rounds=2)


def test_components_out_of_range(spark):
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.cluster(frame(spark, [(1, [1e300] * 64)]))


def test_few_distances_are_computed():
    """In groups that lie apart, members stay in the stable core: about one distance each instead of k."""
    rows = np.floor(np.array([v for _, v in points(2000, 7, 0.01, groups=8)]) * 1024)
    labels = np.zeros(len(rows), np.int32)
    r = random.Random(7)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(8)]
    centroids = np.floor(np.array(centres) * 1024)
    near = ball_kmeans.neighbours([[int(x) for x in c] for c in centroids], None)
    labels, best, first = ball_kmeans.assign(rows, labels, centroids, near)
    again, same, took = ball_kmeans.assign(rows, labels, centroids, near)
    every = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (labels == every.argmin(axis=1)).all() and (again == labels).all() and (best == every.min(axis=1)).all() and (same == best).all()
    assert took == len(rows) < first
