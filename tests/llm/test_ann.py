"""Neighbours against a plain search."""

from __future__ import annotations

import math
import random

import pytest

from procura.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, side string, cb int"


def vectors(n: int, dim: int = 9) -> list[tuple]:
    r = random.Random(n)
    data = [(i, [float(r.randint(-9, 9)) / r.choice([1, 3, 1000]) for _ in range(dim)], i % 4, "x", 1) for i in range(n)]
    bad = [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [math.nan] * dim), (n + 4, [math.inf] + [1.0] * (dim - 1)), (n + 5, [None] * dim), (None, [1.0] * dim)]
    copies = [(n + 100 + i, list(data[3][1])) for i in range(30)]  # ties
    return data + [(*x, 0, "y", 2) for x in bad + copies] + [(5, list(data[-1][1]), 0, "z", 3), (n + 20, [1.0, 2.0], 0, "w", 4)]


def plain(data: list[tuple], every: int, k: int) -> set[tuple]:
    good = []
    for i, v, *_ in data:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((i, [float(__import__("numpy").float32(x)) for x in v]))
    out = set()
    for q in {i for i, _ in good if i % every == 0}:
        own = min(v for i, v in good if i == q)
        best: dict[int, float] = {}
        for i, v in good:
            if i != q and len(v) == len(own):
                total = 0.0
                for a, b in zip(own, v):
                    total += (a - b) * (a - b)
                best[i] = min(best.get(i, math.inf), math.sqrt(total))
        for rank, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1):
            out.add((q, rank, i, d))
    return out


@pytest.mark.parametrize(("n", "query_block", "candidate_block"), [(400, 4096, None), (400, 7, 50), (6, 4096, None)])
def test_equals_plain_search(spark, n, query_block, candidate_block):
    from pyspark.sql import functions as F

    data = vectors(n)
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = ann.search(df, F.col("vec_id") % 5 == 0, query_block=query_block, candidate_block=candidate_block).collect()
    assert {tuple(r) for r in got} == plain(data, 5, 10)
    assert len(got) == len(set(map(tuple, got)))


def test_empty(spark):
    from pyspark.sql import functions as F

    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).collect() == []


def test_large_and_small_values(spark):
    """Squares of the components overflow or vanish; distances don't."""
    from pyspark.sql import functions as F

    data = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [1e200, 5.0]), (3, [-1e200, 0.0]), (4, [1.7e308, 1.7e308]), (5, [1e-200, 0.0]), (6, [3e-200, 1e-200]), (10, [2e-200, 0.0]), (20, [-1.7e308, -1.7e308])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got: dict[int, list] = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0, query_block=1, candidate_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [x for x, _ in got[0][:3]] == [1, 2, 5] and [d for _, d in got[0][:2]] == [1.0, 5.0] and all(len(v) == 8 for v in got.values())
    for q, found in got.items():
        own = dict(data)[q]
        for i, d in found:
            assert d == pytest.approx(math.dist(own, dict(data)[i]), rel=1e-12) or (d == 0 or math.isinf(d) and math.dist(own, dict(data)[i]) > 1.7e308) or math.dist(own, dict(data)[i]) < 1e-150


def test_tiles_that_queries_skip(spark, monkeypatch):
    """Vectors in far groups: most tiles are never multiplied, and the neighbours are those of a plain search."""
    import numpy as np

    monkeypatch.setattr(ann, "TILE", 32)
    r = np.random.default_rng(5)
    x = r.normal(size=(12, 8))[r.integers(0, 12, 900)] * 50 + r.normal(size=(900, 8))
    x[40:60] = x[40]  # ties
    ids = r.permutation(900)
    met = []
    meet = ann.Cell.meet
    monkeypatch.setattr(ann.Cell, "meet", lambda self, tile, asked: (met.append(len(asked) * len(tile.ids)), meet(self, tile, asked))[1])
    cell = ann.Cell(ids[:100].tolist(), x[:100], 10)
    cell.search(ann.tiles_of(ids, x))
    assert sum(met) < 100 * 900 / 2
    for i, heap in enumerate(cell.heaps):
        d = ann.distances(np.repeat(x[i : i + 1], 900, axis=0), x)
        plain = sorted((a, b) for a, b in zip(d.tolist(), ids.tolist(), strict=True) if b != ids[i])[:10]
        assert sorted((-a, -b) for a, b in heap) == plain
