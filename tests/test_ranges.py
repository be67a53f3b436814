"""Ranks, running sums, deep pages and trailing windows against plain lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from procura.operators import monitoring, ranges


def rows(n: int, seed: int = 1):
    r = random.Random(seed)
    return [(i, r.choice(["hot", "hot", "hot", "cold", None]), r.randint(0, 30), 1_700_000_000_000_000 + r.randint(0, 40_000_000)) for i in range(n)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(rows(500), "id long, k string, v int, us long").withColumn("ts", F.timestamp_micros("us")).repartition(3)


def test_ranks_and_running_sums(spark, table):
    want = {i: place for place, (i, *_) in enumerate(sorted(rows(500), key=lambda x: (-x[2], x[0])), 1)}
    got = ranges.ranks(table, [F.desc("v"), F.col("id")])
    assert {r["id"]: r["rank"] for r in got.collect()} == want and got.columns == [*table.columns, "rank"]
    for key in ("hot", "cold", None):
        own = sorted((v, i) for i, k, v, _ in rows(500) if k == key)
        upto, at = {}, 0
        for v, i in own:
            at += v
            upto[i] = (at, sum(x for x, _ in own))
        found = ranges.running(table, ["k"], [F.col("v"), F.col("id")], F.col("v")).where(F.col("k").eqNullSafe(F.lit(key)))
        assert {r["id"]: (r["upto"], r["total"]) for r in found.collect()} == upto
    assert ranges.ranks(table.limit(0), [F.col("id")]).collect() == []


@pytest.mark.parametrize(("page", "clamp"), [(1, True), (7, True), (50, True), (51, True), (10**9, True), (-3, True), (51, False), (50, False)])
def test_deep_pages(table, page, clamp):
    order = sorted(rows(500), key=lambda x: (-x[2], x[0]))
    number = max(1, min(page, 50) if clamp else page)
    got = ranges.page_rows(table, [F.desc("v"), F.col("id")], page, 10, clamp)
    assert [r["id"] for r in got.collect()] == [i for i, *_ in order[(number - 1) * 10 : number * 10]]


@pytest.mark.parametrize("windows", [1, 2, 64])
def test_trailing_windows(table, monkeypatch, windows):
    monkeypatch.setattr(ranges, "WINDOWS", windows)
    got = {r["id"]: r["recent"] for r in ranges.trailing(table, ["k"], "ts", 3).collect()}
    assert got == {i: sum(k2 == k and us - 3_000_000 <= us2 <= us for _, k2, _, us2 in rows(500)) for i, k, _, us in rows(500)}


def test_one_key_is_spread(spark, table):
    """Percentiles of six keys, one of which has most rows: its values lie in several ranges."""
    got = {r["k"]: (r["p50"], r["p99"]) for r in monitoring.percentiles(table, ["k"], "v", (50, 99)).collect()}
    for key, pair in got.items():
        own = sorted(v for _, k, v, _ in rows(500) if k == key)
        assert pair == tuple(own[min(len(own) * p // 100, len(own) - 1)] for p in (50, 99))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ranges.dealt(table.where("k = 'hot'"), [F.col("k"), F.col("id")]).select("__range").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
