"""Segmented scans against folds over whole keys that are written here without the library's."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from procura.operators import segmented
from procura.operators.monitoring import breaker_rows


def plain_cooldown(events, cooldown):
    """Places of firings."""
    out, last = [], None
    for at, place, _ in sorted(events):
        if last is None or at >= last + cooldown:
            out.append(place)
            last = at
    return out


def plain_breaker(events, failures, pause, successes):
    """(place, state after, rejected), by the words of the rule: counts since the last change of state."""
    out, mode, run, opened = [], "closed", 0, None
    for at, place, ok in sorted(events):
        if mode == "open" and at < opened + pause:
            out.append((place, "open", True))
            continue
        if mode == "open":
            mode, run = "half_open", 0
        if mode == "closed":
            run = 0 if ok else run + 1
            if run == failures:
                mode, opened = "open", at
        elif ok:
            run += 1
            if run == successes:
                mode, run = "closed", 0
        else:
            mode, opened = "open", at
        out.append((place, mode, False))
    return out


def events_of(seed: int, n: int, dense: float):
    """Bursts, quiet stretches and equal times."""
    r = random.Random(seed)
    at, out = -5000, []
    for place in range(n):
        at += 0 if r.random() < 0.1 else r.randint(1, 3) if r.random() < dense else r.randint(50, 900)
        out.append((at, place, r.random() < 0.6))
    return out


@pytest.mark.parametrize(("seed", "dense", "sleep", "sleeps"), [(1, 0.95, 40, 2), (2, 0.5, 300, 1), (3, 0.99, 100, 64), (4, 0.8, 1, 3), (5, 0.97, 60, 1)])
def test_transfer_functions(seed, dense, sleep, sleeps):
    """Chunk by chunk through the functions alone gives what a run over all events gives."""
    events = sorted(events_of(seed, 800, dense))
    for machine in (segmented.cooldown(), segmented.breaker(3, 2)):
        span, state, whole = sleep * sleeps, (0, None), segmented.run_of(machine, (0, None))
        for chunk in sorted({at // span for at, *_ in events}):
            own = [e for e in events if e[0] // span == chunk]
            transfer = segmented.Transfer(machine, chunk * span, sleep)
            for at, _, ok in own:
                transfer.on(at, ok)
                _, last, until = whole(at, ok, sleep)
            for entry, upto, out, end in transfer.rows():
                if entry == state[0] if entry is not None else state[1] is not None and upto >= state[1]:
                    state = (out, end)
                    break
            assert state == ((None, until) if until is not None else (machine.states.index(last), None))


def table(spark, groups):
    rows = [(k, at, place, ok) for k, events in groups.items() for at, place, ok in events]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "k string, at bigint, place bigint, ok boolean").repartition(3)


def test_cooldowns(spark):
    groups = {"hot": events_of(1, 3000, 0.97), "cold": events_of(2, 50, 0.1), "one": [(7, 1, True)]}
    c = F.col
    out = segmented.scan(table(spark, groups), segmented.cooldown(), c("k"), c("at"), c("place"), c("ok"), F.lit(60), lambda before, *_: (before is not None,), "fired boolean", sleeps=3)
    got = {k: [] for k in groups}
    for r in out.where("fired").collect():
        got[r["key"]].append(r["place"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(plain_cooldown(e, 60)) for k, e in groups.items()}


def test_breakers_and_spread(spark):
    groups = {"hot": events_of(3, 3000, 0.97), "cold": events_of(4, 60, 0.2)}
    c = F.col
    out = breaker_rows(table(spark, groups), c("k"), c("at"), c("place"), c("ok"), 3, 200, 2, sleeps=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.where("key = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, e in groups.items():
        assert sorted((r["place"], r["state"], r["rejected"]) for r in out.where(c("key") == k).collect()) == sorted(plain_breaker(e, 3, 200, 2))
    assert breaker_rows(table(spark, {"x": []}), c("k"), c("at"), c("place"), c("ok"), 3, 200, 2).collect() == []


def test_values_before(spark):
    groups = {"a": events_of(5, 400, 0.9), "b": events_of(6, 20, 0.1)}
    c = F.col
    rows = table(spark, groups).withColumn("v", F.when(c("place") % 7 == 0, c("place")))
    got = {(r["k"], r["place"]): r["before"] for r in segmented.before(rows, c("k"), c("at"), c("place"), c("v"), F.lit(50)).collect()}
    for k, events in groups.items():
        last = None
        for _, place, _ in sorted(events):
            assert got[k, place] == last
            last = place if place % 7 == 0 else last


def test_deliveries():
    """Words for events: attempts, receipts and readings."""
    for events, want in {
        ("error", "error", "ok", "delivered", "read"): ("read", 2), ("error", "error", "error", "ok"): ("failed", 3), ("delivered", "read"): ("pending", 0),
        ("ok", "error", "read"): ("read", 0), ("ok", "ok", "delivered", "delivered"): ("delivered", 0), (): ("pending", 0),
    }.items():
        on, state = segmented.run_of(segmented.delivery(), (0, None)), ("pending", 0)
        for i, e in enumerate(events):
            _, state, _ = on(i, e, 1)
        assert state == want
