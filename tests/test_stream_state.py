"""State of streams: it empties, later files go on from it, and replayed batches count once."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from procura import streaming

SCHEMA = "event_id long, scope string, item string, s long"


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("event_id", "scope", "item", F.timestamp_seconds("s").alias("ts"))


def plain_limit(rows, most, seconds):
    """Passes by the words of the rule, with the times of all that passed."""
    passed: dict[str, list] = {}
    out = {}
    for i, scope, item, s in sorted(rows, key=lambda r: (r[3], r[0])):
        last = {k: t for k, t in passed.setdefault(scope, []) if s - t < seconds}
        out[i] = len(last) < most
        if out[i]:
            passed[scope].append((item, s))
    return out


@pytest.fixture
def limit_rows():
    r = random.Random(6)
    return [(i, f"k{i % 2}", f"i{r.randint(0, 5)}", 1_700_000_000 + i * 20) for i in range(240)]


def test_limit_over_batches(spark, tmp_path, limit_rows):
    """Two runs with one checkpoint: the second goes on from the state of the first."""
    path, out = str(tmp_path / "events"), str(tmp_path / "out")
    wanted, got = plain_limit(limit_rows, 2, 90), {}
    for part in (limit_rows[:100], limit_rows[100:]):
        events(spark, part).coalesce(1).write.mode("append").parquet(path)
        stream = streaming.table_stream(spark, path, events(spark, part))
        found = streaming.drained(streaming.limited(stream, "scope", "item", "ts", "event_id", most=2, seconds=90.0), conf=streaming.ROCKS, path=out)
        got |= {x["place"]: x["passes"] for x in found.collect()}
    assert got == wanted and {True, False} == set(wanted.values())


def test_limit_state_empties(spark, tmp_path, limit_rows):
    """Once the watermark has passed the window nothing is held of the scopes before."""
    path, out = str(tmp_path / "events"), str(tmp_path / "out")
    for part in (limit_rows, [(1000, "late", "x", 1_700_100_000)], [(1001, "late", "y", 1_700_200_000)]):
        events(spark, part).coalesce(1).write.mode("append").parquet(path)
        stream = streaming.table_stream(spark, path, events(spark, part))
        streaming.drained(streaming.limited(stream, "scope", "item", "ts", "event_id", most=50, seconds=900.0), conf=streaming.ROCKS, path=out)
    with streaming.settings(spark, streaming.ROCKS):
        held = spark.read.format("statestore").option("stateVarName", "held").load(f"{out}-log")
        assert {tuple(r) for r in held.select("key.scope", "user_map_key.item").collect()} == {("late", "y")}


def test_replayed_batches_count_once(spark, tmp_path):
    """The commit of the last batch is lost, so Spark runs it again."""
    path, target, log = str(tmp_path / "pushes"), str(tmp_path / "counters"), str(tmp_path / "log")

    def rows(kinds):
        return spark.createDataFrame([(k, 2, 1, i) for i, k in enumerate(kinds)], "kind string, messages int, failed int, s long").select("kind", "messages", "failed", F.timestamp_seconds("s").alias("at"))

    def state():
        return {r["kind"]: (r["pushes"], r["messages"], r["failed"]) for r in streaming.counted(spark, target).collect()}

    rows("aab").coalesce(1).write.parquet(path)
    streaming.count_pushes(streaming.table_stream(spark, path, rows("a")), target, log)
    assert state() == {"a": (2, 4, 2), "b": (1, 2, 1)}
    rows("ac").coalesce(1).write.mode("append").parquet(path)
    streaming.count_pushes(streaming.table_stream(spark, path, rows("a")), target, log)
    want = {"a": (3, 6, 3), "b": (1, 2, 1), "c": (1, 2, 1)}
    assert state() == want
    commits = sorted((p for p in Path(log, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    streaming.count_pushes(streaming.table_stream(spark, path, rows("a")), target, log)
    assert state() == want


def test_alert_state_goes_with_its_cooldown(spark, tmp_path):
    """A rule that has not fired for its cooldown holds nothing."""
    path, out = str(tmp_path / "events"), str(tmp_path / "out")
    rules = [{"name": n, "metric": n, "threshold": 0.0, "severity": "s", "cooldown": 60.0} for n in "ab"]

    def rows(data):
        return spark.createDataFrame(data, "event_id long, metric string, s long").select("event_id", "metric", F.timestamp_seconds("s").alias("ts"), F.lit(1.0).alias("value"))

    for part in ([(1, "a", 100), (2, "a", 130), (3, "a", 161)], [(4, "b", 100_000)], [(5, "b", 200_000)]):
        rows(part).coalesce(1).write.mode("append").parquet(path)
        stream = streaming.table_stream(spark, path, rows(part))
        found = streaming.drained(streaming.alerts(stream, rules, "ts", "metric", "value", "event_id"), path=out)
    assert {x[0] for x in spark.read.format("statestore").load(f"{out}-log").select("key.name").collect()} <= {"b"}
    assert found.count() >= 1
