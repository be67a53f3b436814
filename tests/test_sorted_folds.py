"""Alerts and the breaker hold a batch and a state, not a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from test_segmented import plain_breaker

from procura.operators import monitoring

RULES = [{"name": n, "metric": m, "threshold": 0.0, "severity": "s", "cooldown": c} for n, m, c in (("a", "m0", 50.0), ("b", "m1", 7.0), ("c", "m1", 400.0))]


def test_folds_carry_their_state_over_batches(spark, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = spark.range(200).select(F.col("id").alias("event_id"), F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("metric"), F.timestamp_seconds(F.col("id") * 3).alias("ts"), F.lit(1.0).alias("value"), (F.col("id") % 7 < 4).alias("ok"))
        fired = monitoring.alerts(rows, RULES)
        want = set()
        for rule in RULES:
            last = None
            for i in range(int(rule["metric"][1]), 200, 2):
                if last is None or 3 * i - last >= rule["cooldown"]:
                    last = 3 * i
                    want.add((rule["name"], last * 10**6))
        assert {(r["name"], r["at"]) for r in fired.collect()} == want
        states = monitoring.breaker(rows, "metric", "ts", "ok", 2, 15.0, 2)
        wanted = {}
        for k in (0, 1):
            wanted |= {place: (state, rejected) for place, state, rejected in plain_breaker([(3 * i * 10**6, i, i % 7 < 4) for i in range(k, 200, 2)], 2, 15 * 10**6, 2)}
        assert {r["place"]: (r["state"], r["rejected"]) for r in states.collect()} == wanted
        for df in (fired, states):
            assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
