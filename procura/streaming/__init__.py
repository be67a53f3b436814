"""Structured Streaming forms of the push, counter, alert and limit rules.

Every function takes a streaming DataFrame with an event-time column of type timestamp and gives one back;
state is kept by key, so it is spread over the cluster, and is dropped by the watermark or a timeout. Rules
with a memory (alerts, breaker, limiter) see the events of a key in the order of event time within a batch.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import predicates
from ..operators.tables import shared_folder


def counters(stream: DataFrame, ts: str, size: str, failed: Column, lateness: str = "10 minutes") -> DataFrame:
    """Successes and failures per tumbling window; rows later than the watermark are left out."""
    late = stream.withWatermark(ts, lateness)
    counted = late.groupBy(F.window(ts, size).alias("w")).agg(F.count_if(~failed).cast("bigint").alias("success"), F.count_if(failed).cast("bigint").alias("failure"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "success", "failure")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Spans of activity of a key; a key is live while its span is open."""
    found = stream.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return found.select(key, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("end"), "count")


def pushed(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Notices with the connections whose filters they pass: a stream joined with a static table of known size."""
    c = F.col
    wanted = predicates.push(c("regions"), c("industries"), c("low"), c("high"), c("least_score"), c("total_score"))
    return stream.join(F.broadcast(subscriptions), wanted)


def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(["at", "place"], kind="stable")


def alerts(stream: DataFrame, rules: list[dict], ts: str, metric: str, value: str, place: str, lateness: str = "10 minutes") -> DataFrame:
    """Firings of threshold rules with their cooldowns; the state of a rule is the time it last fired, until its cooldown is over."""
    table = stream.sparkSession.createDataFrame(rules, "name string, metric string, threshold double, severity string, cooldown double").withColumnRenamed("metric", "__metric")
    # the table of rules is written in the program
    hits = stream.withWatermark(ts, lateness).join(F.broadcast(table), F.col(metric) == F.col("__metric")).where(F.col(value) > F.col("threshold"))
    hits = hits.select(F.col(ts).alias("ts"), "name", "severity", "cooldown", F.unix_micros(ts).alias("at"), F.col(value).cast("double").alias("value"), F.col(place).cast("bigint").alias("place"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out, until = state.get[0] if state.exists else None, [], 0
        for r in in_order(batches).itertuples():
            if last is None or r.at - last >= r.cooldown * 1e6:
                out.append((r.name, r.severity, r.at, r.value))
                last = r.at
            until = int(last + r.cooldown * 1e6) // 1000 + 1
        state.update((last,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["name", "severity", "at", "value"])

    return hits.groupBy("name").applyInPandasWithState(step, "name string, severity string, at long, value double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def breaker(stream: DataFrame, key: str, ts: str, ok: str, place: str, failures: int = 5, pause: float = 60.0, successes: int = 2) -> DataFrame:
    """States of a circuit breaker after each event of a key; a breaker that is closed without failures is as one never seen, and keeps no state."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("at"), F.col(ok).alias("ok"), F.col(place).cast("bigint").alias("place"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, bad, good, since = state.get if state.exists else ("closed", 0, 0, 0)
        out = []
        for r in in_order(batches).itertuples():
            now, bad, good, since, rejected = after(now, bad, good, since, r.at, r.ok, failures, pause, successes)
            out.append((r.key, r.place, now, rejected))
        if (now, bad) == ("closed", 0):
            state.remove()
        else:
            state.update((now, bad, good, since))
        yield pd.DataFrame(out, columns=["key", "place", "state", "rejected"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, place long, state string, rejected boolean", "now string, bad int, good int, since long", "append", GroupStateTimeout.NoTimeout)


def after(now: str, bad: int, good: int, since: int, at: int, ok: bool, failures: int, pause: float, successes: int) -> tuple:
    """State of a breaker after one call, and whether the call was rejected."""
    if now == "open":
        if at - since < pause * 1e6:
            return now, bad, good, since, True
        now, good = "half_open", 0
    if ok:
        bad, good = 0, good + 1
        if now == "half_open" and good >= successes:
            now = "closed"
    else:
        bad += 1
        if now == "half_open" or bad >= failures:
            now, since, bad = "open", at, 0
    return now, bad, good, since, False


class Limit(StatefulProcessor):
    """A limit of distinct items within a rolling window; held items are a map, and a timer empties it."""

    def __init__(self, most: int, span: int):
        self.most, self.span = most, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "item string", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        held, out = dict(before), []
        for r in in_order(rows).itertuples():
            held = {k: t for k, t in held.items() if r.at - t < self.span}
            passes = len(held) < self.most
            if passes:
                held[r.item] = r.at
            out.append((r.scope, r.place, passes))
        for item in before.keys() - held.keys():
            self.held.removeKey((item,))
        for item, at in held.items():
            if before.get(item) != at:
                self.held.updateValue((item,), (at,))
        self.wait(held.values())
        yield pd.DataFrame(out, columns=["scope", "place", "passes"])

    def wait(self, times) -> None:
        """A timer for the time when the last of the items is too old."""
        end = -(-(max(times) + self.span) // 1000)
        for earlier in list(self.handle.listTimers()):
            if earlier != end:
                self.handle.deleteTimer(earlier)
        self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, scope: str, item: str, ts: str, place: str, most: int = 100, seconds: float = 1.0, lateness: str = "10 minutes") -> DataFrame:
    """Events with whether they pass a limit of distinct items per scope within the seconds before.

    An event is refused while as many items are held, its own among them or not; one that passes renews its
    item's time. A scope holds `most` items at most, and none once the watermark has passed the window.
    """
    rows = stream.withWatermark(ts, lateness).select(F.col(ts).alias("ts"), F.col(scope).cast("string").alias("scope"), F.col(item).cast("string").alias("item"), F.unix_micros(ts).alias("at"), F.col(place).cast("bigint").alias("place"))
    return rows.groupBy("scope").transformWithStateInPandas(Limit(most, int(seconds * 1_000_000)), "scope string, place long, passes boolean", "Append", "EventTime")


#: What streams with maps and timers need: state on disk, in one format.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def push_counters(pushes: DataFrame) -> DataFrame:
    """Running counters of pushes (kind, messages, failed, at) by kind, as a stream in update mode or a table."""
    return pushes.groupBy("kind").agg(F.count(F.lit(1)).alias("pushes"), F.sum("messages").cast("bigint").alias("messages"), F.sum("failed").cast("bigint").alias("failed"), F.max("at").alias("last"))


def keep_counters(batch: DataFrame, number: int, path: str) -> None:
    """Stores what a batch changed under its number; a batch that is replayed writes over itself."""
    batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The counters as they stand: those of the last batch that changed each."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    values = [c for c in rows.columns if c not in ("kind", "batch")]
    return rows.groupBy("kind").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("kind", "v.*")


def count_pushes(pushes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Takes what is new of a stream of pushes into the counters below path."""
    spark = pushes.sparkSession
    writer = push_counters(pushes).writeStream.outputMode("update").foreachBatch(lambda batch, number: keep_counters(batch, number, path))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counted(spark, path)


def drained(stream: DataFrame, mode: str = "append", conf: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives its result as a table in the shared folder.

    In mode complete the last state counts; it is written whole by each batch. Settings of the session hold while it runs.
    A path that is given is gone on from: what is new adds to what is there.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).outputMode(mode)
    with settings(spark, conf or {}):
        writer.option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def table_stream(spark, path: str, like: DataFrame) -> DataFrame:
    """A parquet file or folder as a stream of new files."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(like.schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(like.schema).parquet(path)
