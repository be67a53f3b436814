"""Metrics over request and task events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import ranges, segmented
from .stats import n

#: Upper bounds of the duration histogram in seconds, and words of error classes in order.
BOUNDS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
ERROR_WORDS = (("timeout", ("timeout", "timed out")), ("connection", ("connection", "connect", "network")), ("parse", ("parse", "json", "decode")), ("validation", ("validation", "invalid")), ("database", ("database", "sql")), ("rate_limit", ("rate limit", "429")), ("auth", ("auth", "401", "403")))


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: tuple[int, ...]) -> DataFrame:
    """Nearest-rank percentiles: the value at place min(int(n * p / 100), n - 1) of the sorted values.

    Values are counted, and the counts of whole ranges of values say which place a range begins at; so the
    values of one key are spread over all tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    placed = ranges.running(counted, keys, [F.col(value)], F.col("c"), "upto", "n")
    picks = []
    for p in wanted:
        place = F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
        picks.append(F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col(value))).alias(f"p{p}"))
    return placed.groupBy(*keys).agg(*picks)


def endpoint_stats(df: DataFrame, keys: list[str], value: str, failed: Column) -> DataFrame:
    cents = F.col(value).cast("decimal(18,4)")
    return df.groupBy(*keys).agg(n(), F.round(F.sum(cents).cast("double") / F.count(value), 6).alias("average"), F.min(value).alias("least"), F.max(value).alias("most"), n(failed, "errors"), F.round(F.count_if(failed) * 100.0 / F.count(F.lit(1)), 4).alias("error_rate"))


def timings(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Number, least, most, average and total of the values that there are."""
    cents = F.sum(F.col(value).cast("decimal(18,4)")).cast("double")
    return df.groupBy(*keys).agg(F.count(value).alias("count"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(cents / F.count(value), 6).alias("average"), cents.alias("total"))


def hit_rates(df: DataFrame, keys: list[str], hit: Column, miss: Column) -> DataFrame:
    """Hits, misses and their rate in percent; zero without any."""
    asked = F.count_if(hit) + F.count_if(miss)
    return df.groupBy(*keys).agg(n(hit, "hits"), n(miss, "misses"), F.round(F.when(asked > 0, F.count_if(hit) * 100.0 / asked).otherwise(0.0), 4).alias("hit_rate"))


def histogram(df: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts of values up to each bound, and all."""
    return df.groupBy(*keys).agg(*(n(F.col(value) <= b, f"le_{str(b).replace('.', '_')}") for b in bounds), n(name="le_inf"))


def severity(status: Column) -> Column:
    return F.when(status >= 500, "critical").when(status >= 400, "warning").otherwise("info")


def error_class(message: Column) -> Column:
    out, low = F.when(F.lit(False), ""), F.lower(message)
    for name, words in ERROR_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, name)
    return out.otherwise("unknown")


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt) * base, F.lit(most))


def tumbling(df: DataFrame, ts: str, size: str, failed: Column) -> DataFrame:
    """Successes and failures per window of a size."""
    return df.groupBy(F.window(ts, size).alias("w")).agg(n(~failed, "success"), n(failed, "failure")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "success", "failure")


def trailing(keys: list[str], ts: str, seconds: int) -> Column:
    """Rows of the same keys in the seconds up to and with a row."""
    return F.count(F.lit(1)).over(W.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0))


def quiet(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day is within quiet hours, which may pass midnight; both ends belong to them."""
    return F.when(start.isNull() | end.isNull(), F.lit(False)).when(start <= end, minute.between(start, end)).otherwise((minute >= start) | (minute <= end))


def sessions(df: DataFrame, key: str, ts: str, gap: str = "60 seconds") -> DataFrame:
    """Spans of activity of a key with pauses shorter than the gap."""
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(n()).select(key, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("end"), "count")


def lifecycle(df: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    """Last status of a task, its first and last time, its duration and its retries."""
    return df.groupBy(key).agg(F.max_by(status, F.struct(ts, status)).alias("status"), F.round((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6, 3).alias("duration"), n(name="events"), n(F.col(status) == "retry", "retries"))


def crossings(df: DataFrame, rules: list[dict], ts: str, metric: str, value: str) -> DataFrame:
    """Every event with each rule that watches its metric, and whether the value passes the rule's threshold."""
    plain = [{"below": False, "enabled": True} | r for r in rules]
    table = df.sparkSession.createDataFrame([(r["name"], r["metric"], float(r["threshold"]), r["severity"], float(r["cooldown"]), r["below"]) for r in plain if r["enabled"]], RULE)  # rules are written in the program
    seen = df.join(F.broadcast(table.withColumnRenamed("metric", "__metric")), F.col(metric) == F.col("__metric"))
    over = F.when(F.col("below"), F.col(value) < F.col("threshold")).otherwise(F.col(value) > F.col("threshold"))
    return seen.select("name", "severity", "cooldown", F.unix_micros(ts).alias("at"), F.col(value).cast("double").alias("value"), F.coalesce(over, F.lit(False)).alias("over"))


RULE = "name string, metric string, threshold double, severity string, cooldown double, below boolean"


def alerts(df: DataFrame, rules: list[dict], ts: str = "ts", metric: str = "metric", value: str = "value", cooldown: float | None = None, sleeps: int = segmented.SLEEPS) -> DataFrame:
    """Firings of threshold rules with a cooldown: name, severity, at, value.

    A rule (name, metric, threshold, severity, cooldown in seconds; `below` if it fires under its threshold,
    `enabled` if not always) fires when the value passes its threshold and it has not fired within its
    cooldown. A cooldown given here holds for all rules instead of their own.
    """
    rules = rules if cooldown is None else [r | {"cooldown": cooldown} for r in rules]
    hits = crossings(df, rules, ts, metric, value).where("over")
    pause = (F.col("cooldown") * 1_000_000).cast("bigint")
    run = segmented.scan(hits, segmented.cooldown(), F.col("name"), F.col("at"), F.col("value"), F.lit(True), pause, lambda before, *_: (before is not None,), "fired boolean", sleeps)
    severities = df.sparkSession.createDataFrame([(r["name"], r["severity"]) for r in rules], "key string, severity string")
    return run.where("fired").join(F.broadcast(severities), "key").select(F.col("key").alias("name"), "severity", "at", F.col("place").alias("value"))


def alert_states(df: DataFrame, rules: list[dict], ts: str = "ts", metric: str = "metric", value: str = "value", cooldown: float | None = None) -> DataFrame:
    """Firings, and the first event after each that no longer passes the threshold: name, status, at, value.

    Until such an event an alert is active, and further firings are those of the same alert.
    """
    rules = rules if cooldown is None else [r | {"cooldown": cooldown} for r in rules]
    fired = alerts(df, rules, ts, metric, value).select("name", "at", "value", F.lit("firing").alias("status"))
    calm = crossings(df, rules, ts, metric, value).where("NOT over").select("name", "at", "value", F.lit("calm").alias("status"))
    # an event that is calm ends what was fired before it
    both = fired.unionByName(calm)
    seen = segmented.before(both, F.col("name"), F.col("at"), F.struct(F.col("status") == "calm", "value"), F.col("status"), F.lit(86_400_000_000))
    ended = (F.col("status") == "calm") & (F.col("before") == "firing")
    return seen.where((F.col("status") == "firing") | ended).select("name", F.when(F.col("status") == "calm", "resolved").otherwise("firing").alias("status"), "at", "value")


#: The rules of a plain alert manager, and the one cooldown of all in seconds.
DEFAULT_RULES = (
    {"name": "high_response_time", "metric": "api", "threshold": 3000.0, "severity": "warning", "cooldown": 60.0}, {"name": "critical_response_time", "metric": "api", "threshold": 10000.0, "severity": "critical", "cooldown": 60.0},
    {"name": "high_error_rate", "metric": "error_rate", "threshold": 10.0, "severity": "warning", "cooldown": 60.0}, {"name": "db_pool_exhausted", "metric": "db", "threshold": 90.0, "severity": "critical", "cooldown": 60.0},
    {"name": "queue_backlog", "metric": "queue", "threshold": 1000.0, "severity": "warning", "cooldown": 60.0},
)
DEFAULT_COOLDOWN = 300.0


def measured(kind: Column, response_time: Column, error_rate: Column, pool_usage: Column, wait_time: Column, queue_length: Column) -> Column:
    """What the rules of a kind of metric look at; of a pool's two figures the larger one, a missing figure counts as zero."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(kind == "api", zero(response_time)).when(kind == "error_rate", zero(error_rate)).when(kind == "db", F.greatest(zero(pool_usage), zero(wait_time))).when(kind == "queue", zero(queue_length))


def breaker_rows(df: DataFrame, key: Column, at: Column, place: Column, ok: Column, failures: int, pause: int, successes: int, sleeps: int = segmented.SLEEPS) -> DataFrame:
    """(key, place, state, rejected) of every call; at and pause in the same unit."""
    named = lambda before, after, until: ("open" if until is not None else after[0], before is None)
    return segmented.scan(df, segmented.breaker(failures, successes), key, at, place, ok, F.lit(pause), named, "state string, rejected boolean", sleeps).drop("at")


def breaker(df: DataFrame, key: str, ts: str, ok: str, failures: int = 5, pause: float = 60.0, successes: int = 2) -> DataFrame:
    """States of a circuit breaker after each event of a key, in time order: closed, open, half_open.

    It opens after so many failures in a row, lets a call through after the pause and closes after so
    many successes; a call while it is open is rejected and changes nothing.
    """
    return breaker_rows(df, F.col(key), F.unix_micros(ts), F.col("event_id"), F.col(ok), failures, int(pause * 1e6), successes)


def deliveries(df: DataFrame, key: str, ts: str, place: str, event: str, retries: int = 3) -> DataFrame:
    """(key, place, at, status, retry_count) of notifications after each thing that happens to them."""
    machine = segmented.delivery(retries)
    return segmented.scan(df, machine, F.col(key), F.unix_micros(ts), F.col(place), F.col(event), F.lit(86_400_000_000), lambda before, after, until: after, "status string, retry_count long")
