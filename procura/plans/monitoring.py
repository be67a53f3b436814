"""Queries: metrics, windows and stateful rules over events, which stand for requests and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitoring, ranges, stats
from ..sources.notices import table
from .registry import query

EVENTS = """e AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 37 <> 0 THEN value END AS value, event_type = 'error' AS failed,
  CASE WHEN event_id % 11 = 0 THEN 503 WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status, 'p' || CAST(user_id % 6 AS VARCHAR) AS endpoint FROM events)"""
DAYTIME = "%Y-%m-%d %H:%M:%S"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.when(k % 37 != 0, F.col("value")).alias("value"), (F.col("event_type") == "error").alias("failed"),
        F.when(k % 11 == 0, 503).when(k % 7 == 0, 404).otherwise(200).alias("status"), F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("endpoint"),
    )


def picked(p: int) -> str:
    return f"list_sort(list(value))[CAST(least(floor(count(value) * {p} / 100), count(value) - 1) AS BIGINT) + 1] AS p{p}"


@query(f"SELECT endpoint, {picked(50)}, {picked(95)}, {picked(99)} FROM e WHERE value IS NOT NULL GROUP BY 1", EVENTS)
def m1_percentiles(spark, sf_dir):
    return monitoring.percentiles(events(spark, sf_dir), ["endpoint"], "value", (50, 95, 99))


@query("""SELECT endpoint, event_type, count(*) AS "count", round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 6) AS average, min(value) AS least, max(value) AS most,
count(*) FILTER (status >= 400) AS errors, round(count(*) FILTER (status >= 400) * 100.0 / count(*), 4) AS error_rate FROM e GROUP BY 1, 2""", EVENTS)
def m2_endpoint_stats(spark, sf_dir):
    return monitoring.endpoint_stats(events(spark, sf_dir), ["endpoint", "event_type"], "value", F.col("status") >= 400)


@query("""SELECT CASE WHEN status >= 500 THEN 'critical' WHEN status >= 400 THEN 'warning' ELSE 'info' END AS severity, count(*) AS "count" FROM e GROUP BY 1""", EVENTS)
def m3_severities(spark, sf_dir):
    return events(spark, sf_dir).groupBy(monitoring.severity(F.col("status")).alias("severity")).agg(stats.n())


@query("""SELECT event_id, value FROM e WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 20""", EVENTS)
def m4_slowest(spark, sf_dir):
    return events(spark, sf_dir).where("value is not null").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


@query("""SELECT queue, waiting, CASE WHEN waiting > 100 OR failed > 20 THEN 'unhealthy' WHEN waiting > 50 THEN 'degraded' ELSE 'healthy' END AS health, round(done * 100.0 / total, 2) AS utilisation FROM (
SELECT 'q' || CAST(user_id % 9 AS VARCHAR) AS queue, count(*) FILTER (event_type IN ('view', 'click')) AS waiting, count(*) FILTER (failed) AS failed, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS total FROM e GROUP BY 1)""", EVENTS)
def m5_queue_health(spark, sf_dir):
    kind = F.col("event_type")
    found = events(spark, sf_dir).groupBy(F.concat(F.lit("q"), (F.col("user_id") % 9).cast("string")).alias("queue")).agg(stats.n(kind.isin("view", "click"), "waiting"), stats.n(F.col("failed"), "failed"), stats.n(kind == "purchase", "done"), stats.n(name="total"))
    health = F.when((F.col("waiting") > 100) | (F.col("failed") > 20), "unhealthy").when(F.col("waiting") > 50, "degraded").otherwise("healthy")
    return found.select("queue", "waiting", health.alias("health"), F.round(F.col("done") * 100.0 / F.col("total"), 2).alias("utilisation"))


@query("""SELECT endpoint, CASE WHEN CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) > 100 THEN 'slow' ELSE 'ok' END AS response, CASE WHEN count(*) / 86400.0 < 0.001 THEN 'low' ELSE 'ok' END AS throughput,
CASE WHEN count(*) FILTER (failed) * 100.0 / count(*) > 5 THEN 'high' ELSE 'ok' END AS errors FROM e GROUP BY 1""", EVENTS)
def m7_threshold_checks(spark, sf_dir):
    mean = F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")
    every = F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("endpoint").agg(F.when(mean > 100, "slow").otherwise("ok").alias("response"), F.when(every / 86400.0 < 0.001, "low").otherwise("ok").alias("throughput"), F.when(F.count_if("failed") * 100.0 / every > 5, "high").otherwise("ok").alias("errors"))


MESSAGES = ("Read timed out", "Connection reset by peer", "cannot decode JSON", "invalid field", "SQL syntax", "HTTP 429 rate limit", "401 not allowed", "something else")
LABELS = ("timeout", "connection", "parse", "validation", "database", "rate_limit", "auth", "unknown")


@query("""SELECT kind, count(*) AS "count" FROM (SELECT CASE event_id % 8 """ + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + """ END AS kind FROM events) GROUP BY 1""")
def m8_error_classes(spark, sf_dir):
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(monitoring.error_class(message).alias("kind")).agg(stats.n())


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (value / 10 <= {b}) AS le_{str(b).replace('.', '_')}" for b in monitoring.BOUNDS) + ", count(*) AS le_inf FROM e GROUP BY 1", EVENTS)
def m9_duration_histogram(spark, sf_dir):
    return monitoring.histogram(events(spark, sf_dir).withColumn("seconds", F.col("value") / 10), ["event_type"], "seconds")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(count(*) FILTER (NOT failed) * 100.0 / count(*), 2) AS success_rate, round(count(*) / 24.0, 4) AS per_hour, round(count(*) FILTER (value <= 50) * 100.0 / count(*), 2) AS within FROM e GROUP BY 1""", EVENTS)
def m11_service_levels(spark, sf_dir):
    """M10 and M11."""
    every = F.count(F.lit(1))
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.count_if(~F.col("failed")) * 100.0 / every, 2).alias("success_rate"), F.round(every / 24.0, 4).alias("per_hour"), F.round(F.count_if(F.col("value") <= 50) * 100.0 / every, 2).alias("within"))


@query(f"""SELECT 'hour' AS size, strftime(date_trunc('hour', ts), '{DAYTIME}') AS start, count(*) FILTER (NOT failed) AS success, count(*) FILTER (failed) AS failure FROM e GROUP BY 2
UNION ALL SELECT 'day', strftime(date_trunc('day', ts), '{DAYTIME}'), count(*) FILTER (NOT failed), count(*) FILTER (failed) FROM e GROUP BY 2""", EVENTS)
def r8_counters(spark, sf_dir):
    rows = events(spark, sf_dir)
    sizes = {"hour": "1 hour", "day": "1 day"}
    parts = [monitoring.tumbling(rows, "ts", w, F.col("failed")).select(F.lit(k).alias("size"), "start", "success", "failure") for k, w in sizes.items()]
    return parts[0].unionByName(parts[1])


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM e WHERE failed""", EVENTS)
def r10_trailing_hour(spark, sf_dir):
    """Errors of a user within the hour before each."""
    return events(spark, sf_dir).where("failed").select("event_id", monitoring.trailing(["user_id"], "ts", 3600).alias("recent"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY endpoint ORDER BY ts RANGE BETWEEN INTERVAL 1 SECOND PRECEDING AND CURRENT ROW) AS recent FROM e""", EVENTS)
def w8_second_rate(spark, sf_dir):
    """Requests of an endpoint within the second before each."""
    return ranges.trailing(events(spark, sf_dir), ["endpoint"], "ts", 1).select("event_id", "recent")


@query("""SELECT endpoint, count(value) AS "count", min(value) AS least, max(value) AS most, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 6) AS average, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM e GROUP BY 1""", EVENTS)
def m6_timing_totals(spark, sf_dir):
    return monitoring.timings(events(spark, sf_dir), ["endpoint"], "value")


@query("""SELECT endpoint, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, round(CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) > 0 THEN count(*) FILTER (event_type = 'view') * 100.0 / count(*) FILTER (event_type IN ('view', 'click')) ELSE 0 END, 4) AS hit_rate FROM e GROUP BY 1""", EVENTS)
def m13_hit_rates(spark, sf_dir):
    """How often a cache had what was asked for, views standing for hits and clicks for misses."""
    return monitoring.hit_rates(events(spark, sf_dir), ["endpoint"], F.col("event_type") == "view", F.col("event_type") == "click")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN m BETWEEN 540 AND 1080 WHEN user_id % 3 = 1 THEN m >= 1320 OR m <= 420 ELSE false END AS quiet FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM e)""", EVENTS)
def r11_quiet_hours(spark, sf_dir):
    u = F.col("user_id") % 3
    start, end = F.when(u == 0, 540).when(u == 1, 1320), F.when(u == 0, 1080).when(u == 1, 420)
    return events(spark, sf_dir).select("event_id", monitoring.quiet(F.hour("ts") * 60 + F.minute("ts"), start, end).alias("quiet"))


SESSIONS = EVENTS + """,
marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)"""


@query(f"""SELECT user_id, strftime(min(ts), '{DAYTIME}') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '{DAYTIME}') AS "end", count(*) AS "count" FROM numbered GROUP BY user_id, s""", SESSIONS)
def r4_sessions(spark, sf_dir):
    return monitoring.sessions(events(spark, sf_dir), "user_id", "ts", "30 minutes")


@query("""SELECT task, arg_max(event_type, (ts, event_type)) AS status, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) AS duration, count(*) AS events, count(*) FILTER (event_type = 'retry') AS retries
FROM (SELECT event_id // 4 AS task, ts, CASE event_type WHEN 'click' THEN 'retry' ELSE event_type END AS event_type FROM e) GROUP BY 1""", EVENTS)
def r14_task_lifecycle(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.floor(F.col("event_id") / 4).alias("task"), "ts", F.when(F.col("event_type") == "click", "retry").otherwise(F.col("event_type")).alias("status"))
    return monitoring.lifecycle(rows, "task", "ts", "status")


#: Alert rules with a cooldown in seconds.
RULES = ({"name": "slow", "metric": "view", "threshold": 80.0, "severity": "warning", "cooldown": 7200.0}, {"name": "costly", "metric": "purchase", "threshold": 90.0, "severity": "critical", "cooldown": 600.0})
FIRINGS = EVENTS + """,
hits AS (SELECT name, severity, cooldown, epoch_us(ts) AS "at", value, row_number() OVER (PARTITION BY name ORDER BY ts, value) AS r FROM e JOIN (VALUES ('slow', 'view', 80.0, 'warning', 7200), ('costly', 'purchase', 90.0, 'critical', 600)) AS t(name, metric, threshold, severity, cooldown) ON event_type = metric AND value > threshold),
fired AS (SELECT * FROM hits WHERE r = 1 UNION ALL SELECT n.* FROM (SELECT f.name AS fname, min(h.r) AS next FROM fired f JOIN hits h ON h.name = f.name AND h.r > f.r AND h."at" - f."at" >= CAST(f.cooldown AS BIGINT) * 1000000 GROUP BY f.name, f.r) x JOIN hits n ON n.name = x.fname AND n.r = x.next)"""


@query('SELECT name, severity, "at", CAST(value AS DOUBLE) AS value FROM fired', "RECURSIVE " + FIRINGS)
def r6_alert_firings(spark, sf_dir):
    """Threshold rules with their cooldowns."""
    return monitoring.alerts(events(spark, sf_dir).withColumnRenamed("event_type", "metric"), list(RULES))


@query("""SELECT severity, name, count(*) AS "count" FROM fired GROUP BY 1, 2""", "RECURSIVE " + FIRINGS)
def m12_alert_statistics(spark, sf_dir):
    return r6_alert_firings(spark, sf_dir).groupBy("severity", "name").agg(stats.n())


#: A breaker's rule, call by call.
CALLS = EVENTS + """,
calls AS (SELECT endpoint, event_id, epoch_us(ts) AS "at", status < 400 AS ok, row_number() OVER (PARTITION BY endpoint ORDER BY ts, event_id) AS r FROM e),
told AS (
  SELECT endpoint, event_id, r, CASE WHEN ok THEN 'closed' ELSE 'closed' END AS state, CASE WHEN ok THEN 0 ELSE 1 END AS run, CAST(NULL AS BIGINT) AS opened, false AS rejected FROM calls WHERE r = 1
  UNION ALL SELECT endpoint, event_id, r,
    CASE WHEN asleep THEN 'open' WHEN now = 'closed' THEN CASE WHEN NOT ok AND run + 1 = 2 THEN 'open' ELSE 'closed' END WHEN NOT ok THEN 'open' WHEN run + 1 = 2 THEN 'closed' ELSE 'half_open' END,
    CASE WHEN asleep THEN 0 WHEN now = 'closed' THEN CASE WHEN ok OR run + 1 = 2 THEN 0 ELSE run + 1 END WHEN ok AND run + 1 < 2 THEN run + 1 ELSE 0 END,
    CASE WHEN asleep THEN opened WHEN NOT ok AND (now = 'half_open' OR run + 1 = 2) THEN "at" END, asleep
  FROM (SELECT c.*, t.opened, t.state = 'open' AND c."at" < t.opened + 1800000000 AS asleep, CASE WHEN t.state = 'open' THEN 'half_open' ELSE t.state END AS now, CASE WHEN t.state = 'open' THEN 0 ELSE t.run END AS run
        FROM told t JOIN calls c ON c.endpoint = t.endpoint AND c.r = t.r + 1))"""


@query("""SELECT endpoint AS key, event_id AS place, state, rejected FROM told""", "RECURSIVE " + CALLS.replace("CASE WHEN ok THEN 'closed' ELSE 'closed' END AS state", "'closed' AS state"))
def r15_circuit_breaker(spark, sf_dir):
    """States of the breakers of all endpoints, by segments of time."""
    return monitoring.breaker(events(spark, sf_dir).withColumn("ok", F.col("status") < 400), "endpoint", "ts", "ok", failures=2, pause=1800.0)


@query("""SELECT name, status, "at", value FROM (
  SELECT *, lag(status) OVER (PARTITION BY name ORDER BY "at", status = 'resolved', value) AS past FROM (
    SELECT name, 'firing' AS status, "at", CAST(value AS DOUBLE) AS value FROM fired
    UNION ALL SELECT name, 'resolved', epoch_us(ts), CAST(value AS DOUBLE) FROM e JOIN (VALUES ('slow', 'view', 80.0), ('costly', 'purchase', 90.0)) AS t(name, metric, threshold) ON event_type = metric AND (value <= threshold OR value IS NULL)))
WHERE status = 'firing' OR past = 'firing'""", "RECURSIVE " + FIRINGS)
def r6_alert_states(spark, sf_dir):
    """Firings with their resolutions."""
    return monitoring.alert_states(events(spark, sf_dir).withColumnRenamed("event_type", "metric"), list(RULES))


MANAGED = EVENTS + """,
metrics AS (SELECT ts, event_id, CASE event_type WHEN 'view' THEN 'api' WHEN 'error' THEN 'error_rate' WHEN 'purchase' THEN 'db' WHEN 'click' THEN 'queue' END AS metric,
  CASE event_type WHEN 'view' THEN coalesce(value, 0) * 120 WHEN 'error' THEN coalesce(value, 0) / 5 WHEN 'purchase' THEN greatest(coalesce(value, 0), user_id % 97) WHEN 'click' THEN coalesce(value, 0) * 12 END::DOUBLE AS value FROM e),
rules(name, metric, threshold, severity) AS (VALUES ('high_response_time', 'api', 3000.0::DOUBLE, 'warning'), ('critical_response_time', 'api', 10000.0, 'critical'), ('high_error_rate', 'error_rate', 10.0, 'warning'), ('db_pool_exhausted', 'db', 90.0, 'critical'), ('queue_backlog', 'queue', 1000.0, 'warning')),
over AS (SELECT name, severity, epoch_us(ts) AS "at", value, row_number() OVER (PARTITION BY name ORDER BY ts, value) AS r FROM metrics JOIN rules USING (metric) WHERE value > threshold),
told AS (SELECT name, severity, "at", value, r, true AS fired, "at" AS last FROM over WHERE r = 1
  UNION ALL SELECT o.name, o.severity, o."at", o.value, o.r, o."at" - t.last >= 3600000000, CASE WHEN o."at" - t.last >= 3600000000 THEN o."at" ELSE t.last END FROM told t JOIN over o ON o.name = t.name AND o.r = t.r + 1)"""


@query("""SELECT name, severity, "at", value FROM told WHERE fired""", "RECURSIVE " + MANAGED)
def r7_default_alerts(spark, sf_dir):
    """The default rules of a manager under one cooldown for all, over four kinds of metrics."""
    kind = F.when(F.col("event_type") == "view", "api").when(F.col("event_type") == "error", "error_rate").when(F.col("event_type") == "purchase", "db").when(F.col("event_type") == "click", "queue")
    value = F.coalesce("value", F.lit(0.0))
    rows = events(spark, sf_dir).withColumn("metric", kind).withColumn("figure", monitoring.measured(kind, value * 120, value / 5, value, F.col("user_id") % 97, value * 12))
    return monitoring.alerts(rows, list(monitoring.DEFAULT_RULES), metric="metric", value="figure", cooldown=3600.0)


DELIVERIES = EVENTS + """,
told AS (SELECT *, row_number() OVER (PARTITION BY notification ORDER BY ts, event_id) AS r FROM (
  SELECT concat(user_id, '/', event_id % 2) AS notification, ts, event_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'error' WHEN 'click' THEN 'delivered' WHEN 'view' THEN 'read' ELSE 'none' END AS what FROM e)),
states AS (
  SELECT notification, event_id, r, CASE what WHEN 'ok' THEN 'sent' ELSE 'pending' END AS status, CASE what WHEN 'error' THEN 1 ELSE 0 END AS retry_count FROM told WHERE r = 1
  UNION ALL SELECT t.notification, t.event_id, t.r,
    CASE WHEN status = 'pending' AND what = 'ok' THEN 'sent' WHEN status = 'pending' AND what = 'error' AND retry_count = 2 THEN 'failed' WHEN status = 'sent' AND what = 'delivered' THEN 'delivered' WHEN status IN ('sent', 'delivered') AND what = 'read' THEN 'read' ELSE status END,
    CASE WHEN status = 'pending' AND what = 'error' THEN retry_count + 1 ELSE retry_count END
  FROM states s JOIN told t ON t.notification = s.notification AND t.r = s.r + 1)"""


@query("""SELECT notification AS key, event_id AS place, status, CAST(retry_count AS BIGINT) AS retry_count FROM states""", "RECURSIVE " + DELIVERIES)
def r13_deliveries(spark, sf_dir):
    """Notifications of a user and channel through their states, attempt by attempt."""
    what = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "delivered").when(F.col("event_type") == "view", "read").otherwise("none")
    rows = events(spark, sf_dir).withColumn("notification", F.concat_ws("/", "user_id", F.col("event_id") % 2)).withColumn("what", what)
    return monitoring.deliveries(rows, "notification", "ts", "event_id", "what").drop("at")


@query("""SELECT user_id, kind, attempt, CAST(least(pow(2, attempt), 60) AS DOUBLE) AS delay FROM (SELECT user_id, event_type AS kind, count(*) - 1 AS attempt FROM e WHERE status >= 400 GROUP BY 1, 2)""", EVENTS)
def r16_backoff(spark, sf_dir):
    """How long to wait before the next attempt of what a user has failed to do, by the attempts so far."""
    failed = events(spark, sf_dir).where("status >= 400").groupBy("user_id", F.col("event_type").alias("kind")).agg((F.count(F.lit(1)) - 1).alias("attempt"))
    return failed.select("user_id", "kind", "attempt", monitoring.backoff(F.col("attempt")).cast("double").alias("delay"))


@query("""SELECT kind, count(*) AS "count", count(*) FILTER (attempts >= 3) AS exhausted FROM (SELECT event_type AS kind, user_id, count(*) AS attempts FROM e WHERE status >= 400 GROUP BY 1, 2) GROUP BY 1""", EVENTS)
def r18_failed_items(spark, sf_dir):
    """Failed items by kind, and those whose retries are used up."""
    items = events(spark, sf_dir).where("status >= 400").groupBy(F.col("event_type").alias("kind"), "user_id").agg(stats.n(name="attempts"))
    return items.groupBy("kind").agg(stats.n(), stats.n(F.col("attempts") >= 3, "exhausted"))


@query("""SELECT user_id % 3 AS digest, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, channel, count(*) AS "count" FROM e, (VALUES ('email'), ('web')) AS c(channel) WHERE event_type = 'signup' AND (user_id % 2 = 0 OR channel = 'web') GROUP BY 1, 2, 3""", EVENTS)
def r12_digest_routing(spark, sf_dir):
    """Notifications fanned out to their channels and gathered by digest and day."""
    channels = F.explode(F.when(F.col("user_id") % 2 == 0, F.array(F.lit("email"), F.lit("web"))).otherwise(F.array(F.lit("web"))))
    rows = events(spark, sf_dir).where("event_type = 'signup'").select((F.col("user_id") % 3).alias("digest"), F.date_format("ts", "yyyy-MM-dd").alias("day"), channels.alias("channel"))
    return rows.groupBy("digest", "day", "channel").agg(stats.n())
