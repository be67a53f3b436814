"""Queries: Structured Streaming runs, partitioned sinks and similar texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import cleaning, scoring, similarity, stats
from ..operators.tables import shared_folder
from ..sources import sinks
from ..sources.notices import AS_OF, bids, table, wins
from .matching import PUSH_SCHEMA, PUSHED, PUSHES, news_and_stored
from .monitoring import EVENTS, FIRINGS, RULES
from .opportunities import PROFILE, WORDS
from .registry import query


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = streaming.table_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events"))
    k = F.col("event_id")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.when(k % 37 != 0, F.col("value")).alias("value"), (F.col("event_type") == "error").alias("failed"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (NOT failed) AS success, count(*) FILTER (failed) AS failure FROM e GROUP BY 1""", EVENTS)
def r8_stream_counters(spark, sf_dir):
    """Hour counters as a stream; the state is written whole."""
    return streaming.drained(streaming.counters(event_stream(spark, sf_dir), "ts", "1 hour", F.col("failed")), "complete")


@query('SELECT name, severity, "at", CAST(value AS DOUBLE) AS value FROM fired', "RECURSIVE " + FIRINGS)
def r6_stream_alerts(spark, sf_dir):
    """Alert rules with their cooldowns as state of a stream."""
    return streaming.drained(streaming.alerts(event_stream(spark, sf_dir), list(RULES), "ts", "event_type", "value", "event_id"))


LIMIT = EVENTS + """,
told AS (SELECT endpoint, event_id, user_id, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY endpoint ORDER BY ts, event_id) AS r FROM e),
steps AS (
  SELECT endpoint, event_id, r, true AS passes, [{'item': user_id, 'at': "at"}] AS held FROM told WHERE r = 1
  UNION ALL SELECT endpoint, event_id, r, len(own) < 3, CASE WHEN len(own) < 3 THEN list_append(list_filter(own, lambda x: x.item <> user_id), {'item': user_id, 'at': "at"}) ELSE own END
  FROM (SELECT t.*, list_filter(s.held, lambda x: t."at" - x."at" < 1800000000) AS own FROM steps s JOIN told t ON t.endpoint = s.endpoint AND t.r = s.r + 1))"""


@query("""SELECT endpoint AS scope, event_id AS place, passes FROM steps""", "RECURSIVE " + LIMIT)
def r3_stream_limit(spark, sf_dir):
    """At most three users at once on an endpoint within half an hour, as a stream with maps and timers."""
    scope = F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string"))
    rows = event_stream(spark, sf_dir).withColumn("endpoint", scope)
    return streaming.drained(streaming.limited(rows, "endpoint", "user_id", "ts", "event_id", most=3, seconds=1800.0), conf=streaming.ROCKS)


@query("""SELECT kind, count(*) AS pushes, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(least(messages, failed)) AS BIGINT) AS failed, max(ts) AS last FROM (
SELECT CASE event_type WHEN 'view' THEN 'new_tender' ELSE 'opportunity_alert' END AS kind, user_id % 5 AS messages, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS failed, ts FROM e WHERE event_type IN ('view', 'purchase')) GROUP BY 1""", EVENTS)
def r5_push_counters(spark, sf_dir):
    """Pushes, their messages, failures and last time as running counters."""
    kind = F.when(F.col("event_type") == "view", "new_tender").when(F.col("event_type") == "purchase", "opportunity_alert")
    messages = F.col("user_id") % 5
    pushes = event_stream(spark, sf_dir).select(kind.alias("kind"), messages.alias("messages"), F.least(messages, F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("failed"), F.col("ts").alias("at")).where("kind is not null")
    path = shared_folder(spark)
    return streaming.count_pushes(pushes, f"{path}/counters", f"{path}/log")


@query("""SELECT connection_id, id FROM scored JOIN pushes ON (regions IS NULL OR list_contains(regions, region)) AND (industries IS NULL OR list_contains(industries, industry))
AND (budget_amount IS NULL OR ((low IS NULL OR budget_amount >= low) AND (high IS NULL OR budget_amount <= high))) AND (least_score IS NULL OR total_score >= least_score)""", PUSHED)
def r1_stream_pushes(spark, sf_dir):
    """Scored notices as a stream against the subscriptions."""
    path = shared_folder(spark)
    scoring.scored(bids(spark, sf_dir), AS_OF, profile=PROFILE, **WORDS).select("id", "region", "industry", "budget_amount", "total_score").write.parquet(path)
    stream = streaming.table_stream(spark, path, spark.read.parquet(path))
    return streaming.drained(streaming.pushed(stream, spark.createDataFrame(list(PUSHES), PUSH_SCHEMA)).select("connection_id", "id"))


@query("""SELECT strftime(publish_date, '%Y-%m') AS month, count(*) AS "count" FROM bids WHERE strftime(publish_date, '%Y-%m') BETWEEN '1998-03' AND '1998-09' GROUP BY 1""")
def s18_partitioned_months(spark, sf_dir):
    """Written by month and read back for a range of months, by whose partitions the rest is pruned."""
    path = shared_folder(spark)
    sinks.write_months(bids(spark, sf_dir).select("id", "publish_date", "budget_amount"), path)
    return sinks.read_months(spark, path, "1998-03", "1998-09").groupBy(F.col("publish_month").cast("string").alias("month")).agg(stats.n())


CSV_COLUMNS = ("id", "title", "notice_type", "tenderer", "budget_amount", "region", "industry", "status", "publish_date", "source_url")


@query("""SELECT id, title, notice_type, tenderer, CAST(budget_amount AS VARCHAR) AS budget_amount, region, nullif(industry, '') AS industry, status, strftime(publish_date, '%Y-%m-%d') AS publish_date, source_url FROM bids""")
def s14_csv_export(spark, sf_dir):
    """Ten columns of every notice, written as CSV and read back; blanks come back as null."""
    path = shared_folder(spark)
    sinks.export_csv(bids(spark, sf_dir).withColumn("publish_date", F.date_format("publish_date", "yyyy-MM-dd")), path, list(CSV_COLUMNS))
    return spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} {'bigint' if c == 'id' else 'string'}" for c in CSV_COLUMNS)).csv(path)


@query("""SELECT id, title, status, region FROM bids""")
def s13_json_export(spark, sf_dir):
    path = shared_folder(spark)
    sinks.export_json(bids(spark, sf_dir).select("id", "title", "status", "region"), path)
    return spark.read.schema("id bigint, title string, status string, region string").json(path)


@query("""SELECT id, title, tenderer, CAST(budget_amount AS VARCHAR) AS budget_amount FROM bids""")
def s14_csv_export_all(spark, sf_dir):
    path = shared_folder(spark)
    sinks.export_csv(bids(spark, sf_dir), path, ["id", "title", "tenderer", "budget_amount"])
    return spark.read.option("header", True).option("escape", '"').schema("id bigint, title string, tenderer string, budget_amount string").csv(path)


@query("""SELECT id, title, status FROM bids""")
def s13_json_export_all(spark, sf_dir):
    path = shared_folder(spark)
    sinks.export_json(bids(spark, sf_dir).select("id", "title", "status"), path)
    return spark.read.schema("id bigint, title string, status string").json(path)


@query()
def j7_known_titles(spark, sf_dir):
    """Titles of all new notices against those that their own site stored from 30 days before on; checked against all pairs in the tests."""
    news, stored = news_and_stored(spark, sf_dir)
    return similarity.known_titles(news, stored, site="source_site", time="created_at")


@query()
def k20_name_clusters(spark, sf_dir):
    """All tenderers and winners of the notices by their normal forms; checked against plain clusters in the tests."""
    tenderers = bids(spark, sf_dir).select(F.col("tenderer").alias("name"), F.col("id").alias("k"))
    winners = wins(spark, sf_dir).select(F.col("winner").alias("name"), F.col("id").alias("k"))
    names = tenderers.union(winners).where("trim(name) != ''").groupBy("name").agg(F.min("k").alias("k"))
    return similarity.cluster_names(names.withColumn("normal", cleaning.organisation(F.col("name"))), "normal", "name", "k")


@query("""SELECT DISTINCT name, cluster, canonical, CASE WHEN cluster IS NOT NULL THEN 1.0::DOUBLE END AS confidence, method FROM (
SELECT tenderer AS name, min(tenderer) OVER (PARTITION BY regexp_replace(tenderer, '[^a-zA-Z0-9]', '', 'g')) AS canonical, regexp_replace(tenderer, '[^a-zA-Z0-9]', '', 'g') AS cluster, 'exact' AS method FROM bids WHERE trim(tenderer) <> ''
UNION ALL SELECT tenderer || ' (branch)', min(tenderer) OVER (PARTITION BY regexp_replace(tenderer, '[^a-zA-Z0-9]', '', 'g')), regexp_replace(tenderer, '[^a-zA-Z0-9]', '', 'g'), 'similarity' FROM bids WHERE trim(tenderer) <> ''
UNION ALL SELECT winner, NULL, NULL, NULL FROM wins WHERE trim(winner) <> '')""")
def j9_resolved_names(spark, sf_dir):
    """All winners, tenderers and tenderers' branches against the clusters that the tenderers' normal forms make; similar forms are checked against all pairs in the tests."""
    tenderers = bids(spark, sf_dir).where("trim(tenderer) != ''").select(F.col("tenderer").alias("v"), cleaning.organisation(F.col("tenderer")).alias("cluster"))
    clusters = tenderers.groupBy("cluster").agg(F.min("v").alias("canonical"), F.collect_set("v").alias("variants"))
    winners = wins(spark, sf_dir).where("trim(winner) != ''").select(F.col("winner").alias("name"))
    names = winners.union(tenderers.select("v")).union(tenderers.select(F.concat("v", F.lit(" (branch)"))))
    return similarity.resolved(names, clusters, cleaning.organisation)
