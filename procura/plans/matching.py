"""Queries: subscriptions, pushes, duplicates and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, predicates, scoring, stats, tables
from ..sources import store
from ..sources.notices import AS_OF, bids
from .opportunities import PROFILE, SCORED, WORDS
from .registry import query

#: subscription_id, value, match_type, case_sensitive, is_required, weight.
KEYWORDS = (
    ("s1", "building", "contains", False, False, 1.0), ("s1", "nation_1", "contains", False, False, 2.0), ("s1", "urgent", "contains", False, False, 0.5),
    ("s2", "1-URGENT", "starts_with", True, True, 3.0), ("s2", "nation_7", "contains", False, False, 1.5),
    ("s3", "Nation_12", "ends_with", False, True, 2.0), ("s3", "machinery", "contains", False, True, 1.0),
    ("s4", "^[1-3]-.*(nation_3|nation_4)$", "regex", False, False, 12.0), ("s5", "1-URGENT supply for BUILDING in NATION_5", "exact", True, False, 5.0), ("s5", "NATION_5", "contains", True, False, 1.0),
)
KEYWORD_SCHEMA = "subscription_id string, value string, match_type string, case_sensitive boolean, is_required boolean, weight double"

MATCHES = "keywords(subscription_id, value, match_type, case_sensitive, is_required, weight) AS (VALUES " + ", ".join(f"('{s}', '{v}', '{m}', {c}, {r}, {w})" for s, v, m, c, r, w in KEYWORDS) + """),
pairs AS (SELECT b.id, k.* FROM (SELECT id, title AS text FROM bids) b JOIN keywords k ON CASE match_type
  WHEN 'exact' THEN CASE WHEN case_sensitive THEN text = value ELSE lower(text) = lower(value) END
  WHEN 'contains' THEN CASE WHEN case_sensitive THEN contains(text, value) ELSE contains(lower(text), lower(value)) END
  WHEN 'starts_with' THEN CASE WHEN case_sensitive THEN starts_with(text, value) ELSE starts_with(lower(text), lower(value)) END
  WHEN 'ends_with' THEN CASE WHEN case_sensitive THEN ends_with(text, value) ELSE ends_with(lower(text), lower(value)) END
  ELSE regexp_matches(text, CASE WHEN case_sensitive THEN '' ELSE '(?i)' END || value) END),
needs AS (SELECT subscription_id, count(DISTINCT value) FILTER (is_required) AS needed FROM keywords GROUP BY 1),
found AS (SELECT id, subscription_id, count(*) AS matched, CAST(sum(weight * 10) AS DOUBLE) AS raw, count(DISTINCT p.value) FILTER (p.value IN (SELECT value FROM keywords q WHERE q.subscription_id = p.subscription_id AND q.is_required)) AS have, count(*) FILTER (NOT is_required) AS optional FROM pairs p GROUP BY 1, 2),
judged AS (SELECT id, subscription_id, matched, least(raw + CASE WHEN matched > 1 THEN least(matched * 2, 20) ELSE 0 END, 100.0) AS score, CASE WHEN needed > 0 THEN have = needed ELSE optional > 0 END AS is_match, have = needed AS complete FROM found JOIN needs USING (subscription_id)),
matches AS (SELECT id, subscription_id, matched, score, is_match, round(CASE WHEN is_match THEN least(score / 200 + CASE WHEN complete THEN 0.3 ELSE 0 END + least(matched * 0.05, 0.2), 1.0) ELSE 0 END, 6) AS confidence FROM judged)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = spark.createDataFrame(list(KEYWORDS), KEYWORD_SCHEMA)
    return matching.evaluate(bids(spark, sf_dir).select("id", F.col("title").alias("text")), keywords)


@query("SELECT * FROM matches", MATCHES)
def k21_match_scores(spark, sf_dir):
    """J2, J3, T12, K21 and K22."""
    return matches(spark, sf_dir)


@query("""SELECT subscription_id, count(*) AS total, CAST(sum(CAST(score AS DECIMAL(12,4))) AS DOUBLE) / count(*) AS average, max(score) AS best, min(score) AS least, count(*) FILTER (is_match) AS matched FROM matches GROUP BY 1""", MATCHES)
def a35_match_statistics(spark, sf_dir):
    mean = F.sum(F.col("score").cast("decimal(12,4)")).cast("double") / F.count(F.lit(1))
    return matches(spark, sf_dir).groupBy("subscription_id").agg(stats.n(name="total"), mean.alias("average"), F.max("score").alias("best"), F.min("score").alias("least"), stats.n(F.col("is_match"), "matched"))


USERS = ("ann", "bo", "ann", "cy", "bo")
JOINED = MATCHES + ",\nusers(subscription_id, username) AS (VALUES " + ", ".join(f"('s{i}', '{u}')" for i, u in enumerate(USERS, 1)) + ")"


@query("""SELECT username, subscription_id, id, title, region, score FROM matches JOIN users USING (subscription_id) JOIN bids USING (id) WHERE is_match""", JOINED)
def j1_user_matches(spark, sf_dir):
    """Match results with their subscriptions' users and their notices."""
    users = spark.createDataFrame([(f"s{i}", u) for i, u in enumerate(USERS, 1)], "subscription_id string, username string")
    found = matches(spark, sf_dir).where("is_match").join(users, "subscription_id")
    return found.join(bids(spark, sf_dir).select("id", "title", "region"), "id").select("username", "subscription_id", "id", "title", "region", "score")


@query("""SELECT 'subscriptions' AS rule, region AS key, count(DISTINCT tenderer) AS found FROM bids GROUP BY 2 HAVING count(DISTINCT tenderer) > 10
UNION ALL SELECT 'keywords', tenderer, count(DISTINCT title) FROM bids GROUP BY 2 HAVING count(DISTINCT title) > 50
UNION ALL SELECT 'length', tenderer, max(length(repeat(title, CASE WHEN id % 100 = 0 THEN 10 ELSE 1 END))) FROM bids GROUP BY 2 HAVING max(length(repeat(title, CASE WHEN id % 100 = 0 THEN 10 ELSE 1 END))) > 200""")
def v4_subscription_limits(spark, sf_dir):
    """Users with too many subscriptions, subscriptions with too many keywords or too long ones; tenderers stand for subscriptions."""
    rows = bids(spark, sf_dir).select(F.col("region").alias("username"), F.col("tenderer").alias("subscription_id"), F.col("title").alias("value"), F.when(F.col("id") % 100 == 0, 10).otherwise(1).alias("times"))
    short = matching.over_limits(rows)
    long = matching.over_limits(rows.withColumn("value", F.expr("repeat(value, times)")))
    return short.where("rule != 'length'").unionByName(long.where("rule = 'length'"))


#: connection, regions, industries, low, high, least score: null admits all.
PUSHES = (("c1", ("ASIA",), None, None, 5_000_000.0, None), ("c2", None, ("BUILDING", "MACHINERY"), 1_000_000.0, None, 52.0), ("c3", ("EUROPE", "AFRICA"), ("FURNITURE",), None, None, None), ("c4", None, None, None, None, 60.0))
PUSH_SCHEMA = "connection_id string, regions array<string>, industries array<string>, low double, high double, least_score double"


def listed(values) -> str:
    return "NULL" if values is None else "[" + ", ".join(map(repr, values)) + "]"


PUSHED = SCORED + ",\npushes(connection_id, regions, industries, low, high, least_score) AS (VALUES " + ", ".join(f"('{c}', CAST({listed(r)} AS VARCHAR[]), CAST({listed(i)} AS VARCHAR[]), CAST({lo or 'NULL'} AS DOUBLE), CAST({hi or 'NULL'} AS DOUBLE), CAST({s or 'NULL'} AS DOUBLE))" for c, r, i, lo, hi, s in PUSHES) + ")"


def pushed(notices: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each notice with the connections whose filters it passes. subscriptions is a table of known size."""
    c = F.col
    wanted = predicates.push(c("regions"), c("industries"), c("low"), c("high"), c("least_score"), c("total_score"))
    return notices.join(F.broadcast(subscriptions), wanted)


@query("""SELECT connection_id, id FROM scored JOIN pushes ON (regions IS NULL OR list_contains(regions, region)) AND (industries IS NULL OR list_contains(industries, industry))
AND (budget_amount IS NULL OR ((low IS NULL OR budget_amount >= low) AND (high IS NULL OR budget_amount <= high))) AND (least_score IS NULL OR total_score >= least_score)""", PUSHED)
def f11_push_filter(spark, sf_dir):
    scored = scoring.scored(bids(spark, sf_dir), AS_OF, profile=PROFILE, **WORDS)
    return pushed(scored, spark.createDataFrame(list(PUSHES), PUSH_SCHEMA)).select("connection_id", "id")


@query("""SELECT connection_id, count(*) AS alerts, max(total_score) AS best FROM scored JOIN pushes ON total_score >= coalesce(least_score, 58) GROUP BY 1""", PUSHED)
def j5_score_alerts(spark, sf_dir):
    """Scores against the least score of a subscriber."""
    scored = scoring.scored(bids(spark, sf_dir), AS_OF, profile=PROFILE, **WORDS).select("total_score")
    subscriptions = spark.createDataFrame(list(PUSHES), PUSH_SCHEMA).select("connection_id", "least_score")
    return scored.join(F.broadcast(subscriptions), F.col("total_score") >= F.coalesce("least_score", F.lit(58.0))).groupBy("connection_id").agg(stats.n(name="alerts"), F.max("total_score").alias("best"))


KNOWN = """stored AS (SELECT * FROM bids WHERE id % 2 = 0), news AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'https://notices.example.org/' || CAST(id * 2 AS VARCHAR) ELSE source_url || '/new' END AS source_url, title, source_site FROM bids WHERE id % 2 = 1),
known AS (SELECT id, CASE WHEN source_url IN (SELECT source_url FROM stored) THEN 'url' WHEN (title, source_site) IN (SELECT (title, source_site) FROM stored) THEN 'title_site' END AS reason FROM news)"""


def news_and_stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, k = bids(spark, sf_dir), F.col("id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://notices.example.org/"), (k * 2).cast("string"))).otherwise(F.concat("source_url", F.lit("/new")))
    return rows.where(k % 2 == 1).withColumn("source_url", url), rows.where(k % 2 == 0)


@query("SELECT * FROM known", KNOWN)
def j6_known_notices(spark, sf_dir):
    news, stored = news_and_stored(spark, sf_dir)
    return tables.known(news, stored).select("id", "reason")


@query("""SELECT coalesce(reason, 'new') AS reason, count(*) AS "count" FROM known GROUP BY 1""", KNOWN)
def a36_duplicate_statistics(spark, sf_dir):
    news, stored = news_and_stored(spark, sf_dir)
    return tables.known(news, stored).groupBy(F.coalesce("reason", F.lit("new")).alias("reason")).agg(stats.n())


UPSERT = """stored AS (SELECT id, title, status FROM bids WHERE id % 4 <> 0), news AS (SELECT id // 10 * 8 AS id, title || '!' AS title, 'closed' AS status, id AS place FROM bids)"""


def upsert_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = bids(spark, sf_dir)
    news = rows.select((F.floor(F.col("id") / 10) * 8).alias("id"), F.concat("title", F.lit("!")).alias("title"), F.lit("closed").alias("status"), F.col("id").alias("place"))
    return rows.where("id % 4 != 0").select("id", "title", "status"), news


@query("""SELECT * FROM stored WHERE id NOT IN (SELECT id FROM news) UNION ALL SELECT id, title, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place DESC) AS r FROM news) WHERE r = 1""", UPSERT)
def s11_upsert(spark, sf_dir):
    stored, news = upsert_parts(spark, sf_dir)
    return tables.upsert(stored.withColumn("place", F.lit(None).cast("bigint")), news, ["id"], [F.desc("place")]).drop("place")


@query("""SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place DESC) AS r FROM news) WHERE r = 1 AND id NOT IN (SELECT id FROM stored)""", UPSERT)
def s12_insert_new(spark, sf_dir):
    stored, news = upsert_parts(spark, sf_dir)
    return tables.insert_new(stored, news, "id", [F.desc("place")]).select("id", "title")


UPSERT_ALL = """stored AS (SELECT id, title, status FROM bids WHERE id % 4 <> 0), news AS (SELECT id - id % 3 AS id, title || '!' AS title, 'closed' AS status, id AS place FROM bids)"""


def upsert_all_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every notice is news of one of a third as many keys, which grow with the table."""
    rows, k = bids(spark, sf_dir), F.col("id")
    news = rows.select((k - k % 3).alias("id"), F.concat("title", F.lit("!")).alias("title"), F.lit("closed").alias("status"), k.alias("place"))
    return rows.where("id % 4 != 0").select("id", "title", "status"), news


@query("""SELECT * FROM stored WHERE id NOT IN (SELECT id FROM news) UNION ALL SELECT id, title, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place DESC) AS r FROM news) WHERE r = 1""", UPSERT_ALL)
def s11_upsert_all(spark, sf_dir):
    stored, news = upsert_all_parts(spark, sf_dir)
    return tables.upsert(stored.withColumn("place", F.lit(None).cast("bigint")), news, ["id"], [F.desc("place")]).drop("place")


@query("""SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place DESC) AS r FROM news) WHERE r = 1 AND id NOT IN (SELECT id FROM stored)""", UPSERT_ALL)
def s12_insert_new_all(spark, sf_dir):
    stored, news = upsert_all_parts(spark, sf_dir)
    return tables.insert_new(stored, news, "id", [F.desc("place")]).select("id", "title")


@query("""SELECT o_orderkey AS id, l_partkey AS item, 0 AS sort_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, o_orderkey * 10 + i, i FROM orders, (SELECT unnest(range(3)) AS i) WHERE o_orderkey % 5 = 0""")
def s21_replace_children(spark, sf_dir):
    """Items of touched notices are replaced by new ones, numbered by place."""
    parents = bids(spark, sf_dir).select("id")
    children = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.lit(0).cast("int").alias("sort_order"), F.col("l_partkey").alias("item")).join(parents, "id", "left_semi")
    news = parents.where("id % 5 = 0").withColumn("items", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("id") * 10 + i))
    return tables.replace_children(parents, children, news, "id", "items")


@query("""SELECT id, title, status FROM stored WHERE id NOT IN (SELECT id FROM news) UNION ALL SELECT id, title, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place DESC) AS r FROM news) WHERE r = 1""", UPSERT)
def s11_store_upsert(spark, sf_dir):
    """S11 as a store: only buckets with news are written again."""
    stored, news = upsert_parts(spark, sf_dir)
    path = tables.shared_folder(spark)
    store.create(stored, path, "id")
    last = tables.latest(news, ["id"], [F.desc("place")]).select("id", "title", "status")
    store.merge(spark, path, last, last, ["id"], "id")
    return store.read(spark, path).drop("bucket")


@query("""SELECT o_orderkey AS id, l_partkey AS item, 0 AS sort_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, o_orderkey * 10 + i, i FROM orders, (SELECT unnest(range(3)) AS i) WHERE o_orderkey % 5 = 0""")
def s21_store_children(spark, sf_dir):
    """S21 as a store: items lie in the buckets of their notices, and those of touched notices are replaced in place."""
    parents = bids(spark, sf_dir).select("id")
    children = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.lit(0).cast("int").alias("sort_order"), F.col("l_partkey").alias("item")).join(parents, "id", "left_semi")
    path = tables.shared_folder(spark)
    store.create(children, path, "id")
    touched = parents.where("id % 5 = 0")
    news = touched.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("id") * 10 + i)).alias("sort_order", "item"))
    store.merge(spark, path, touched, news, ["id"], "id")
    return store.read(spark, path).drop("bucket")


@query("""SELECT id, title FROM bids WHERE source_site = 'site3' AND status = 'active' ORDER BY publish_date DESC, id LIMIT 30""")
def s3_batch_scan(spark, sf_dir):
    return bids(spark, sf_dir).where("source_site = 'site3' and status = 'active'").orderBy(F.desc("publish_date"), "id").limit(30).select("id", "title")


#: role, what it may do, and the role whose rights it also has.
ROLES = (("viewer", ("read",), None), ("user", ("write", "export"), "viewer"), ("manager", ("approve", "assign"), "user"), ("admin", ("all",), "manager"))


@query("""SELECT c_custkey AS user_id, t.role, array_to_string(list_sort(rights), ',') AS rights FROM customer JOIN (VALUES (0, 'viewer', ['read']), (1, 'user', ['write', 'export', 'read']), (2, 'manager', ['approve', 'assign', 'write', 'export', 'read']), (3, 'admin', ['all', 'approve', 'assign', 'write', 'export', 'read'])) AS t(k, role, rights) ON c_custkey % 4 = k""")
def u4_role_rights(spark, sf_dir):
    """U4: what every customer, as a user, may do by their role and the roles below it; the table of roles has a handful of rows."""
    roles = spark.createDataFrame([(k, r, list(p), up) for k, (r, p, up) in enumerate(ROLES)], "k long, role string, rights array<string>, parent string")
    for _ in range(len(ROLES) - 1):
        up = roles.select(F.col("role").alias("parent"), F.col("rights").alias("more"), F.col("parent").alias("above"))
        roles = roles.join(up, "parent", "left").select("k", "role", F.array_union("rights", F.coalesce("more", F.array().cast("array<string>"))).alias("rights"), F.col("above").alias("parent"))
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4).alias("k"))
    return users.join(F.broadcast(roles), "k").select("user_id", "role", F.array_join(F.array_sort("rights"), ",").alias("rights"))
