"""Queries: opportunity scores, rule-based classes and keyword dictionaries, with word lists that fit the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, insights, paging, scoring, stats
from ..sources.notices import AS_OF, bids, wins
from .registry import query

WORDS = {"contested": ("00001", "00007"), "sheltered": ("00002",), "premium": ("00003",), "government": ("00004", "00005"), "institution": ("00006",), "profile_words": {"construction": ("building", "furniture")}}
PROFILE = {"industries": ("construction",), "regions": ("000001", "000002")}


def words_sql(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def steps_sql(value: str, table: tuple, otherwise: float) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {low} THEN {score}" for low, score in table) + f" ELSE {otherwise} END"


SCORED = f"""factors AS (SELECT *,
  CASE WHEN budget_amount IS NULL OR budget_amount <= 0 THEN 0.0 ELSE {steps_sql('budget_amount', scoring.AMOUNT_STEPS, 5.0)} END AS amount_score,
  greatest(least(15.0 - CASE WHEN {words_sql('tenderer', WORDS['contested'])} THEN 5 ELSE 0 END + CASE WHEN {words_sql('tenderer', WORDS['sheltered'])} THEN 5 ELSE 0 END, 25), 0) AS competition_score,
  CASE WHEN deadline_date IS NULL THEN 10.0 WHEN deadline_date < :as_of THEN 0.0 ELSE {steps_sql('floor((epoch(deadline_date) - epoch(:as_of)) / 86400)', scoring.DAY_STEPS, 2.0)} END AS timeline_score,
  least(7.5 + CASE WHEN {words_sql('lower(title)', WORDS['profile_words']['construction'])} THEN 5 ELSE 0 END + CASE WHEN {words_sql('tenderer', PROFILE['regions'])} THEN 2.5 ELSE 0 END, 15) AS relevance_score,
  CASE WHEN {words_sql('tenderer', WORDS['premium'])} THEN 12.0 WHEN {words_sql('tenderer', WORDS['government'])} THEN 10.0 WHEN {words_sql('tenderer', WORDS['institution'])} THEN 9.0 ELSE 7.5 END AS history_score
  FROM bids),
scored AS (SELECT *, CAST(amount_score + competition_score + timeline_score + relevance_score + history_score AS DOUBLE) AS total_score FROM factors),
levelled AS (SELECT *, CASE WHEN total_score >= 80 THEN 'high' WHEN total_score >= 50 THEN 'medium' ELSE 'low' END AS score_level FROM scored)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(bids(spark, sf_dir), AS_OF, profile=PROFILE, **WORDS)


FACTORS = ("amount_score", "competition_score", "timeline_score", "relevance_score", "history_score", "total_score")


@query("SELECT id, " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FACTORS) + ", score_level FROM levelled", SCORED)
def k6_scores(spark, sf_dir):
    """K1-K6: five factors, their total and its level."""
    return scored(spark, sf_dir).select("id", *FACTORS, "score_level")


NOTES = """SELECT id, total_score,
  coalesce(nullif(concat_ws('|', CASE WHEN amount_score >= 20 THEN 'large amount' END, CASE WHEN timeline_score >= 15 THEN 'ample time' END, CASE WHEN competition_score >= 15 THEN 'little competition' END), ''), 'meets the basics') AS reasons,
  coalesce(nullif(concat_ws('|', CASE WHEN timeline_score < 10 THEN 'deadline is near' END, CASE WHEN budget_amount > 10000000 THEN 'form a dedicated team' END, CASE WHEN competition_score < 10 THEN 'study competitors' END), ''), 'prepare as usual') AS actions,
  row_number() OVER (ORDER BY total_score DESC, id) AS priority
FROM scored ORDER BY total_score DESC, id LIMIT 15"""


@query(NOTES, SCORED)
def k7_recommendations(spark, sf_dir):
    return scoring.recommendations(scored(spark, sf_dir), 15)


@query("""SELECT id, total_score FROM scored WHERE total_score >= 55 ORDER BY total_score DESC, id LIMIT 20 OFFSET 20""", SCORED)
def k8_score_page(spark, sf_dir):
    rows = scored(spark, sf_dir).where("total_score >= 55").select("id", "total_score")
    return paging.slice_page(rows, [F.desc("total_score"), F.col("id")], 2, 20)


@query("""SELECT score_level, count(*) AS "count", max(total_score) AS best, CAST(sum(CAST(total_score AS DECIMAL(10,2))) AS DOUBLE) / count(*) AS average FROM levelled GROUP BY 1""", SCORED)
def a39_level_counts(spark, sf_dir):
    mean = F.sum(F.col("total_score").cast("decimal(10,2)")).cast("double") / F.count(F.lit(1))
    return scored(spark, sf_dir).groupBy("score_level").agg(stats.n(), F.max("total_score").alias("best"), mean.alias("average"))


ATTRACTIVE = """attractive AS (SELECT *, round(
  0.4 * CASE WHEN budget_amount <> 0 THEN least(100.0, CAST(budget_amount AS DOUBLE) / 1000000 * 20) ELSE 0 END
  + 0.2 * CASE WHEN deadline_date IS NULL THEN 50.0 WHEN date_diff('day', CAST(:as_of AS DATE), CAST(deadline_date AS DATE)) < 0 THEN 0.0 WHEN date_diff('day', CAST(:as_of AS DATE), CAST(deadline_date AS DATE)) < 7 THEN 30.0 WHEN date_diff('day', CAST(:as_of AS DATE), CAST(deadline_date AS DATE)) < 30 THEN 70.0 ELSE 100.0 END
  + 0.2 * CASE industry_code """ + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in scoring.INDUSTRY_SCORES.items()) + """ ELSE 50.0 END
  + 0.2 * CASE WHEN budget_amount IS NULL OR budget_amount = 0 THEN 50.0 WHEN budget_amount > 10000000 THEN 30.0 WHEN budget_amount > 5000000 THEN 50.0 WHEN budget_amount > 1000000 THEN 70.0 ELSE 90.0 END, 2) AS score FROM {source})"""


@query("""SELECT id, round(score, 1) AS score FROM attractive""", ATTRACTIVE.replace("{source}", "bids"))
def k9_attractiveness(spark, sf_dir):
    c = F.col
    score = scoring.attractiveness(c("budget_amount"), c("deadline_date"), c("industry_code"), AS_OF)
    return bids(spark, sf_dir).select("id", F.round(score, 1).alias("score"))


@query("""SELECT id, round(score, 1) AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS recommendation FROM attractive""",
       """largest AS (SELECT * FROM bids WHERE notice_type = 'bidding' AND status IN ('pending', 'active') AND budget_amount >= 2000000 ORDER BY budget_amount DESC NULLS FIRST, id LIMIT 60),
""" + ATTRACTIVE.replace("{source}", "largest"))
def k10_opportunities(spark, sf_dir):
    """The largest budgets first, then by score."""
    return scoring.opportunities(bids(spark, sf_dir), AS_OF, 2_000_000, 60).select("id", F.round("score", 1).alias("score"), "recommendation")


@query("""SELECT (SELECT count(*) FROM attractive) AS new_opportunities, coalesce((SELECT CAST(coalesce(budget_amount, 0) AS DOUBLE) FROM largest WHERE id = (SELECT id FROM attractive ORDER BY score DESC, id LIMIT 1)), 0) AS top_value,
(SELECT winner FROM wins WHERE winner <> '' GROUP BY 1 ORDER BY count(*) DESC, winner LIMIT 1) AS top_competitor,
(SELECT CASE WHEN count(*) < 2 THEN 'stable' WHEN arg_max(total, month) > arg_min(total, month) THEN 'up' ELSE 'down' END FROM (SELECT strftime(publish_date, '%Y-%m') AS month, sum(budget_amount) AS total FROM recent WHERE budget_amount IS NOT NULL GROUP BY 1)) AS market_trend,
coalesce((SELECT key FROM (SELECT coalesce(nullif(industry, ''), nullif(industry_code, ''), 'Unknown') AS key, coalesce(sum(budget_amount), 0) AS s FROM recent GROUP BY 1) ORDER BY s DESC, key LIMIT 1), 'N/A') AS hot_industry""",
       """recent AS (SELECT * FROM bids WHERE publish_date >= :as_of - INTERVAL 90 DAY),
largest AS (SELECT * FROM bids WHERE publish_date >= :as_of - INTERVAL 7 DAY AND notice_type = 'bidding' AND status IN ('pending', 'active') ORDER BY budget_amount DESC NULLS FIRST, id LIMIT 5),
""" + ATTRACTIVE.replace("{source}", "largest"))
def a31_quick_insights(spark, sf_dir):
    """Opportunities of the week, the first winner, the direction of amounts and the first industry."""
    return insights.quick(bids(spark, sf_dir), wins(spark, sf_dir), AS_OF)


@query("""SELECT b.id, CASE WHEN b.budget_amount IS NOT NULL THEN round(CAST(b.budget_amount AS DOUBLE) / s, 4) END AS to_average, r AS recent FROM bids b
JOIN (SELECT industry, CAST(sum(budget_amount) AS DOUBLE) / count(budget_amount) AS s, count(*) FILTER (publish_date >= :as_of - INTERVAL 90 DAY) AS r FROM bids GROUP BY 1) i USING (industry)""")
def j10_industry_context(spark, sf_dir):
    """Each notice against its industry: amount over the mean, notices of the last 90 days. Industries are few, so their sums are joined."""
    rows = bids(spark, sf_dir)
    since = F.timestamp_add("DAY", F.lit(-90), F.to_timestamp(F.lit(AS_OF)))
    mean = F.sum("budget_amount").cast("double") / F.count("budget_amount")
    context = rows.groupBy("industry").agg(mean.alias("mean"), stats.n(F.col("publish_date") >= since, "recent"))
    return rows.join(context, "industry").select("id", F.round(F.col("budget_amount").cast("double") / F.col("mean"), 4).alias("to_average"), "recent")


#: Word lists for the names in the test tables.
SUFFIXES = (("Customer#", ""),)
KINDS = {"state": ("00001",), "public": ("00002", "00003"), "private": ("00004",)}
ZONES = {"East": ("CHINA", "JAPAN", "INDIA", "UNITED"), "West": ("FRANCE", "GERMANY", "CANADA")}
ENDINGS = (" STATES", " KINGDOM")
INDUSTRIES = (("BUILD", "construction"), ("MACH", "engineering"), ("AUTO", "engineering"))

CLASSES = """classes AS (SELECT id,
  CASE WHEN tenderer = '' OR tenderer IS NULL THEN '未知' WHEN contains(t, '00001') THEN 'state' WHEN contains(t, '00002') OR contains(t, '00003') THEN 'public' WHEN contains(t, '00004') THEN 'private' ELSE '其他企业' END AS tenderer_kind,
  CASE WHEN regexp_matches(t, '0000[1-4]') THEN 0.9 ELSE 0.6 END AS tenderer_confidence,
  CASE WHEN r IN ('CHINA', 'JAPAN', 'INDIA', 'UNITED') THEN 'East' WHEN r IN ('FRANCE', 'GERMANY', 'CANADA') THEN 'West' ELSE '未知' END AS zone,
  CASE WHEN region_name = '' THEN 0.0 WHEN r IN ('CHINA', 'JAPAN', 'INDIA', 'UNITED', 'FRANCE', 'GERMANY', 'CANADA') THEN 0.98 ELSE 0.3 END AS zone_confidence,
  CASE WHEN contains(industry, 'BUILD') THEN 'construction' WHEN contains(industry, 'MACH') OR contains(industry, 'AUTO') THEN 'engineering' ELSE '未知' END AS industry_class,
  CASE WHEN industry = '' THEN 0.0 WHEN regexp_matches(industry, 'BUILD|MACH|AUTO') THEN 0.85 ELSE 0.3 END AS industry_confidence,
  CASE WHEN budget_amount IS NULL THEN '未知' WHEN budget_amount >= 10000000 THEN '超大额 (>=1000万)' WHEN budget_amount >= 1000000 THEN '大额 (100-1000万)' WHEN budget_amount >= 100000 THEN '中额 (10-100万)' ELSE '小额 (<10万)' END AS amount_class
  FROM (SELECT *, trim(replace(tenderer, 'Customer#', '')) AS t, trim(replace(replace(region_name, ' STATES', ''), ' KINGDOM', '')) AS r FROM bids))"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    t, r, i = classify.tenderer(c("tenderer"), KINDS, SUFFIXES), classify.region(c("region_name"), ZONES, ENDINGS), classify.industry(c("industry"), INDUSTRIES)
    return bids(spark, sf_dir).select("id", t["category"].alias("tenderer_kind"), t["confidence"].cast("double").alias("tenderer_confidence"), r["category"].alias("zone"), r["confidence"].cast("double").alias("zone_confidence"), i["category"].alias("industry_class"), i["confidence"].cast("double").alias("industry_confidence"), classify.amount(c("budget_amount")).alias("amount_class"))


@query("""SELECT * REPLACE (CAST(tenderer_confidence AS DOUBLE) AS tenderer_confidence, CAST(zone_confidence AS DOUBLE) AS zone_confidence, CAST(industry_confidence AS DOUBLE) AS industry_confidence) FROM classes""", CLASSES)
def k15_classes(spark, sf_dir):
    """K11-K15."""
    return classified(spark, sf_dir)


@query("""SELECT 'zone' AS kind, zone AS key, count(*) AS "count" FROM classes GROUP BY 2 UNION ALL SELECT 'industry', industry_class, count(*) FROM classes GROUP BY 2
UNION ALL SELECT 'amount', amount_class, count(*) FROM classes GROUP BY 2 UNION ALL SELECT 'tenderer', tenderer_kind, count(*) FROM classes GROUP BY 2""", CLASSES)
def a38_class_summary(spark, sf_dir):
    pairs = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("zone", "zone"), ("industry", "industry_class"), ("amount", "amount_class"), ("tenderer", "tenderer_kind")))))
    return classified(spark, sf_dir).select(pairs).groupBy("kind", "key").agg(stats.n())


#: (industry, code, weight, place, keywords); a keyword that is listed twice counts twice.
DICTIONARY = (("construction", "E47", 1.0, 1, ("building", "furniture", "building")), ("transport", "G53", 0.9, 2, ("automobile", "urgent")), ("production", "C17", 1.1, 3, ("machinery", "household")), ("east", "X01", 0.8, 4, ("china", "japan", "india")), ("supply", "F51", 0.2, 5, ("supply",)))

KEYWORDS = "dictionary(industry, code, weight, place, keywords) AS (VALUES " + ", ".join(f"('{i}', '{c}', {w}, {p}, [{', '.join(map(repr, k))}])" for i, c, w, p, k in DICTIONARY) + """),
hits AS (SELECT id, industry, code, weight, place, k AS word, i AS spot, (length(lower(title)) - length(replace(lower(title), k, ''))) // length(k) AS times
  FROM (SELECT id, title FROM bids) CROSS JOIN (SELECT *, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS i FROM dictionary)),
sums AS (SELECT id, industry, code, place, CAST(sum(times * (1.0 + length(word) / 10.0) * weight) AS DOUBLE) AS score, count(*) AS n, string_agg(word, ',' ORDER BY spot) AS words FROM hits WHERE times > 0 GROUP BY 1, 2, 3, 4),
graded AS (SELECT *, least(least(score / 3.5, 0.82) + CASE WHEN n >= 4 THEN 0.15 WHEN n >= 3 THEN 0.1 WHEN n >= 2 THEN 0.05 ELSE 0 END + CASE WHEN score >= 2.5 THEN 0.03 ELSE 0 END, 1.0) AS confidence FROM sums),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS rank FROM graded),
told AS (SELECT id, max(industry) FILTER (rank = 1) AS industry, max(code) FILTER (rank = 1) AS code, max(confidence) FILTER (rank = 1) AS confidence, max(words) FILTER (rank = 1) AS keywords,
  coalesce(array_to_string(list_slice(list(industry ORDER BY rank) FILTER (rank > 1 AND confidence > 0.3), 1, 3), ','), '') AS secondary FROM placed GROUP BY 1)"""


@query("""SELECT id, CASE WHEN confidence > 0.5 THEN industry END AS industry, CASE WHEN confidence > 0.5 THEN code END AS industry_code, round(CAST(confidence AS DOUBLE), 9) AS confidence, keywords, secondary FROM told""", KEYWORDS)
def k16_keyword_industries(spark, sf_dir):
    table = spark.createDataFrame([(i, c, w, p, list(k)) for i, c, w, p, k in DICTIONARY], "industry string, code string, weight double, place int, keywords array<string>")
    return classify.by_keywords(bids(spark, sf_dir), "id", "title", table).withColumn("confidence", F.round("confidence", 9))


#: (name, aliases, level, code, parent, place).
PLACES = (("ASIA", (), 1, "1000", None, 1), ("EUROPE", (), 1, "2000", None, 2), ("CHINA", ("Cathay",), 2, "1100", "ASIA", 3), ("JAPAN", (), 2, "1200", "ASIA", 4), ("FRANCE", (), 2, "2100", "EUROPE", 5), ("BUILDING", ("FURN",), 3, "1110", "CHINA", 6), ("MACHINERY", (), 3, "2110", "FRANCE", 7))

PLACES_SQL = "places(name, aliases, level, code, parent, place) AS (VALUES " + ", ".join(f"('{n}', CAST([{', '.join(map(repr, a))}] AS VARCHAR[]), {lv}, '{c}', {repr(p) if p else 'NULL'}, {o})" for n, a, lv, c, p, o in PLACES) + """),
names AS (SELECT name, level, code, parent, place, unnest(list_prepend(name, aliases)) AS word FROM places),
best AS (SELECT * FROM (SELECT b.id, n.*, word = name AS exact, row_number() OVER (PARTITION BY b.id ORDER BY level DESC, place, word <> name) AS r FROM bids b JOIN names n ON contains(b.title, n.word)) WHERE r = 1)"""


@query("""SELECT id, CASE level WHEN 1 THEN best.name WHEN 2 THEN best.parent ELSE up.parent END AS province, CASE level WHEN 2 THEN best.name WHEN 3 THEN best.parent END AS city, CASE WHEN level = 3 THEN best.name END AS district, code,
CAST(CASE WHEN exact THEN 0.95 ELSE 0.85 END AS DOUBLE) AS confidence FROM best LEFT JOIN (SELECT name, parent FROM places) up ON best.parent = up.name""", PLACES_SQL)
def k17_places(spark, sf_dir):
    table = spark.createDataFrame([(n, list(a), lv, c, p, o) for n, a, lv, c, p, o in PLACES], "name string, aliases array<string>, level int, code string, parent string, place int")
    return classify.by_places(bids(spark, sf_dir), "id", "title", table).withColumn("confidence", F.col("confidence").cast("double"))
