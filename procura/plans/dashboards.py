"""Queries: filters, pages, dashboard statistics, trends and competitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import competitors, paging, predicates, ranges, stats, tables, trends
from ..sources.notices import AS_OF, bids, table, wins
from .registry import query

DAY = "strftime({}, '%Y-%m-%d')"


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias("day")


@query("""SELECT count(*) AS total_count, CAST(sum(budget_amount) AS DOUBLE) AS total_amount, count(DISTINCT nullif(tenderer, '')) AS unique_tenderers,
  CAST(sum(budget_amount) AS DOUBLE) / count(*) AS average_amount,
  count(*) FILTER (date_trunc('day', publish_date) = date_trunc('day', :as_of)) AS today_count,
  count(*) FILTER (publish_date >= date_trunc('week', :as_of)) AS week_count,
  count(*) FILTER (publish_date >= date_trunc('month', :as_of)) AS month_count
FROM chosen""", """chosen AS (SELECT * FROM bids WHERE publish_date >= TIMESTAMP '1996-01-01' AND publish_date <= TIMESTAMP '2001-12-31'
  AND region IN ('ASIA', 'EUROPE', 'AMERICA') AND budget_amount >= 100000 AND budget_amount < 15000000)""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over the F10 filter: the flagship query."""
    chosen = predicates.analytics("1996-01-01", "2001-12-31", regions=["ASIA", "EUROPE", "AMERICA"], low=100_000, high=15_000_000)
    return stats.overview(bids(spark, sf_dir).where(chosen), AS_OF)


@query("""SELECT month, "count", total, round((total - prev) / prev * 100, 2) AS growth FROM (
SELECT *, lag(total) OVER (ORDER BY month) AS prev FROM (
SELECT strftime(publish_date, '%Y-%m') AS month, count(*) AS "count", CAST(sum(budget_amount) AS DOUBLE) AS total
FROM bids WHERE budget_amount IS NOT NULL GROUP BY 1))""")
def monthly_trend(spark, sf_dir):
    return trends.budget_trend(bids(spark, sf_dir)).drop("average")


@query("""SELECT id, title FROM bids WHERE contains(lower(title), '1-urgent') OR contains(lower(description), '1-urgent') OR contains(lower(tenderer), '1-urgent')""")
def f1_keyword_filter(spark, sf_dir):
    return bids(spark, sf_dir).where(predicates.keywords(["1-URGENT"])).select("id", "title")


@query("""SELECT id, strftime(publish_date, '%Y-%m-%d') AS day FROM bids WHERE region = 'ASIA' AND industry = 'BUILDING' AND status = 'active'
AND publish_date >= TIMESTAMP '1997-01-01' AND publish_date <= TIMESTAMP '1999-12-31'""")
def f2_conjunction_filter(spark, sf_dir):
    wanted = predicates.conjunction("ASIA", "BUILDING", "active", ("1997-01-01", "1999-12-31"))
    return bids(spark, sf_dir).where(wanted).select("id", day("publish_date"))


@query("""SELECT id FROM bids WHERE contains(lower(title), 'nation_7') OR contains(lower(tenderer), 'nation_7') OR contains(lower(description), 'nation_7')""")
def f3_list_search(spark, sf_dir):
    return bids(spark, sf_dir).where(predicates.keywords(["Nation_7"])).select("id")


@query("""SELECT id, strftime(created_at, '%Y-%m-%d %H') AS hour FROM bids WHERE contains(lower(region_name), 'nation_1') AND contains(lower(industry), 'mach')
AND contains(lower(source_site), 'site1') AND budget_amount >= 1000000 AND budget_amount <= 12000000 ORDER BY created_at DESC, id LIMIT 40""")
def f4_api_filter(spark, sf_dir):
    p = predicates
    wanted = p.all_of([p.has_text("region_name", "Nation_1"), p.has_text("industry", "mach"), p.has_text("source_site", "site1"), p.between("budget_amount", 1_000_000, 12_000_000)])
    return paging.top(bids(spark, sf_dir).where(wanted), [F.desc("created_at"), F.col("id")], 40).select("id", F.date_format("created_at", "yyyy-MM-dd HH").alias("hour"))


@query("""SELECT id FROM bids WHERE (region_code = '8' OR contains(lower(region_name), '8') OR region_code = 'NATION_1' OR contains(lower(region_name), 'nation_1'))
AND (industry_code = 'E47' OR contains(lower(industry), 'e47') OR industry_code = 'furn' OR contains(lower(industry), 'furn'))
AND budget_amount >= 500000 AND publish_date >= TIMESTAMP '1996-06-01' AND publish_date <= TIMESTAMP '2001-06-01' AND status IN ('active', 'pending') AND notice_type = 'bidding' AND contains(lower(tenderer), '#0000000')""")
def f5_query_builder(spark, sf_dir):
    params = {"regions": ["8", "NATION_1"], "industries": ["E47", "furn"], "budgetMin": 500_000, "publishDateFrom": "1996/06/01", "publishDateTo": "2001-06-01", "status": ["active", "pending"], "notice_type": "bidding", "tenderer": "#0000000"}
    return bids(spark, sf_dir).where(predicates.build(params, bool)).select("id")


@query("""SELECT id, CAST(budget_amount AS DOUBLE) AS amount FROM bids WHERE budget_amount >= 1000000 AND budget_amount <= 5000000""")
def f6_budget_range(spark, sf_dir):
    return bids(spark, sf_dir).where(predicates.between("budget_amount", 1_000_000, 5_000_000)).select("id", F.col("budget_amount").cast("double").alias("amount"))


@query("""SELECT id FROM bids WHERE notice_type = 'bidding' AND region_code IN ('1', '2', '3') AND industry_code IN ('E47', 'I65') AND budget_amount <= 9000000""")
def f9_post_filter(spark, sf_dir):
    c = F.col
    return bids(spark, sf_dir).where((c("notice_type") == "bidding") & c("region_code").isin("1", "2", "3") & c("industry_code").isin("E47", "I65") & (c("budget_amount") <= 9_000_000)).select("id")


@query("""SELECT id FROM bids WHERE publish_date >= TIMESTAMP '1998-01-01' AND region IN ('AFRICA') AND industry IN ('BUILDING', 'MACHINERY')
AND budget_amount IS NOT NULL AND budget_amount >= 1000000 AND budget_amount < 5000000""")
def f10_analytics_filter(spark, sf_dir):
    return bids(spark, sf_dir).where(predicates.analytics("1998-01-01", None, ["AFRICA"], ["BUILDING", "MACHINERY"], None, 1_000_000, 5_000_000)).select("id")


@query("""SELECT a.id AS id, count(*) AS same FROM bids a JOIN bids b ON a.title = b.title AND CAST(a.publish_date AS DATE) = CAST(b.publish_date AS DATE) AND a.id <> b.id GROUP BY a.id""")
def f12_duplicate_lookup(spark, sf_dir):
    """Rows of the same title and day, by a window instead of a self-join."""
    same = F.count(F.lit(1)).over(W.partitionBy("title", F.to_date("publish_date"))) - 1
    return bids(spark, sf_dir).select("id", same.cast("bigint").alias("same")).where("same > 0")


@query("""SELECT 'owned' AS rule, id FROM bids WHERE created_by = 7 OR (is_public AND created_by IS NULL)
UNION ALL SELECT 'visible', id FROM bids WHERE (created_by = 7 OR is_public) AND tenant_id = 't3'
UNION ALL SELECT 'tenant', id FROM bids WHERE tenant_id = 't3'""")
def f13_isolation(spark, sf_dir):
    rows = bids(spark, sf_dir)
    rules = {"owned": predicates.owned(7), "visible": predicates.visible(7, "t3"), "tenant": predicates.of_tenant("t3"), "none": predicates.owned(None)}
    names = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return rows.select(F.explode(names).alias("rule"), "id")


@query("""SELECT id, CASE status WHEN 'active' THEN '进行中' WHEN 'pending' THEN '待处理' WHEN 'closed' THEN '已关闭' ELSE status END AS status_name,
CASE WHEN budget_amount <> 0 THEN CAST(budget_amount AS DOUBLE) END AS budget, strftime(publish_date, '%Y-%m-%dT%H:%M:%S') AS published, nullif(region_name, '') AS region_name FROM bids""")
def f15_projection(spark, sf_dir):
    status = F.create_map(*map(F.lit, ("active", "进行中", "pending", "待处理", "closed", "已关闭")))[F.col("status")]
    amount = F.when(F.col("budget_amount") != 0, F.col("budget_amount").cast("double"))
    return bids(spark, sf_dir).select("id", F.coalesce(status, "status").alias("status_name"), amount.alias("budget"), F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss").alias("published"), F.nullif(F.col("region_name"), F.lit("")).alias("region_name"))


@query("""SELECT id, CAST(budget_amount AS DOUBLE) AS amount FROM bids WHERE status = 'active' ORDER BY budget_amount DESC NULLS FIRST, id LIMIT 25""")
def l2_top_by_budget(spark, sf_dir):
    """A descending order with nulls first, as the reference's database has it."""
    return paging.top(bids(spark, sf_dir).where("status = 'active'"), [F.desc_nulls_first("budget_amount"), F.col("id")], 25).select("id", F.col("budget_amount").cast("double").alias("amount"))


@query("""SELECT id FROM bids ORDER BY publish_date DESC, id LIMIT 20 OFFSET (SELECT greatest(0, (CAST(ceil(count(*) / 20.0) AS BIGINT) - 1)) * 20 FROM bids)""")
def l3_clamped_page(spark, sf_dir):
    return ranges.page_rows(bids(spark, sf_dir).select("id", "publish_date"), [F.desc("publish_date"), F.col("id")], 10**9, 20).select("id")


@query("""SELECT id FROM bids ORDER BY publish_date DESC, id LIMIT 20 OFFSET 40""")
def l5_slice_page(spark, sf_dir):
    return paging.slice_page(bids(spark, sf_dir).select("id", "publish_date"), [F.desc("publish_date"), F.col("id")], 3, 20).select("id")


@query("""SELECT 'region' AS kind, region_name AS key FROM bids WHERE region_name <> '' GROUP BY 2 UNION ALL SELECT 'industry', industry FROM bids WHERE industry <> '' GROUP BY 2
UNION ALL SELECT 'source', source_site FROM bids GROUP BY 2""")
def a41_filter_options(spark, sf_dir):
    pairs = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("region", "region_name"), ("industry", "industry"), ("source", "source_site")))))
    return bids(spark, sf_dir).select(pairs).where("key != ''").distinct()


SIX_CASE = "CASE WHEN budget_amount >= 10000000 THEN '1000万以上' WHEN budget_amount >= 5000000 THEN '500-1000万' WHEN budget_amount >= 1000000 THEN '100-500万' WHEN budget_amount >= 500000 THEN '50-100万' WHEN budget_amount >= 100000 THEN '10-50万' WHEN budget_amount >= 0 THEN '0-10万' ELSE '未知' END"


@query(f"""SELECT 'tenderer' AS kind, coalesce(nullif(tenderer, ''), '未知') AS key, count(*) AS "count" FROM bids GROUP BY 2
UNION ALL SELECT 'region', coalesce(nullif(region_name, ''), '未知'), count(*) FROM bids GROUP BY 2
UNION ALL SELECT 'industry', coalesce(nullif(industry, ''), '未知'), count(*) FROM bids GROUP BY 2
UNION ALL SELECT 'amount', {SIX_CASE}, count(*) FROM bids GROUP BY 2""")
def a2_classification_counts(spark, sf_dir):
    return stats.classification(bids(spark, sf_dir))


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, CAST(sum(budget_amount) AS DOUBLE) AS total_budget FROM bids""")
def a3_statistics(spark, sf_dir):
    return bids(spark, sf_dir).agg(stats.n(name="total"), stats.n(F.col("status") == "active", "active"), stats.total(name="total_budget"))


@query("""SELECT region_name AS key, count(*) AS "count" FROM bids WHERE region_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a3_top_regions(spark, sf_dir):
    return paging.top(stats.group_counts(bids(spark, sf_dir).where("region_name != ''"), F.col("region_name")), [F.desc("count"), F.col("key")], 10)


@query("""SELECT 'region' AS kind, region_name AS key, count(*) AS "count" FROM bids GROUP BY 2 UNION ALL SELECT 'industry', industry, count(*) FROM bids GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM bids GROUP BY 2""")
def a4_distributions(spark, sf_dir):
    pairs = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("region", "region_name"), ("industry", "industry"), ("status", "status")))))
    return bids(spark, sf_dir).select(pairs).groupBy("kind", "key").agg(stats.n())


@query("""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS "count" FROM bids WHERE CAST(created_at AS DATE) BETWEEN DATE '2001-07-03' AND DATE '2001-08-02' GROUP BY 1""")
def a5_daily_trend(spark, sf_dir):
    return stats.daily(bids(spark, sf_dir), "created_at", "2001-07-03", "2001-08-02")


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(c, 0) AS "count" FROM (SELECT unnest(generate_series(DATE '2001-07-03', DATE '2001-08-10', INTERVAL 1 DAY)) AS d)
LEFT JOIN (SELECT CAST(created_at AS DATE) AS x, count(*) AS c FROM bids GROUP BY 1) ON x = CAST(d AS DATE)""")
def a7_daily_trend_filled(spark, sf_dir):
    return stats.daily_filled(spark, bids(spark, sf_dir), "created_at", "2001-07-03", "2001-08-10")


def buckets_sql(bounds: tuple) -> str:
    rows = []
    for i, (name, low) in enumerate(bounds):
        high = f" AND budget_amount < {bounds[i + 1][1]}" if i + 1 < len(bounds) else ""
        rows.append(f"SELECT {i} AS place, '{name}' AS \"range\", count(*) FILTER (budget_amount >= {low}{high}) AS \"count\", count(*) FILTER (budget_amount >= 0) AS every FROM bids")
    return 'SELECT place, "range", "count", CAST("count" AS DOUBLE) / every AS ratio FROM (' + " UNION ALL ".join(rows) + ")"


@query(buckets_sql(stats.FIVE))
def a8_budget_distribution(spark, sf_dir):
    return stats.distribution(bids(spark, sf_dir), stats.FIVE)


@query(buckets_sql(stats.SIX))
def a16_amount_distribution(spark, sf_dir):
    return stats.distribution(bids(spark, sf_dir), stats.SIX)


@query("""SELECT CAST(sum(budget_amount) AS DOUBLE) / count(budget_amount) AS average, CAST(max(budget_amount) AS DOUBLE) AS largest, CAST(min(budget_amount) AS DOUBLE) AS smallest FROM bids""")
def a8_budget_summary(spark, sf_dir):
    return bids(spark, sf_dir).agg((F.sum("budget_amount").cast("double") / F.count("budget_amount")).alias("average"), F.max("budget_amount").cast("double").alias("largest"), F.min("budget_amount").cast("double").alias("smallest"))


@query("""SELECT tenderer AS key, count(*) AS "count", CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount FROM bids WHERE tenderer <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def a9_top_tenderers(spark, sf_dir):
    found = bids(spark, sf_dir).where("tenderer != ''").groupBy(F.col("tenderer").alias("key")).agg(stats.n(), stats.total())
    return paging.top(found, [F.desc("count"), F.col("key")], 20)


@query("""SELECT industry AS key, count(*) AS "count", CASE WHEN count(*) > 10 THEN 'up' ELSE 'stable' END AS trend FROM bids WHERE industry <> '' AND publish_date >= :as_of - INTERVAL 30 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def a10_hot_industries(spark, sf_dir):
    recent = F.col("publish_date") >= F.timestamp_add("DAY", F.lit(-30), F.to_timestamp(F.lit(AS_OF)))
    found = stats.group_counts(bids(spark, sf_dir).where((F.col("industry") != "") & recent), F.col("industry"))
    return paging.top(found, [F.desc("count"), F.col("key")], 5).withColumn("trend", F.when(F.col("count") > 10, "up").otherwise("stable"))


@query("""SELECT count(*) FILTER (CAST(created_at AS DATE) = DATE '2001-08-01') AS today, count(*) FILTER (CAST(created_at AS DATE) = DATE '2001-08-01') - count(*) FILTER (CAST(created_at AS DATE) = DATE '2001-07-31') AS delta,
count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND budget_amount >= 1000000 AND deadline_date >= TIMESTAMP '2001-08-01') AS opportunities FROM bids""")
def a11_daily_report(spark, sf_dir):
    created, c = F.to_date("created_at"), F.col
    today = stats.n(created == F.to_date(F.lit("2001-08-01")), "today")
    yesterday = F.count_if(created == F.to_date(F.lit("2001-07-31")))
    active = c("status") == "active"
    return bids(spark, sf_dir).agg(today, (F.count_if(created == F.to_date(F.lit("2001-08-01"))) - yesterday).cast("bigint").alias("delta"), stats.n(active, "active"), stats.n(active & (c("budget_amount") >= 1_000_000) & (c("deadline_date") >= F.to_timestamp(F.lit("2001-08-01"))), "opportunities"))


@query("""SELECT industry AS key, count(*) AS "count", CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount FROM bids WHERE created_at >= TIMESTAMP '2001-07-26' AND created_at < TIMESTAMP '2001-08-02' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def a12_weekly_report(spark, sf_dir):
    week = F.col("created_at").between(F.to_timestamp(F.lit("2001-07-26")), F.to_timestamp(F.lit("2001-08-01 23:59:59.999999")))
    return paging.top(bids(spark, sf_dir).where(week).groupBy(F.col("industry").alias("key")).agg(stats.n(), stats.total()), [F.desc("count"), F.col("key")], 5)


@query("""SELECT 'month' AS kind, strftime(publish_date, '%Y-%m') AS period, count(*) AS "count", CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount FROM bids GROUP BY 2
UNION ALL SELECT 'quarter', year(publish_date) || '-Q' || quarter(publish_date), count(*), CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) FROM bids GROUP BY 2
UNION ALL SELECT 'year', CAST(year(publish_date) AS VARCHAR), count(*), CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) FROM bids GROUP BY 2""")
def a13_time_series(spark, sf_dir):
    return stats.periods(bids(spark, sf_dir))


def ranked_sql(column: str) -> str:
    return f"""SELECT key, "count", total_amount, CAST("count" AS DOUBLE) / sum("count") OVER () AS ratio, row_number() OVER (ORDER BY "count" DESC, key) AS rank FROM (
    SELECT coalesce(nullif({column}, ''), '未知') AS key, count(*) AS "count", CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount FROM bids GROUP BY 1)"""


@query(ranked_sql("region_name"))
def a14_region_distribution(spark, sf_dir):
    return stats.ranked_shares(bids(spark, sf_dir), stats.known("region_name"))


@query(ranked_sql("industry"))
def a15_industry_heat(spark, sf_dir):
    return stats.ranked_shares(bids(spark, sf_dir), stats.known("industry"))


@query(ranked_sql("tenderer"))
def a17_tenderer_activity(spark, sf_dir):
    return stats.ranked_shares(bids(spark, sf_dir), stats.known("tenderer"), many=True)


RANKED = """SELECT winner, count(*) AS win_count, CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount, CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) / count(*) AS average_size FROM wins WHERE winner <> '' GROUP BY 1"""


@query("""SELECT 'all' AS kind, '' AS key, count(*) AS win_count, CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount, CAST(sum(budget_amount) AS DOUBLE) / count(budget_amount) AS average FROM wins WHERE winner = 'Supplier#000000001'
UNION ALL SELECT 'month', strftime(publish_date, '%Y-%m'), count(*), CAST(coalesce(sum(budget_amount), 0) AS DOUBLE), coalesce(CAST(sum(budget_amount) AS DOUBLE) / nullif(count(budget_amount), 0), 0) FROM wins WHERE winner = 'Supplier#000000001' GROUP BY 2
UNION ALL SELECT 'industry', industry, count(*), CAST(coalesce(sum(budget_amount), 0) AS DOUBLE), coalesce(CAST(sum(budget_amount) AS DOUBLE) / nullif(count(budget_amount), 0), 0) FROM wins WHERE winner = 'Supplier#000000001' GROUP BY 2""")
def a18_competitor_analysis(spark, sf_dir):
    return competitors.profile(wins(spark, sf_dir), "Supplier#000000001")


@query(RANKED + " ORDER BY win_count DESC, winner LIMIT 10")
def a19_ranking_by_wins(spark, sf_dir):
    return competitors.ranking(wins(spark, sf_dir))


@query(RANKED + " ORDER BY total_amount DESC, winner LIMIT 10")
def a19_ranking_by_amount(spark, sf_dir):
    return competitors.ranking(wins(spark, sf_dir), "total_amount")


@query(RANKED + " ORDER BY average_size DESC, winner LIMIT 10")
def a19_ranking_by_size(spark, sf_dir):
    return competitors.ranking(wins(spark, sf_dir), "average_size")


@query("""SELECT winner, months, CASE WHEN months < 3 THEN 'insufficient_data' WHEN b * 5 > a * 6 THEN 'increasing' WHEN b * 5 < a * 4 THEN 'decreasing' ELSE 'stable' END AS direction FROM (
SELECT winner, max(m) AS months, sum(CASE WHEN p <= m // 2 THEN c ELSE 0 END) AS a, sum(CASE WHEN p > m // 2 THEN c ELSE 0 END) AS b FROM (
SELECT winner, c, row_number() OVER (PARTITION BY winner ORDER BY mo) AS p, count(*) OVER (PARTITION BY winner) AS m FROM (
SELECT winner, strftime(publish_date, '%Y-%m') AS mo, count(*) AS c FROM wins WHERE winner <> '' GROUP BY 1, 2)) GROUP BY 1)""")
def a20_competitor_trend(spark, sf_dir):
    return competitors.trend(wins(spark, sf_dir))


@query("""SELECT winner, round(c * 100.0 / ac, 2) AS share_count, round(s * 100.0 / a_s, 2) AS share_amount, coalesce(round((s / p) / (a_s / ap), 2), 1.0) AS mean_ratio FROM
(SELECT winner, CAST(count(*) AS DOUBLE) AS c, CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS s, nullif(count(budget_amount), 0) AS p FROM wins WHERE winner <> '' GROUP BY 1),
(SELECT count(*) AS ac, CAST(sum(budget_amount) AS DOUBLE) AS a_s, count(budget_amount) AS ap FROM wins)""")
def a21_market_benchmark(spark, sf_dir):
    return competitors.benchmark(wins(spark, sf_dir))


@query("""SELECT winner, count(*) AS win_count FROM wins WHERE winner <> '' GROUP BY 1 HAVING count(*) >= 5""")
def a22_competitor_list(spark, sf_dir):
    return competitors.at_least(wins(spark, sf_dir), 5)


@query("""SELECT month, total, total / c AS average, c AS "count", CASE WHEN prev > 0 THEN round((total - prev) / prev * 100, 2) END AS growth FROM (
SELECT *, lag(total) OVER (ORDER BY month) AS prev FROM (SELECT strftime(publish_date, '%Y-%m') AS month, CAST(sum(budget_amount) AS DOUBLE) AS total, count(*) AS c FROM bids WHERE budget_amount IS NOT NULL GROUP BY 1))""")
def a23_budget_trend(spark, sf_dir):
    return trends.budget_trend(bids(spark, sf_dir))


@query("""SELECT strftime(publish_date, '%Y-%m') AS month, count(*) FILTER (notice_type = 'bidding') AS bidding, count(*) FILTER (notice_type = 'win') AS win, count(*) AS total
FROM (SELECT notice_type, publish_date FROM bids UNION ALL SELECT notice_type, publish_date FROM wins) GROUP BY 1""")
def a24_volume_trend(spark, sf_dir):
    columns = ["notice_type", "publish_date"]
    return trends.volume_trend(bids(spark, sf_dir).select(*columns).unionByName(wins(spark, sf_dir).select(*columns)))


def breakdown_sql(name: str, code: str) -> str:
    return f"""SELECT key, c AS "count", s AS total_amount, s / c AS average FROM (SELECT coalesce(nullif({name}, ''), nullif({code}, ''), 'Unknown') AS key, count(*) AS c, CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS s FROM bids GROUP BY 1)"""


@query(breakdown_sql("industry", "industry_code"))
def a25_industry_breakdown(spark, sf_dir):
    return trends.breakdown(bids(spark, sf_dir), "industry", "industry_code")


@query(breakdown_sql("region_name", "region_code"))
def a25_region_breakdown(spark, sf_dir):
    return trends.breakdown(bids(spark, sf_dir), "region_name", "region_code")


@query("SELECT * FROM (" + breakdown_sql("region_name", "region_code") + ") ORDER BY total_amount DESC, key LIMIT 5")
def a26_hot_regions(spark, sf_dir):
    return paging.top(trends.breakdown(bids(spark, sf_dir), "region_name", "region_code"), [F.desc("total_amount"), F.col("key")], 5)


@query("""SELECT c1 AS count1, c2 AS count2, s1 AS sum1, s2 AS sum2, a1 AS average1, a2 AS average2, CASE WHEN c1 > 0 THEN round((c2 - c1) / c1 * 100, 2) END AS count_change, CASE WHEN s1 > 0 THEN round((s2 - s1) / s1 * 100, 2) END AS sum_change, CASE WHEN a1 > 0 THEN round((a2 - a1) / a1 * 100, 2) END AS average_change FROM (
SELECT *, coalesce(s1 / nullif(p1, 0), 0) AS a1, coalesce(s2 / nullif(p2, 0), 0) AS a2 FROM (
SELECT count(*) FILTER (y = 1998) AS c1, count(*) FILTER (y = 1999) AS c2, CAST(coalesce(sum(budget_amount) FILTER (y = 1998), 0) AS DOUBLE) AS s1, CAST(coalesce(sum(budget_amount) FILTER (y = 1999), 0) AS DOUBLE) AS s2,
count(budget_amount) FILTER (y = 1998) AS p1, count(budget_amount) FILTER (y = 1999) AS p2 FROM (SELECT year(publish_date) AS y, budget_amount FROM bids)))""")
def a27_period_comparison(spark, sf_dir):
    return trends.compare(bids(spark, sf_dir), ("1998-01-01", "1999-01-01"), ("1999-01-01", "2000-01-01"))


FORECAST_SQL = """s AS (SELECT b AS bin, coalesce(v, 0.0) AS value FROM (SELECT unnest(range(12)) AS b) LEFT JOIN (
SELECT CAST(floor((epoch(publish_date) - epoch(:as_of - INTERVAL 365 DAY)) / 2592000) AS BIGINT) AS x, CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS v FROM bids WHERE publish_date >= :as_of - INTERVAL 365 DAY GROUP BY 1) ON x = b),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(bin) AS DOUBLE) AS sx, CAST(sum(CAST(value AS DECIMAL(30,4))) AS DOUBLE) AS sy, CAST(sum(bin * CAST(value AS DECIMAL(30,4))) AS DOUBLE) AS sxy, CAST(sum(bin * bin) AS DOUBLE) AS sxx, stddev_samp(value) AS sd FROM s),
l AS (SELECT n, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, sx, sy / n AS mean, sd FROM m)"""


@query("""SELECT step, round(greatest((mean - slope * sx / n) + slope * (n + step - 1), 0.0), 2) AS predicted, round(CASE WHEN mean = 0 THEN 0.5 ELSE least(greatest(1 - sd / mean, 0.1), 0.95) END, 6) AS confidence FROM l, (SELECT unnest(range(1, 4)) AS step)""", FORECAST_SQL)
def a28_budget_forecast(spark, sf_dir):
    """A28 and A29."""
    return trends.forecast(trends.bins(bids(spark, sf_dir), AS_OF), 3)


@query("""SELECT round(CAST(sum(CASE WHEN p <= 3 THEN c ELSE 0 END) AS DOUBLE) / sum(c), 4) AS concentration, count(*) AS competitors FROM (SELECT *, row_number() OVER (ORDER BY s DESC, winner) AS p FROM (SELECT winner, count(*) AS c, CAST(sum(budget_amount) AS DOUBLE) AS s FROM wins WHERE winner <> '' GROUP BY 1)) WHERE p <= 10""")
def a30_market_concentration(spark, sf_dir):
    return competitors.concentration(wins(spark, sf_dir))


@query("""SELECT min(publish_date) AS first_date, max(publish_date) AS last_date, arg_min(t, month) AS first_total, arg_max(t, month) AS last_total, round((arg_max(t, month) - arg_min(t, month)) / arg_min(t, month) * 100, 2) AS growth FROM (
SELECT strftime(publish_date, '%Y-%m') AS month, strftime(min(publish_date), '%Y-%m-%d') AS publish_date, CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS t FROM bids GROUP BY 1)""")
def a40_trend_report(spark, sf_dir):
    monthly = bids(spark, sf_dir).groupBy(trends.month().alias("month")).agg(F.date_format(F.min("publish_date"), "yyyy-MM-dd").alias("day"), stats.total(name="t"))
    first, last = F.min_by("t", "month"), F.max_by("t", "month")
    return monthly.agg(F.min("day").alias("first_date"), F.max("day").alias("last_date"), first.alias("first_total"), last.alias("last_total"), F.round((last - first) / first * 100, 2).alias("growth"))


@query("""SELECT 'tenant' AS kind, tenant_id AS key, count(*) AS "count", count(*) FILTER (is_public) AS public FROM bids GROUP BY 2 UNION ALL SELECT 'user', CAST(created_by AS VARCHAR), count(*), count(*) FILTER (is_public) FROM bids GROUP BY 2""")
def a42_owner_stats(spark, sf_dir):
    pairs = F.inline(F.array(F.struct(F.lit("tenant").alias("kind"), F.col("tenant_id").alias("key")), F.struct(F.lit("user").alias("kind"), F.col("created_by").cast("string").alias("key"))))
    return bids(spark, sf_dir).select(pairs, "is_public").groupBy("kind", "key").agg(stats.n(), stats.n(F.col("is_public"), "public"))


@query("""SELECT tenderer, count(*) AS total, CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount, round(count(*) / (greatest(date_diff('day', min(publish_date), max(publish_date)), 30) / 30.0), 4) AS per_month,
CASE WHEN count(*) / (greatest(date_diff('day', min(publish_date), max(publish_date)), 30) / 30.0) > 5 THEN 'high' WHEN count(*) / (greatest(date_diff('day', min(publish_date), max(publish_date)), 30) / 30.0) > 1 THEN 'medium' ELSE 'low' END AS activity FROM bids WHERE tenderer <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def a33_tenderer_insights(spark, sf_dir):
    """The hundred most active tenderers with their activity level."""
    days = F.greatest(F.date_diff(F.max("publish_date"), F.min("publish_date")), F.lit(30))
    per_month = F.count(F.lit(1)) / (days / 30.0)
    level = F.when(per_month > 5, "high").when(per_month > 1, "medium").otherwise("low")
    found = bids(spark, sf_dir).where("tenderer != ''").groupBy("tenderer").agg(stats.n(name="total"), stats.total(), F.round(per_month, 4).alias("per_month"), level.alias("activity"))
    return paging.top(found, [F.desc("total"), F.col("tenderer")], 100)


@query("""SELECT id, strftime(publish_date, '%Y-%m-%d') AS day FROM bids WHERE publish_date >= :as_of - INTERVAL 30 DAY ORDER BY publish_date DESC, id LIMIT 50""")
def q1_recent(spark, sf_dir):
    recent = F.col("publish_date") >= F.timestamp_add("DAY", F.lit(-30), F.to_timestamp(F.lit(AS_OF)))
    return paging.top(bids(spark, sf_dir).where(recent), [F.desc("publish_date"), F.col("id")], 50).select("id", day("publish_date"))


@query("""SELECT id, tenderer FROM bids WHERE contains(tenderer, '00012') ORDER BY publish_date DESC, id LIMIT 20""")
def q2_tenderer_like(spark, sf_dir):
    return paging.top(bids(spark, sf_dir).where(F.col("tenderer").contains("00012")), [F.desc("publish_date"), F.col("id")], 20).select("id", "tenderer")


@query("""SELECT id FROM bids WHERE region_code = '5' AND industry_code = 'C17' AND status = 'active' ORDER BY publish_date DESC, id LIMIT 50""")
def q3_conjunction(spark, sf_dir):
    return paging.top(bids(spark, sf_dir).where("region_code = '5' and industry_code = 'C17' and status = 'active'"), [F.desc("publish_date"), F.col("id")], 50).select("id")


@query("""SELECT count(*) AS "count" FROM bids WHERE status = 'active' AND notice_type = 'bidding'""")
def q4_count(spark, sf_dir):
    return bids(spark, sf_dir).where("status = 'active' and notice_type = 'bidding'").agg(stats.n())


@query("""SELECT id, CAST(budget_amount AS DOUBLE) AS amount FROM bids WHERE budget_amount BETWEEN 100000 AND 500000 ORDER BY budget_amount DESC, id LIMIT 50""")
def q5_budget_between(spark, sf_dir):
    rows = bids(spark, sf_dir).where(predicates.between("budget_amount", 100_000, 500_000))
    return paging.top(rows, [F.desc("budget_amount"), F.col("id")], 50).select("id", F.col("budget_amount").cast("double").alias("amount"))


@query("""SELECT id, title FROM bids WHERE id = 77""")
def s2_point_lookup(spark, sf_dir):
    return bids(spark, sf_dir).where("id = 77").select("id", "title").limit(1)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS "count" FROM events GROUP BY 1, 2""")
def s4_json_props(spark, sf_dir):
    props = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), props["k"].alias("k")).agg(stats.n())


PAIRS = """pairs AS (SELECT 'status' AS kind, status AS key, budget_amount FROM bids UNION ALL SELECT 'region', region, budget_amount FROM bids WHERE region <> '' UNION ALL SELECT 'industry', industry, budget_amount FROM bids WHERE industry <> ''
UNION ALL SELECT 'total', 'all', budget_amount FROM bids UNION ALL SELECT 'total', 'active', budget_amount FROM bids WHERE status = 'active'),
placed AS (SELECT kind, key, count(*) AS "count", CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, key) AS r FROM pairs GROUP BY 1, 2)"""


@query("""SELECT kind, key, "count", total_amount FROM placed WHERE r <= 10""", PAIRS)
def a6_service_overview(spark, sf_dir):
    return stats.service_overview(bids(spark, sf_dir))


PROFILE = """chosen AS (SELECT * FROM bids WHERE contains(lower(tenderer), '#00000001')),
kinds AS (SELECT 'total' AS kind, 'all' AS key, budget_amount FROM chosen UNION ALL SELECT 'industry', industry, budget_amount FROM chosen UNION ALL SELECT 'region', region, budget_amount FROM chosen UNION ALL SELECT 'month', strftime(created_at, '%Y-%m'), budget_amount FROM chosen)"""


@query("""SELECT kind, key, count(*) AS "count", CAST(coalesce(sum(budget_amount), 0) AS DOUBLE) AS total_amount, coalesce(round(CAST(sum(budget_amount) AS DOUBLE) / count(budget_amount), 4), 0) AS average FROM kinds GROUP BY 1, 2
UNION ALL SELECT * FROM (SELECT 'recent', CAST(id AS VARCHAR), 1, CAST(coalesce(budget_amount, 0) AS DOUBLE), round(CAST(coalesce(budget_amount, 0) AS DOUBLE), 4) FROM chosen ORDER BY publish_date DESC, id LIMIT 10)""", PROFILE)
def a32_tenderer_profile(spark, sf_dir):
    """Totals, industries, regions and months of the tenderers whose name holds a text, and their ten latest notices."""
    return stats.profile(bids(spark, sf_dir).where(predicates.has_text("tenderer", "#00000001")))


@query("""SELECT 'overview' AS section, k AS key, v AS value FROM (SELECT unnest(['notices', 'amount', 'tenderers']) AS k, unnest([CAST(count(*) AS DOUBLE), CAST(sum(budget_amount) AS DOUBLE), CAST(count(DISTINCT nullif(tenderer, '')) AS DOUBLE)]) AS v FROM bids)
UNION ALL SELECT 'region', region, CAST(count(*) AS DOUBLE) FROM bids GROUP BY 2 UNION ALL SELECT 'industry', industry, CAST(count(*) AS DOUBLE) FROM bids GROUP BY 2
UNION ALL SELECT 'month', strftime(publish_date, '%Y-%m'), CAST(count(*) AS DOUBLE) FROM bids GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'latest', CAST(id AS VARCHAR), CAST(coalesce(budget_amount, 0) AS DOUBLE) FROM bids WHERE status = 'active' ORDER BY publish_date DESC, id LIMIT 10)""")
def a43_dashboard(spark, sf_dir):
    """Overview, classes, trend and the first page of open notices as sections of one table."""
    return stats.dashboard(bids(spark, sf_dir))


@query("""SELECT id FROM bids ORDER BY publish_date DESC, id LIMIT 20""")
def l4_fallback_page(spark, sf_dir):
    """A page beyond the last one gives the first."""
    return paging.fallback_page(bids(spark, sf_dir).select("id", "publish_date"), [F.desc("publish_date"), F.col("id")], 10**9, 20).select("id")


@query("""SELECT id FROM bids ORDER BY budget_amount DESC NULLS LAST, id LIMIT 30 OFFSET 17""")
def l6_offset_limit(spark, sf_dir):
    return bids(spark, sf_dir).orderBy(F.desc_nulls_last("budget_amount"), "id").offset(17).limit(30).select("id")


@query("""SELECT tenderer, id FROM bids QUALIFY row_number() OVER (PARTITION BY tenderer ORDER BY publish_date DESC, id DESC) <= 3""")
def l7_recent_per_tenderer(spark, sf_dir):
    """The latest notices of each tenderer, a bounded number of them."""
    return paging.recent(bids(spark, sf_dir).select("tenderer", "id", "publish_date"), ["tenderer"], [F.desc("publish_date"), F.desc("id")], 3).select("tenderer", "id")


@query("""SELECT id, title, region, industry, CAST(budget_amount AS VARCHAR) AS budget_amount FROM bids""")
def s16_full_export(spark, sf_dir):
    """The whole table as it is exported, read back."""
    path = tables.shared_folder(spark)
    bids(spark, sf_dir).select("id", "title", "region", "industry", F.col("budget_amount").cast("string").alias("budget_amount")).write.parquet(path)
    return spark.read.parquet(path)


SITES = """sites AS (SELECT 'site' || CAST(i AS VARCHAR) AS name, i % 2 = 0 AS is_active FROM range(5) t(i))"""


@query("""SELECT id, source_site FROM bids WHERE source_site IN (SELECT name FROM sites WHERE is_active AND contains(lower(name), 'site'))""", SITES)
def s22_active_sources(spark, sf_dir):
    """Notices of the sources that are active and whose name holds a text."""
    sites = spark.range(5).select(F.concat(F.lit("site"), F.col("id").cast("string")).alias("name"), (F.col("id") % 2 == 0).alias("is_active"))
    chosen = sites.where(F.col("is_active") & predicates.has_text("name", "SITE"))
    return bids(spark, sf_dir).join(chosen, F.col("source_site") == F.col("name"), "left_semi").select("id", "source_site")
