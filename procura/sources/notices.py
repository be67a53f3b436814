"""Notice tables: readers, and the view of the driver's star schema as notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all queries over the test tables; operators take it as an argument.
AS_OF = "2001-08-02 00:00:00"

#: Industry codes of the test tables' segments.
SEGMENT_CODES = {"BUILDING": "E47", "AUTOMOBILE": "C17", "MACHINERY": "D35", "HOUSEHOLD": "F51", "FURNITURE": "I65"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column) -> F.Column:
    """A price as decimal(15,2), forty times larger so that every amount bucket is met."""
    return (column.cast("decimal(15,2)") * 40).cast("decimal(15,2)")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bidding notices from orders; nulls and blanks are put in by key so that their rules are exercised."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("o_orderkey")
    code = F.create_map(*(F.lit(x) for kv in SEGMENT_CODES.items() for x in kv))[F.col("c_mktsegment")]
    day = F.col("o_orderdate").cast("timestamp")
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(
            k.alias("id"), F.lit("bidding").alias("notice_type"),
            F.concat_ws(" ", "o_orderpriority", F.lit("supply for"), "c_mktsegment", F.lit("in"), "n_name").alias("title"),
            F.concat_ws(" ", F.lit("Lot"), k.cast("string"), F.lit("of"), "c_name").alias("description"),
            F.col("c_name").alias("tenderer"), F.lit("").alias("winner"),
            F.when(k % 17 != 0, money(F.col("o_totalprice"))).alias("budget_amount"),
            day.alias("publish_date"),
            F.when(k % 13 != 0, F.timestamp_add("DAY", (k % 90).cast("int"), day)).alias("deadline_date"),
            F.timestamp_add("HOUR", (k % 24).cast("int"), day).alias("created_at"),
            F.col("n_nationkey").cast("string").alias("region_code"),
            F.when(k % 19 != 0, F.col("n_name")).otherwise("").alias("region_name"), F.col("r_name").alias("region"),
            F.when(k % 23 != 0, code).otherwise("").alias("industry_code"),
            F.when(k % 23 != 0, F.col("c_mktsegment")).otherwise("").alias("industry"),
            F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "pending").otherwise("closed").alias("status"),
            F.concat(F.lit("https://notices.example.org/"), k.cast("string")).alias("source_url"),
            F.concat(F.lit("site"), (k % 5).cast("string")).alias("source_site"),
            (F.col("o_custkey") % 50).alias("created_by"), (k % 3 == 0).alias("is_public"),
            F.concat(F.lit("t"), (F.col("o_custkey") % 7).cast("string")).alias("tenant_id"),
        )
    )


def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award notices from line items: the supplier wins; each seventh has no winner, each eleventh no amount."""
    line, p, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        line.join(p, line.l_partkey == p.p_partkey).join(s, line.l_suppkey == s.s_suppkey)
        .join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("l_orderkey").alias("id"), F.lit("win").alias("notice_type"), F.col("p_name").alias("title"),
            F.when(F.col("l_partkey") % 7 != 0, F.col("s_name")).otherwise("").alias("winner"),
            F.when(F.col("l_partkey") % 11 != 0, money(F.col("l_extendedprice"))).alias("budget_amount"),
            F.col("l_shipdate").cast("timestamp").alias("publish_date"),
            F.col("n_name").alias("region_name"), F.col("r_name").alias("region"), F.col("p_type").alias("industry"),
        )
    )


BIDS_SQL = """bids AS (
SELECT o_orderkey AS id, 'bidding' AS notice_type,
  concat_ws(' ', o_orderpriority, 'supply for', c_mktsegment, 'in', n_name) AS title,
  concat_ws(' ', 'Lot', CAST(o_orderkey AS VARCHAR), 'of', c_name) AS description,
  c_name AS tenderer, '' AS winner,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 40 AS DECIMAL(15,2)) END AS budget_amount,
  CAST(o_orderdate AS TIMESTAMP) AS publish_date,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 90 AS INTEGER)) END AS deadline_date,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created_at,
  CAST(n_nationkey AS VARCHAR) AS region_code,
  CASE WHEN o_orderkey % 19 <> 0 THEN n_name ELSE '' END AS region_name, r_name AS region,
  CASE WHEN o_orderkey % 23 <> 0 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'E47' WHEN 'AUTOMOBILE' THEN 'C17' WHEN 'MACHINERY' THEN 'D35' WHEN 'HOUSEHOLD' THEN 'F51' WHEN 'FURNITURE' THEN 'I65' END ELSE '' END AS industry_code,
  CASE WHEN o_orderkey % 23 <> 0 THEN c_mktsegment ELSE '' END AS industry,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'pending' ELSE 'closed' END AS status,
  'https://notices.example.org/' || CAST(o_orderkey AS VARCHAR) AS source_url,
  'site' || CAST(o_orderkey % 5 AS VARCHAR) AS source_site,
  o_custkey % 50 AS created_by, o_orderkey % 3 = 0 AS is_public, 't' || CAST(o_custkey % 7 AS VARCHAR) AS tenant_id
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

WINS_SQL = """wins AS (
SELECT l_orderkey AS id, 'win' AS notice_type, p_name AS title,
  CASE WHEN l_partkey % 7 <> 0 THEN s_name ELSE '' END AS winner,
  CASE WHEN l_partkey % 11 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * 40 AS DECIMAL(15,2)) END AS budget_amount,
  CAST(l_shipdate AS TIMESTAMP) AS publish_date, n_name AS region_name, r_name AS region, p_type AS industry
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
