"""A few figures of the market on one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import competitors, scoring, trends


def since(as_of: str, days: int) -> Column:
    return F.col("publish_date") >= F.timestamp_add("DAY", F.lit(-days), F.to_timestamp(F.lit(as_of)))


def quick(bids: DataFrame, wins: DataFrame, as_of: str, week: int = 7, span: int = 90, limit: int = 5) -> DataFrame:
    """Opportunities of the week and the amount of the best one, the winner of most, and of the span the direction of amounts and the industry of most.

    Without opportunities the amount is 0, without two months the direction is stable, without notices the industry is N/A.
    """
    found = scoring.opportunities(bids.where(since(as_of, week)), as_of, None, limit)
    best = F.max_by(F.coalesce(F.col("budget_amount").cast("double"), F.lit(0.0)), F.struct("score", -F.col("id")))
    recent = bids.where(since(as_of, span))
    first, last = F.min_by("total", "month"), F.max_by("total", "month")
    parts = [
        found.agg(F.count(F.lit(1)).alias("new_opportunities"), best.alias("top_value")),
        competitors.ranking(wins, limit=1).select(F.col("winner").alias("top_competitor")),
        trends.budget_trend(recent).agg(F.when(F.count(F.lit(1)) < 2, "stable").when(last > first, "up").otherwise("down").alias("market_trend")),
        trends.breakdown(recent, "industry", "industry_code").orderBy(F.desc("total_amount"), "key").limit(1).select(F.col("key").alias("hot_industry")),
    ]
    rows = parts[0]
    for part in parts[1:]:  # one row each, brought together by an aggregate of four rows
        rows = rows.unionByName(part, allowMissingColumns=True)
    one = rows.agg(*(F.max(c).alias(c) for c in rows.columns))
    return one.withColumn("top_value", F.coalesce("top_value", F.lit(0.0))).withColumn("hot_industry", F.coalesce("hot_industry", F.lit("N/A")))
