"""Winners compared: totals, rankings, trends, shares. A blank winner is no competitor unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stats import n, total
from .trends import month


def named(df: DataFrame, blank: bool = False) -> DataFrame:
    return df if blank else df.where("winner != ''")


def ranking(df: DataFrame, by: str = "win_count", limit: int = 10, blank: bool = False) -> DataFrame:
    """Top winners by win_count, total_amount or average_size; the average divides by all wins."""
    found = named(df, blank).groupBy("winner").agg(n(name="win_count"), total()).withColumn("average_size", F.col("total_amount") / F.col("win_count"))
    return found.orderBy(F.desc(by), "winner").limit(limit)


def at_least(df: DataFrame, wins: int) -> DataFrame:
    return named(df).groupBy("winner").agg(n(name="win_count")).where(F.col("win_count") >= wins)


def profile(df: DataFrame, winner: str) -> DataFrame:
    """One winner by month and by industry, as (kind, key): wins, amount, mean of the amounts there are."""
    own = df.where(F.col("winner") == winner)
    kinds = F.inline(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")), F.struct(F.lit("month").alias("kind"), month().alias("key")), F.struct(F.lit("industry").alias("kind"), F.col("industry").alias("key"))))
    grouped = own.select(kinds, "budget_amount").groupBy("kind", "key").agg(n(name="win_count"), total(), F.count("budget_amount").alias("priced"))
    return grouped.select("kind", "key", "win_count", "total_amount", F.coalesce(F.try_divide("total_amount", F.col("priced")), F.lit(0.0)).alias("average"))


def trend(df: DataFrame) -> DataFrame:
    """Per winner the direction of its monthly wins: the later half against the earlier one."""
    monthly = named(df).groupBy("winner", month().alias("month")).agg(n(name="wins"))
    place = F.row_number().over(W.partitionBy("winner").orderBy("month"))
    months = F.count(F.lit(1)).over(W.partitionBy("winner"))
    halves = monthly.select("winner", "wins", months.alias("months"), (place <= F.floor(months / 2)).alias("early"))
    sums = halves.groupBy("winner").agg(F.max("months").cast("bigint").alias("months"), F.sum(F.when(F.col("early"), F.col("wins")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("early"), F.col("wins")).otherwise(0)).alias("b"))
    direction = F.when(F.col("months") < 3, "insufficient_data").when(F.col("b") * 5 > F.col("a") * 6, "increasing").when(F.col("b") * 5 < F.col("a") * 4, "decreasing").otherwise("stable")
    return sums.select("winner", "months", direction.alias("direction"))


def benchmark(df: DataFrame) -> DataFrame:
    """Every winner against the market: shares of wins and amount in percent, mean amount over the market's."""
    own = named(df).groupBy("winner").agg(n(name="wins"), total(name="amount"), F.count("budget_amount").alias("priced"))
    market = df.agg(n(name="all_wins"), total(name="all_amount"), F.count("budget_amount").alias("all_priced"))
    both = own.join(F.broadcast(market))  # one row

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(a * 100.0, b), 2), F.lit(0.0))

    mean, mean_all = F.try_divide("amount", F.col("priced")), F.try_divide("all_amount", F.col("all_priced"))
    return both.select("winner", share(F.col("wins"), F.col("all_wins")).alias("share_count"), share(F.col("amount"), F.col("all_amount")).alias("share_amount"), F.coalesce(F.round(F.try_divide(mean, mean_all), 2), F.lit(1.0)).alias("mean_ratio"))


def concentration(df: DataFrame) -> DataFrame:
    """Wins of the top three as a part of those of the top ten, both by amount."""
    top = named(df).groupBy("winner").agg(n(name="win_count"), total()).orderBy(F.desc("total_amount"), "winner").limit(10)
    placed = top.withColumn("place", F.row_number().over(W.orderBy(F.desc("total_amount"), "winner")))
    return placed.agg(F.round(F.try_divide(F.sum(F.when(F.col("place") <= 3, F.col("win_count")).otherwise(0)).cast("double"), F.sum("win_count")), 4).alias("concentration"), n(name="competitors"))
