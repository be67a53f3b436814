"""Dashboard aggregates. Counts are bigint, sums are exact decimals that end as double, buckets always appear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import ranges

UNKNOWN = "未知"
#: Labelled lower bounds of amount buckets; each reaches to the next one.
FIVE = (("0-10万", 0), ("10-50万", 100_000), ("50-100万", 500_000), ("100-500万", 1_000_000), ("500万+", 5_000_000))
SIX = (("0-10万", 0), ("10-50万", 100_000), ("50-100万", 500_000), ("100-500万", 1_000_000), ("500-1000万", 5_000_000), ("1000万以上", 10_000_000))


def n(condition: Column | None = None, name: str = "count") -> Column:
    return (F.count(F.lit(1)) if condition is None else F.count_if(condition)).cast("bigint").alias(name)


def total(column: str = "budget_amount", name: str = "total_amount") -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("double").alias(name)


def bucket(amount: Column, bounds: tuple) -> Column:
    """Label of the bucket of an amount; null for null and negative amounts."""
    out = F.when(F.lit(False), F.lit(""))
    for label, low in reversed(bounds):
        out = out.when(amount >= low, label)
    return out


def known(column: str) -> Column:
    """Blank and null as unknown."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNKNOWN))


def overview(df: DataFrame, as_of: str) -> DataFrame:
    """Count, amount, tenderers, amount per row (rows without amount included), rows of today, this ISO week and month."""
    now = F.to_timestamp(F.lit(as_of))
    day = F.date_trunc("day", F.col("publish_date"))
    return df.agg(
        n(name="total_count"), total(),
        F.count_distinct(F.nullif(F.col("tenderer"), F.lit(""))).cast("bigint").alias("unique_tenderers"),
        F.coalesce(F.sum("budget_amount").cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("average_amount"),
        n(day == F.date_trunc("day", now), "today_count"),
        n(F.col("publish_date") >= F.date_trunc("week", now), "week_count"),
        n(F.col("publish_date") >= F.date_trunc("month", now), "month_count"),
    )


def group_counts(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(n())


def classification(df: DataFrame) -> DataFrame:
    """Counts by tenderer, region, industry and amount bucket, as (kind, key, count), in one pass by grouping sets."""
    keyed = df.select(known("tenderer").alias("tenderer"), known("region_name").alias("region"), known("industry").alias("industry"), F.coalesce(bucket(F.col("budget_amount"), SIX), F.lit(UNKNOWN)).alias("amount"))
    kinds = ["tenderer", "region", "industry", "amount"]
    grouped = keyed.groupingSets([[F.col(k)] for k in kinds], *(F.col(k) for k in kinds)).agg(n(), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, kinds[0]).when(F.col("g") == 11, kinds[1]).when(F.col("g") == 13, kinds[2]).otherwise(kinds[3])
    return grouped.select(kind.alias("kind"), F.coalesce(*kinds).alias("key"), "count")


def distribution(df: DataFrame, bounds: tuple, column: str = "budget_amount") -> DataFrame:
    """Every bucket with its count and its share of the rows in buckets, in one aggregation."""
    label = bucket(F.col(column), bounds)
    counts = df.agg(*(n(label == name, f"b{i}") for i, (name, _) in enumerate(bounds)))
    every = sum((F.col(f"b{i}") for i in range(len(bounds))), F.lit(0))
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("range"), F.col(f"b{i}").alias("count"), F.coalesce(F.try_divide(F.col(f"b{i}").cast("double"), every.cast("double")), F.lit(0.0)).alias("ratio")) for i, (name, _) in enumerate(bounds)))
    return counts.select(F.inline(rows))


def daily(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows per day of a closed range; days without rows are left out."""
    day = F.to_date(column)
    return df.where(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(n())


def daily_filled(spark: SparkSession, df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """The same with a row for every day."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return days.join(daily(df, column, start, end), "day", "left").select("day", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def ranked_shares(df: DataFrame, key: Column, many: bool = False) -> DataFrame:
    """Key, count, amount, share of all rows and rank; ties are ranked by key. `many` is for keys without bound: no window holds all groups."""
    grouped = df.groupBy(key.alias("key")).agg(n(), total())
    order = [F.desc("count"), F.col("key")]
    if many:
        every = ranges.running(ranges.ranks(grouped, order), [], order, F.col("count"), "__upto", "every")
        return every.select("key", "count", "total_amount", (F.col("count").cast("double") / F.col("every").cast("double")).alias("ratio"), "rank")
    every = F.sum("count").over(W.partitionBy())
    return grouped.select("key", "count", "total_amount", (F.col("count").cast("double") / every.cast("double")).alias("ratio"), F.row_number().over(W.orderBy(*order)).cast("bigint").alias("rank"))


def periods(df: DataFrame, column: str = "publish_date") -> DataFrame:
    """Counts and amounts by month, quarter and year, as (kind, period); rows without a date are left out."""
    c = F.col(column)
    names = F.array(
        F.struct(F.lit("month").alias("kind"), F.date_format(c, "yyyy-MM").alias("period")),
        F.struct(F.lit("quarter").alias("kind"), F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string")).alias("period")),
        F.struct(F.lit("year").alias("kind"), F.year(c).cast("string").alias("period")),
    )
    # months first: the small result is what is counted again by quarter and year
    monthly = df.where(c.isNotNull()).groupBy(F.date_trunc("month", c).alias(column)).agg(n(name="c"), F.sum("budget_amount").alias("s"))
    return monthly.select(F.inline(names), "c", "s").groupBy("kind", "period").agg(F.sum("c").cast("bigint").alias("count"), F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("total_amount"))


def by_kind(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(kind, key) pairs of every row with its amount; null keys are left out."""
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, key in kinds.items()))
    return df.select(F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("p"), "budget_amount").select("p.kind", "p.key", "budget_amount")


def service_overview(df: DataFrame, most: int = 10) -> DataFrame:
    """Totals, and the most frequent statuses, regions and industries; blank regions and industries are left out."""
    kinds = {"status": F.col("status"), "region": F.nullif(F.col("region"), F.lit("")), "industry": F.nullif(F.col("industry"), F.lit(""))}
    grouped = by_kind(df, kinds).groupBy("kind", "key").agg(n(), total())
    top = grouped.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("count"), "key"))).where(F.col("r") <= most).drop("r")
    totals = by_kind(df.withColumn("all", F.lit("all")).withColumn("active", F.when(F.col("status") == "active", "active")), {"a": F.col("all"), "b": F.col("active")})
    return top.unionByName(totals.groupBy(F.lit("total").alias("kind"), "key").agg(n(), total()))


def profile(df: DataFrame, latest: int = 10) -> DataFrame:
    """Counts, amounts and averages in all and by industry, region and month, and the latest rows by themselves."""
    kinds = {"total": F.lit("all"), "industry": F.col("industry"), "region": F.col("region"), "month": F.date_format("created_at", "yyyy-MM")}
    average = F.coalesce(F.round(F.sum("budget_amount").cast("double") / F.count("budget_amount"), 4), F.lit(0.0)).alias("average")
    grouped = by_kind(df, kinds).groupBy("kind", "key").agg(n(), total(), average)
    amount = F.coalesce(F.col("budget_amount").cast("double"), F.lit(0.0))
    rows = df.orderBy(F.desc("publish_date"), "id").limit(latest).select(F.lit("recent").alias("kind"), F.col("id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("count"), amount.alias("total_amount"), F.round(amount, 4).alias("average"))
    return grouped.unionByName(rows)


def dashboard(df: DataFrame, page: int = 10) -> DataFrame:
    """Sections overview, region, industry, month and latest as (section, key, value)."""
    whole = df.agg(F.count(F.lit(1)).cast("double").alias("notices"), F.sum("budget_amount").cast("double").alias("amount"), F.count_distinct(F.nullif(F.col("tenderer"), F.lit(""))).cast("double").alias("tenderers"))
    facts = whole.select(F.inline(F.array(*(F.struct(F.lit("overview").alias("section"), F.lit(c).alias("key"), F.col(c).alias("value")) for c in whole.columns))))
    counts = by_kind(df, {"region": F.col("region"), "industry": F.col("industry"), "month": F.date_format("publish_date", "yyyy-MM")}).groupBy(F.col("kind").alias("section"), "key").agg(F.count(F.lit(1)).cast("double").alias("value"))
    latest = df.where("status = 'active'").orderBy(F.desc("publish_date"), "id").limit(page).select(F.lit("latest").alias("section"), F.col("id").cast("string").alias("key"), F.coalesce(F.col("budget_amount").cast("double"), F.lit(0.0)).alias("value"))
    return facts.unionByName(counts).unionByName(latest)
