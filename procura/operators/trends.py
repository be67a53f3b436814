"""Budget and volume trends, period comparison, forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stats import n, total


def month(column: str = "publish_date") -> Column:
    return F.date_format(column, "yyyy-MM")


def percent(now: Column, before: Column) -> Column:
    """Change in percent with two decimals; null where there is nothing positive before."""
    return F.when(before > 0, F.round((now - before) / before * 100, 2))


def budget_trend(df: DataFrame) -> DataFrame:
    """Per month with amounts: total, mean, rows, and growth over the month before that is present."""
    monthly = df.where("budget_amount is not null and publish_date is not null").groupBy(month().alias("month")).agg(total(name="total"), n())
    before = F.lag("total").over(W.orderBy("month"))
    return monthly.select("month", "total", (F.col("total") / F.col("count")).alias("average"), "count", percent(F.col("total"), before).alias("growth"))


def volume_trend(df: DataFrame) -> DataFrame:
    kind = F.col("notice_type")
    return df.where("publish_date is not null").groupBy(month().alias("month")).agg(n(kind == "bidding", "bidding"), n(kind == "win", "win"), n(name="total"))


def breakdown(df: DataFrame, name: str, code: str | None = None) -> DataFrame:
    """Per name (else code, else Unknown): rows, amount, amount per row."""
    keys = [F.nullif(F.col(c), F.lit("")) for c in (name, code) if c]
    return df.groupBy(F.coalesce(*keys, F.lit("Unknown")).alias("key")).agg(n(), total()).withColumn("average", F.col("total_amount") / F.col("count"))


def compare(df: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two half-open ranges in one pass: counts, sums, means and their changes."""
    c = F.col("publish_date")
    inside = [(c >= F.to_timestamp(F.lit(a))) & (c < F.to_timestamp(F.lit(b))) for a, b in (first, second)]
    sums = [F.coalesce(F.sum(F.when(w, F.col("budget_amount"))), F.lit(0)).cast("double").alias(f"sum{i}") for i, w in enumerate(inside, 1)]
    out = df.agg(*(n(w, f"count{i}") for i, w in enumerate(inside, 1)), *sums, *(n(w & F.col("budget_amount").isNotNull(), f"priced{i}") for i, w in enumerate(inside, 1)))
    for i in (1, 2):
        out = out.withColumn(f"average{i}", F.coalesce(F.try_divide(F.col(f"sum{i}"), F.col(f"priced{i}")), F.lit(0.0)))
    return out.select("count1", "count2", "sum1", "sum2", "average1", "average2", *(percent(F.col(f"{x}2"), F.col(f"{x}1")).alias(f"{x}_change") for x in ("count", "sum", "average")))


def bins(df: DataFrame, as_of: str, parts: int = 12, days: int = 30, span: int = 365) -> DataFrame:
    """Amounts in bins of days from as_of - span on, zero-filled; what lies after the last bin is left out."""
    start = F.timestamp_add("DAY", F.lit(-span), F.to_timestamp(F.lit(as_of)))
    place = F.floor((F.unix_seconds("publish_date") - F.unix_seconds(start)) / (86400 * days)).cast("bigint")
    found = df.where(F.col("publish_date") >= start).groupBy(place.alias("bin")).agg(total(name="value")).where(F.col("bin").between(0, parts - 1))
    every = df.sparkSession.range(parts).select(F.col("id").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("value", F.lit(0.0)).alias("value"))


def forecast(series: DataFrame, steps: int) -> DataFrame:
    """Least-squares line over (bin, value) at the next steps, not below zero, and how steady the series is.

    Sums are taken in decimal, so the result does not depend on the order of adding.
    """
    x, y = F.col("bin").cast("decimal(20,0)"), F.col("value").cast("decimal(30,4)")
    s = series.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).cast("double").alias("sx"), F.sum(y).cast("double").alias("sy"),
        F.sum((x * y).cast("decimal(38,4)")).cast("double").alias("sxy"), F.sum(x * x).cast("double").alias("sxx"),
        F.stddev_samp("value").alias("sd"),
    )
    slope = F.coalesce(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")), F.lit(0.0))
    s = s.withColumn("slope", slope).withColumn("mean", F.col("sy") / F.col("n"))
    level = F.col("mean") - F.col("slope") * F.col("sx") / F.col("n")
    steady = F.when((F.col("n") < 3) | (F.col("mean") == 0), 0.5).otherwise(F.least(F.greatest(1 - F.try_divide(F.col("sd"), F.col("mean")), F.lit(0.1)), F.lit(0.95)))
    return s.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(steps).cast("bigint"))).alias("step"), "n", "slope", level.alias("level"), steady.alias("confidence")).select(
        "step", F.round(F.greatest(F.col("level") + F.col("slope") * (F.col("n") + F.col("step") - 1), F.lit(0.0)), 2).alias("predicted"), F.round("confidence", 6).alias("confidence")
    )
