"""Ranks, running sums and trailing windows without a window that holds all rows, or all rows of a key.

Rows are dealt out by ranges of their order (Spark samples the bounds) and written, so that a row's range is
settled; sums of whole ranges, a row for each range and key, say what comes before a range; windows run inside
ranges alone. So one key with all rows is spread over all tasks. Orders must end in what tells rows apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import written

#: Buckets of time are this many times as long as the windows that look back from their rows.
WINDOWS = 64


def dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with the number of their range; ranges follow the order."""
    return written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[Column], weight: Column, upto: str = "upto", total: str = "total") -> DataFrame:
    """Adds the sum of a weight over the rows of a key up to and with a row, and over all of its rows."""
    rows = dealt(df.withColumn("__weight", weight), [*(F.col(k) for k in keys), *order])
    named = [f"__key{i}" for i in range(len(keys))]
    sums = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col("__range").alias("__of")).agg(F.sum("__weight").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy(*named).orderBy("__of").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*named, "__of", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__sum").over(W.partitionBy(*named)).alias(total))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)), F.col("__range") == F.col("__of"))
    within = F.sum("__weight").over(W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("__within", within).join(sums, same).withColumn(upto, F.col("__before") + F.col("__within")).select(*df.columns, upto, total)


def ranks(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place in the order, from 1."""
    return running(df, [], order, F.lit(1).cast("bigint"), name, "__total").drop("__total")


def page_rows(df: DataFrame, order: list[Column], page: int, size: int, clamp: bool = True) -> DataFrame:
    """Rows of a page however deep it lies: only the ranges that hold it are put in order.

    A page beyond the last gives the last one, or none without clamp; one before the first gives the first.
    The driver sees the number of rows of each range.
    """
    rows = dealt(df, order)
    counts = {r["__range"]: r["n"] for r in rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    last = max(1, -(-total // size))
    page = max(1, min(page, last) if clamp else page)
    first, end = (page - 1) * size, page * size
    at, held, skipped = 0, [], 0
    for number in sorted(counts):
        if at < end and at + counts[number] > first:
            skipped = at if not held else skipped
            held.append(number)
        at += counts[number]
    return rows.where(F.col("__range").isin(held)).orderBy(*order).offset(max(first - skipped, 0)).limit(size).select(*df.columns)


def trailing(df: DataFrame, keys: list[str], ts: str, seconds: int, name: str = "recent") -> DataFrame:
    """Adds the number of rows of the same keys in the seconds up to and with a row's time.

    Windows run over buckets of time; a row near the end of its bucket is lent to the next one. Rows without a
    time count themselves and the others of their keys without one.
    """
    span = seconds * 1_000_000
    size = span * WINDOWS
    at = F.unix_micros(ts)
    own = F.floor(at / size).cast("bigint")
    lent = F.when((own + 1) * size - at <= span, F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own")), F.struct((own + 1).alias("bucket"), F.lit(False).alias("own"))))
    rows = df.withColumn("__at", at).withColumn("__b", F.explode(F.coalesce(lent, F.array(F.struct(own.alias("bucket"), F.lit(True).alias("own"))))))
    recent = F.count(F.lit(1)).over(W.partitionBy(*keys, "__b.bucket").orderBy("__at").rangeBetween(-span, 0))
    return rows.withColumn(name, recent).where("__b.own").select(*df.columns, name)
