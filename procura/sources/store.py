"""Stored tables in hash buckets, of which a batch rewrites only the buckets that it touches.

A table is a folder of Parquet files partitioned by `bucket`, a hash of one column. A batch names the keys
whose rows go and the rows that come; the buckets of both are read, merged into the shared folder and put
back by dynamic overwrite, so files of other buckets keep their names. A batch that failed on its way can
be run again: what it takes away and adds is the same. The driver sees bucket numbers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import written

BUCKETS = 64


def bucket_of(by: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")


def put(df: DataFrame, path: str, mode: str) -> None:
    # a bucket with many rows is written by several tasks
    df.hint("rebalance", "bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create(df: DataFrame, path: str, by: str, buckets: int = BUCKETS) -> None:
    """Writes a table anew, in buckets of the column `by`."""
    put(df.withColumn("bucket", bucket_of(F.col(by), buckets)), path, "errorifexists")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def numbers(df: DataFrame) -> set[int]:
    """At most as many as there are buckets."""
    return {r[0] for r in df.select("bucket").distinct().collect()}


def merge(spark: SparkSession, path: str, gone: DataFrame, news: DataFrame, key: list[str], by: str, buckets: int = BUCKETS) -> set[int]:
    """Rows whose key is among `gone` (columns key and by) go, rows of `news` come; returns the buckets rewritten.

    A row that goes is looked for in the bucket of the `by` that `gone` gives for it.
    """
    numbered = written(gone.select(*key, by).withColumn("bucket", bucket_of(F.col(by), buckets)).select(*key, "bucket").distinct())
    news = written(news.withColumn("bucket", bucket_of(F.col(by), buckets)))
    touched = numbers(numbered) | numbers(news)
    if not touched:
        return touched
    old = read(spark, path)
    kept = old.where(F.col("bucket").isin(sorted(touched))).join(numbered, [*key, "bucket"], "left_anti")
    merged = written(kept.select(*old.columns).unionByName(news.select(*old.columns)))
    put(merged, path, "overwrite")
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    for empty in touched - numbers(merged):
        files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(files, f"bucket={empty}"), True)
    return touched
