"""Sinks: JSON and CSV exports, and notices partitioned by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "publish_month"


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """With a header; quotes inside fields are doubled and every field is quoted."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_months(df: DataFrame, path: str, column: str = "publish_date") -> None:
    """Partitioned by month; months that the rows touch are replaced, others stay. Rows without a date go to their own partition."""
    keyed = df.withColumn(MONTH, F.date_format(column, "yyyy-MM"))
    keyed.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Rows of a closed range of months; other partitions are not read."""
    return spark.read.option("basePath", path).parquet(path).where(F.col(MONTH).cast("string").between(first, last))


def archive_months(spark: SparkSession, path: str, archive: str, before: str) -> None:
    """Copies the months before one to an archive, where they replace what is there."""
    old = spark.read.parquet(path).where(F.col(MONTH).cast("string") < before)
    old.withColumn(MONTH, F.col(MONTH).cast("string")).repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(archive)
