"""Upserts, inserts and duplicate checks against stored tables, and cutting of lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share. Where none is named, a local session gets one of its own; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints/procura"
    return f"{base.rstrip('/')}/procura-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the folder all executors share and reads it again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by an order that has no ties."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def upsert(stored: DataFrame, news: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Stored rows whose key is not among the news, and the last of the news of each key."""
    news = latest(news, keys, order)
    return stored.join(news.select(*keys), keys, "left_anti").unionByName(news)


def insert_new(stored: DataFrame, news: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """News whose key is not stored, one row a key."""
    return latest(news, [key], order).join(stored.select(key), key, "left_anti")


def replace_children(parents: DataFrame, children: DataFrame, news: DataFrame, key: str, items: str) -> DataFrame:
    """Children of touched parents are replaced by the elements of an array column, numbered by place."""
    fresh = news.select(key, F.posexplode(items).alias("sort_order", "item"))
    return children.join(news.select(key), key, "left_anti").unionByName(fresh.select(*children.columns)).join(parents.select(key), key, "left_semi")


def known(news: DataFrame, stored: DataFrame) -> DataFrame:
    """News with the reason why they are known: their link, or their title on the same site; null if they are new."""
    links = stored.select(F.col("source_url").alias("__url")).distinct()
    titles = stored.select(F.col("title").alias("__title"), F.col("source_site").alias("__site")).distinct()
    found = news.join(links, F.col("source_url") == F.col("__url"), "left")
    found = found.join(titles, (F.col("title") == F.col("__title")) & (F.col("source_site") == F.col("__site")), "left")
    reason = F.when(F.col("__url").isNotNull(), "url").when(F.col("__title").isNotNull(), "title_site")
    return found.withColumn("reason", reason).drop("__url", "__title", "__site")
