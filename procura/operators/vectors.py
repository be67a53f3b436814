"""Stored search vectors: an inverted index that changed rows alone keep up, and searches answered from it.

A posting says how often a word stands in the fields of one weight of one row, and how many words those
fields have. Postings lie in buckets by a hash of their word, so a search reads the buckets of its terms,
and a batch of changed rows rewrites the buckets of words that these rows had or have. What words a row
had is kept beside the postings, in buckets by a hash of its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from .search import normalise, tokens

#: Fields by weight class, and what a class counts in a rank.
CLASSES = {"A": ("title",), "B": ("description",), "C": ("tenderer", "project_name")}
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def postings(df: DataFrame, key: str, classes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(word, key, weight, hits, length) of every word of every row; fields that the table lacks are blank."""
    own = {w: [f for f in fields if f in df.columns] for w, fields in (classes or CLASSES).items()}
    parts = []
    for weight, fields in own.items():
        if fields:
            words = reduce(F.concat, (tokens(f) for f in fields))
            parts.append(df.select(F.col(key), F.lit(weight).alias("weight"), words.alias("words")))
    every = reduce(DataFrame.unionByName, parts)
    every = every.select(key, "weight", F.size("words").alias("length"), F.explode("words").alias("word"))
    return every.groupBy("word", key, "weight", "length").agg(F.count(F.lit(1)).cast("int").alias("hits")).select("word", key, "weight", "hits", "length")


def folders(path: str) -> tuple[str, str]:
    return f"{path}/postings", f"{path}/words"


def words_of(posted: DataFrame, key: str) -> DataFrame:
    return posted.groupBy(key).agg(F.collect_set("word").alias("words"))


def build(df: DataFrame, path: str, key: str = "id", classes: dict[str, tuple[str, ...]] | None = None, buckets: int = store.BUCKETS) -> None:
    """Writes the index of a whole table."""
    posted, held = folders(path)
    store.create(postings(df, key, classes), posted, "word", buckets)
    store.create(words_of(store.read(df.sparkSession, posted), key), held, key, buckets)


def update(df: DataFrame, path: str, key: str = "id", classes: dict[str, tuple[str, ...]] | None = None, buckets: int = store.BUCKETS, deleted: DataFrame | None = None) -> set[int]:
    """Takes in changed and new rows (whole rows, one a key) and keys of deleted ones; returns the buckets of words that it rewrote."""
    spark = df.sparkSession
    posted, held = folders(path)
    news = store.written(postings(df, key, classes))
    changed = df.select(key) if deleted is None else df.select(key).unionByName(deleted.select(key))
    changed = store.written(changed.distinct().withColumn("bucket", store.bucket_of(F.col(key), buckets)))
    # the keys' own buckets are few; the words of other rows are not read
    near = store.read(spark, held).where(F.col("bucket").isin(sorted(store.numbers(changed))))
    had = near.join(changed.select(key), key, "left_semi").select(key, F.explode("words").alias("word"))
    touched = store.merge(spark, posted, had, news, [key], "word", buckets)
    store.merge(spark, held, changed.select(key), words_of(news, key), [key], key, buckets)
    return touched


def ranked(spark: SparkSession, path: str, query: str, key: str = "id", weights: dict[str, float] | None = None, buckets: int = store.BUCKETS) -> DataFrame:
    """(key, rank) of rows that hold every term in fields of the weights, from the postings of the terms alone."""
    terms, weights = sorted(set(normalise(query))), {w: WEIGHTS[w] for w in "AB"} if weights is None else weights
    found = store.read(spark, folders(path)[0])
    numbers = spark.range(1).select(*(store.bucket_of(F.lit(t), buckets).alias(f"b{i}") for i, t in enumerate(terms))).first()  # of the terms, worked out by the engine that wrote them
    found = found.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("word").isin(terms) & F.col("weight").isin(list(weights)))
    share = sum((F.coalesce(F.sum(F.when(F.col("weight") == w, F.col("hits"))) / (F.max(F.when(F.col("weight") == w, F.col("length"))) + 1), F.lit(0.0)) * x for w, x in weights.items()), F.lit(0.0))
    rows = found.groupBy(key).agg(F.count_distinct("word").alias("terms"), F.round(share, 6).alias("rank"))
    return rows.where(F.col("terms") == max(len(terms), 1)).select(key, "rank")
