"""Connected components of an edge table, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written_at


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that can be reached.

    Each round links larger neighbours, then smaller ones, to the least neighbour of a node; the number
    of rounds grows with the logarithm of the size of a component. Edges keep their number at most; those of the round before are deleted.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, larger: bool) -> DataFrame:
        both = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else df
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if larger:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        own = least.select("a", F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).where("a != b").distinct()

    now, path = written_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = state(now)
    while seen[0]:
        older = path
        now, path = written_at(star(star(now, larger=True), larger=False))
        remove(edges.sparkSession, older)
        after = state(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
