"""Stored tables in buckets: what a batch rewrites, and search vectors kept up by changed rows."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from procura.operators import search, vectors
from procura.sources import store

SCHEMA = "id bigint, title string, description string, tenderer string"


def files(path: str) -> dict[str, set[str]]:
    """Names of the files of each bucket."""
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in Path(path).glob("bucket=*")}


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "table")
    store.create(spark.range(1000).select("id", (F.col("id") * 2).alias("v")), path, "id", 32)
    before = files(path)
    news = spark.createDataFrame([(3, -1), (5, -1), (2000, -1)], "id bigint, v bigint")
    touched = store.merge(spark, path, news, news, ["id"], "id", 32)
    after = files(path)
    assert 1 <= len(touched) <= 3
    assert {b for b in after if after[b] != before.get(b)} == {f"bucket={n}" for n in touched}
    want = sorted([(i, -1 if i in (3, 5) else 2 * i) for i in range(1000)] + [(2000, -1)])
    assert rows_of(store.read(spark, path), "id", "v") == want
    store.merge(spark, path, news, news, ["id"], "id", 32)  # again, as after a failure
    assert rows_of(store.read(spark, path), "id", "v") == want


def test_a_bucket_may_become_empty(spark, tmp_path):
    path = str(tmp_path / "table")
    table = spark.range(40).select("id", F.lit("x").alias("v"))
    store.create(table, path, "id", 8)
    own = [r[0] for r in store.read(spark, path).where("bucket = 3").select("id").collect()]
    gone = spark.createDataFrame([(i,) for i in own], "id bigint")
    store.merge(spark, path, gone, table.limit(0), ["id"], "id", 8)
    assert "bucket=3" not in files(path) and rows_of(store.read(spark, path), "id") == [(i,) for i in range(40) if i not in own]
    assert store.merge(spark, path, gone.limit(0), table.limit(0), ["id"], "id", 8) == set()


def notices(spark, changed=()):
    r = [(i, f"word{i} common" + (" fresh" if i in changed else ""), f"about word{i % 50}" if i % 3 else None, "Tenderer é" if i % 2 else "") for i in range(400)]
    return spark.createDataFrame(r, SCHEMA)


@pytest.mark.parametrize("query", ["common", "word7", "FRESH & word8", "about word7", "absent", "tenderer", "  "])
def test_search_of_vectors_is_the_plain_search(spark, vector_index, query):
    path, now = vector_index
    assert rows_of(vectors.ranked(spark, path, query, buckets=64), "id", "rank") == rows_of(search.ranked(now, query), "id", "rank")


@pytest.fixture(scope="module")
def vector_index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    vectors.build(notices(spark), path)
    now = notices(spark, changed=(8, 9, 77, 200))
    vectors.update(now.where(F.col("id").isin(8, 9, 77, 200)), path)
    return path, now


def test_changes_touch_the_buckets_of_their_words(spark, tmp_path):
    path = str(tmp_path / "index")
    old = notices(spark)
    vectors.build(old, path)
    posted = vectors.folders(path)[0]
    before = files(posted)
    row = spark.createDataFrame([(8, "word8 fresh", "about word8", "")], SCHEMA)
    touched = vectors.update(row, path)
    after = files(posted)
    words = {"word8", "common", "about", "fresh"}
    wanted = {r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(store.bucket_of(F.col("w"))).collect()}
    assert touched == wanted and {b for b in after if after[b] != before.get(b)} <= {f"bucket={n}" for n in wanted}
    assert len(before) - len(wanted) > 50
    vectors.update(old.limit(0), path, deleted=spark.createDataFrame([(8,)], "id bigint"))
    assert store.read(spark, posted).where("id = 8").count() == 0


def test_tenderers_count_when_asked_for(spark, vector_index):
    path, _ = vector_index
    got = rows_of(vectors.ranked(spark, path, "tenderer", weights={"C": 0.2}), "id", "rank")
    assert got == [(i, round(1 / 3 * 0.2, 6)) for i in range(1, 400, 2)]
