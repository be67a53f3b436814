"""Exact deduplication as a stateful stream; DataFrame functions only.

Files of documents are a stream. Its keyed state, on disk in RocksDB and copied to the shared checkpoint
folder, has no watermark and so never expires: per digest of the normalised text it retains the row that
stays (a stable identifier), where that row's text is (file and row of it, the content locator) and the
number of rows so far. Rows are combined per task before they are dealt out by digest, so a text that a
third of all rows share is one row a task. Files that come later go on from the same checkpoint.

A digest that is met again is a hit. Full bytes of all hits are checked: the distinct texts of each such
digest are held against the text found at the retained locator; if one differs, the digest's rows are
grouped by their bytes instead. So results do not rest on the digest being free of collisions.

Of equal texts that one stays which has the most code points before normalisation, then the smallest
doc_id (a null id last), then the first place among the files; so of repeated rows exactly one stays.
Defined results: a null text counts as empty; texts that are empty once white space is deleted form one
group; a null doc_id is kept or dropped like any other; other columns are not read, whatever their names;
an empty table gives an empty table. The locators need files, so the input is a path that Spark can read.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_dir, written

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
#: Bytes of files that one batch of the stream takes, by default; it bounds what a lost batch costs.
BATCH_BYTES = 1 << 40
#: Digests met more than once are broadcast up to this number (of 32 bytes each), else joined by shuffle.
BROADCAST_HITS = 500_000

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves megabytes of disk
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, normalised text and `at`: the order in which rows of equal texts are preferred, with id and locator."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit("")), BLANKS, text)
    doc_id, place = F.col(id_col).cast("bigint"), df.metadataColumn("_metadata")
    at = F.struct((-F.length(text)).alias("shorter"), doc_id.isNull().alias("none"), doc_id.alias("doc_id"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    return df.select(digest(norm).alias("digest"), norm.alias("norm"), at.alias("at"))


def absorb(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Takes all files below path that the checkpoint has not seen into its state; returns the state.

    Per digest: keeper (the struct `at` of the row that stays) and the number of rows, n. An interrupted
    run goes on where its checkpoint ends, and each file counts once.
    """
    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file will do as well as a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(files)
    state = rows(stream, id_col, text_col, digest).groupBy("digest").agg(F.min("at").alias("keeper"), F.count(F.lit(1)).alias("n"))
    with settings(spark, STATE_CONF):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        held = spark.read.format("statestore").load(checkpoint)
        return written(held.select("key.digest", F.col("value.min").alias("keeper"), F.col("value.count").alias("n")))


def collisions(texts: DataFrame, state: DataFrame) -> DataFrame:
    """Digests of hits of which some text differs from the one at the retained locator, byte by byte."""
    hits = state.where("n > 1").select("digest", "keeper")
    small = hits.count() <= BROADCAST_HITS
    met = texts.join(F.broadcast(hits) if small else hits, "digest")
    # equal texts are combined per task, so that one text a task is dealt out, by the text itself
    own = (F.col("at.file") == F.col("keeper.file")) & (F.col("at.row") == F.col("keeper.row"))
    distinct = met.groupBy("norm").agg(F.min("digest").alias("digest"), F.max(own).alias("retained"))
    return distinct.where(~F.col("retained")).select("digest").distinct()


def report(spark: SparkSession, path: str, state: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document of the files that the state has seen."""
    texts = rows(spark.read.parquet(path), id_col, text_col, digest)
    different = written(collisions(texts, state))
    narrow = texts.select("digest", "at", F.sha2("norm", 256).alias("text_sha256"))
    if different.isEmpty():
        placed = narrow.join(state, "digest")
    else:
        parted = texts.join(different, "digest")
        classes = parted.groupBy("norm").agg(F.min("at").alias("keeper"), F.count(F.lit(1)).alias("n"))
        parted = parted.join(classes, "norm").select("digest", "at", F.sha2("norm", 256).alias("text_sha256"), "keeper", "n")
        placed = narrow.join(different, "digest", "left_anti").join(state, "digest").unionByName(parted)
    kept = (F.col("at.file") == F.col("keeper.file")) & (F.col("at.row") == F.col("keeper.row"))
    return placed.select(F.col("at.doc_id").alias("doc_id"), F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")


def deduplicate(spark: SparkSession, path: str, checkpoint: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Takes in what is new below path, then reports every document. Without a checkpoint the state lasts for this call alone."""
    own = checkpoint or shared_dir(spark)
    state = absorb(spark, path, own, id_col, text_col, digest, batch_bytes)
    if not checkpoint:
        remove(spark, own)
    return report(spark, path, state, id_col, text_col, digest)
