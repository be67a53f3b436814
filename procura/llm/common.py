"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are cut so that one slice holds about this many bytes.
SLICE_BYTES = 8 << 20


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as (doc_id bigint, text string with null read as empty)."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one all executors share. Where none is named, a local session gets one of its own; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints/procura"
    return f"{base.rstrip('/')}/procura-{uuid.uuid4().hex}"


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it again: it cuts the lineage and survives lost executors. The folder can be removed when the table is no longer read."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return written_at(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice has about `limit` bytes, one row at least."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * limit / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies fn to bounded slices of Arrow batches; it moves no rows between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


_state: dict[tuple, object] = {}


def held(*key, make: Callable[[], object]):
    """What a worker keeps between its tasks: one thing at a time, so that operators that run one after another don't add up."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys from a partition sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        at = 0
        while at < n:
            to = at + 1
            while to < n and marks[to] == marks[at]:
                to += 1
            if marks[at] != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = marks[at]
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield held_key, pa.Table.from_batches(held)
