"""A corpus pipeline of five stages; each works on all rows that the one before it kept.

Toxic documents go, one document of each near-duplicate class stays, repeated strings of 100 bytes and
more are taken out, secrets are masked, and what is left is packed into token sequences. All stages but
the last return the columns of documents. Rows with null or empty texts pass as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm import packing, secrets, simhash, suffix_dedup, toxicity
from procura.llm.common import crc_bucket, documents, remove, written_at
from procura.llm.queries import owner_and_repository

#: Text operators of the stages go by a model, connected classes and repeated strings: SQL can't express them.
ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(documents(docs), labels, only=crc_bucket(F.col("doc_id"), 4) != 2)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(suffix_dedup.deduplicate(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(secrets.redact(docs, *owner_and_repository()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again, and deleted once the next one's is there."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        older = path
        docs, path = written_at(stage(spark, docs, sf_dir))
        if older:
            remove(spark, older)
    return STAGES[-1][1](spark, docs, sf_dir)
