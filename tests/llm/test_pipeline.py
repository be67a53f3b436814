"""Stages of the corpus pipeline against plain restatements, one after the other on what the last one kept."""

from __future__ import annotations

import hashlib
import os
import re
import shutil

import corpus_pipeline
import public_tokenizers
import pytest
from fixtures import rows, words
from test_packing import check
from test_secrets import base_spans
from test_simhash import plain_classes, plain_print
from test_suffix_dedup import plain
from tokenizers import Tokenizer

from procura.llm import toxicity
from procura.llm.common import crc_bucket, documents, written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage was given and returned; test tables with odd rows added."""
    import random

    r = random.Random(11)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    passage = words(r, 80)
    odd = [(10**6 + i if k is not None else None, t, a, b, c) for i, (k, t, a, b, c, *_) in enumerate(rows())]
    odd += [(2 * 10**6 + i, words(r, 40) + " " + passage + f" token=abcdefghijkl{i}Z9 " + words(r, 40), "en", "srcX", 9) for i in range(4)]
    first = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint").select(*docs.columns))
    held = [written(first)]
    for _, stage in corpus_pipeline.STAGES:
        held.append(written(stage(spark, held[-1], sf_dir)))
    return held


def test_columns(spark, sf_dir, stages):
    documents_columns = spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
    assert all(df.dtypes == documents_columns for df in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "secret_scans", "packing"]


def test_toxic_documents_go(spark, sf_dir, stages):
    from pyspark.sql import functions as F

    model = toxicity.train(documents(stages[0]), spark.read.parquet(f"{sf_dir}/labels.parquet"), only=crc_bucket(F.col("doc_id"), 4) != 2)
    want = sorted((r["doc_id"] for r in toxicity.score(stages[0], model).collect() if r["score"] < 0.3), key=repr)
    assert sorted((r["doc_id"] for r in stages[1].collect()), key=repr) == want


def test_one_of_each_class(stages):
    prints = [(r["doc_id"], plain_print(r["text"])) for r in stages[1].collect()]
    assert sorted((r["doc_id"] for r in stages[2].collect()), key=repr) == sorted(set(plain_classes(prints, 4).values()), key=repr)


def test_repeats_are_cut(stages):
    before = sorted((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["text"] or "") for r in stages[2].collect())
    sizes = {(i, n, removed, digest) for i, n, removed, _, digest in plain(before)}
    after = {r["doc_id"] if r["doc_id"] is not None else -(2**63): r for r in stages[3].collect()}
    assert after.keys() == {i for i, _ in before}
    for i, n, removed, digest in sizes:
        text = after[i]["text"] or ""
        if text.isascii():  # a cut can fall inside a letter of several bytes, whose rest goes too
            assert len(text.encode()) == n - removed and hashlib.sha256(text.encode()).hexdigest() == digest
        assert after[i]["n_chars"] == (len(text) if after[i]["text"] is not None else None)
    assert sum(removed > 0 for _, _, removed, _ in sizes) >= 3


def test_secrets_are_masked(stages):
    before = {r["doc_id"]: r["text"] or "" for r in stages[3].collect()}
    after = {r["doc_id"]: r["text"] or "" for r in stages[4].collect()}
    assert before.keys() == after.keys()
    masked = 0
    for i, text in before.items():
        found = base_spans(text)
        masked += bool(found)
        if not found and "[SECRET]" not in after[i]:
            assert after[i] == text
        assert all(text[s:e] not in after[i] for _, s, e in found)
    assert masked >= 4


def test_all_is_packed(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(r["doc_id"], r["text"]) for r in stages[4].collect()]
    check(stages[5].collect(), 2048, stages[4].rdd.getNumPartitions(), texts, library)


def test_run_is_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name in ("labels",):
        shutil.copy(os.path.join(sf_dir, f"{name}.parquet"), tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_nothing_else_is_needed():
    """The rest of the library imports without this subpackage."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    for path in (root / "procura").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path
    code = "import sys; sys.modules['procura.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


