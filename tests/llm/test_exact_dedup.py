"""Streaming exact deduplication against a plain restatement, in batches, after restarts and with colliding digests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from fixtures import frame, rows
from pyspark.sql import functions as F

from procura.llm import exact_dedup

BLANK = re.compile("[\x20\x09-\x0d]")


def plain(data) -> Counter:
    """(doc_id, keep_id, group_size, kept, sha256) of rows (doc_id, text, ...)."""
    groups: dict[str, list] = {}
    for doc_id, text, *_ in data:
        groups.setdefault(BLANK.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out: Counter = Counter()
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for place, m in enumerate(members):
            out[m[3], members[0][3], len(members), place == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def found(df) -> Counter:
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def more_rows() -> list[tuple]:
    """Spaced copies, ties in length, a copy that is longer but has a larger id, and a group of hundreds."""
    texts = [(200, "a b c"), (201, "abc"), (202, "a  b c "), (199, "a bc "), (203, "A b c"), (204, "a\x0bb\x0cc\r\n\t "), (205, "a\xa0bc"), (206, "a\x1cb c"), (None, "a  b c ")]
    return rows() + [(i, t, "en", "src0", 1, "x", 1, 1, None) for i, t in texts] + [(1000 + i, "hot  text" if i % 3 else "hot text", "en", "src0", 1, "x", 1, 1, None) for i in range(300)]


def test_against_a_plain_restatement(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    frame(spark, more_rows()).write.parquet(path)
    assert found(exact_dedup.deduplicate(spark, path)) == plain(more_rows())


def test_a_single_file(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    assert found(exact_dedup.deduplicate(spark, path)) == plain([tuple(r) for r in spark.read.parquet(path).select("doc_id", "text").collect()])


@pytest.mark.parametrize("length", [0, 1])
def test_colliding_digests(spark, tmp_path, length):
    """All texts share one digest, or 256: the bytes decide."""
    path = str(tmp_path / "docs.parquet")
    frame(spark, more_rows()).write.parquet(path)
    weak = lambda t: F.substring(exact_dedup.sha256(t), 1, length)
    assert found(exact_dedup.deduplicate(spark, path, digest=weak)) == plain(more_rows())


def test_state_outlives_runs(spark, tmp_path):
    """Later files meet the texts of earlier ones; files already taken in count once; small batches give the same."""
    path, checkpoint = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    data = more_rows()
    frame(spark, data[:150], 3).write.parquet(path)
    assert found(exact_dedup.deduplicate(spark, path, checkpoint, batch_bytes=1)) == plain(data[:150])
    frame(spark, data[150:], 2).write.mode("append").parquet(path)
    state = exact_dedup.absorb(spark, path, checkpoint, batch_bytes=1)
    assert state.groupBy().agg(F.sum("n")).first()[0] == len(data)
    assert found(exact_dedup.deduplicate(spark, path, checkpoint)) == plain(data)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != exact_dedup.STATE_CONF["spark.sql.streaming.stateStore.providerClass"]


def test_empty_table_and_clashing_names(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    frame(spark).limit(0).write.parquet(path)
    assert exact_dedup.deduplicate(spark, path).collect() == []
    other = str(tmp_path / "other.parquet")
    frame(spark).select("*", *(F.lit(1).alias(c) for c in ("digest", "norm", "at", "keeper", "n", "_metadata", "file"))).write.parquet(other)
    assert found(exact_dedup.deduplicate(spark, other)) == plain(rows())
