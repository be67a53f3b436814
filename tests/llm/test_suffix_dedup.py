"""Exact repeated strings against a plain restatement, on the paths for normal, large and hot groups."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from procura.llm import suffix_dedup, suffixes


def plain(rows: list[tuple]) -> set[tuple]:
    """Every 100-byte string is looked up in a set of those before it; rows are in order and distinct."""
    seen: set[bytes] = set()
    out = set()
    for doc_id, text in rows:
        data = (text or "").encode()
        steps = np.zeros(len(data) + 1, int)
        for at in range(len(data) - 99):
            w = data[at : at + 100]
            if w in seen:
                steps[at] += 1
                steps[at + 100] -= 1
            seen.add(w)
        gone = np.cumsum(steps[:-1]) > 0
        edges = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.add((doc_id, len(data), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


def corpus() -> list[tuple]:
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    base = " ".join(word() for _ in range(150))
    rows: list[tuple] = [(0, ""), (1, None), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101), (5, "ab" * 300), (6, "x" + "ab" * 300)]
    for i in range(10, 50):
        rows.append((i, f"{word()} {word()} {passage[i % 7 :]} {word()}"))
    for i in range(50, 80):
        cut = r.randint(0, len(base) - 1)
        rows.append((i, base[:cut] + r.choice(["", "Z", "zz"]) + base[cut:]))
    rows.append((90, passage + base + passage))
    rows.append((91, base))
    rows.append((92, "\0" * 150 + base[:120] + "\0" * 150))
    rows.append((93, " ".join(word() for _ in range(4000)) + passage))
    return rows


@pytest.mark.parametrize(("hot", "pairs"), [(500_000, 24), (500_000, 2), (3, 24), (20, 3)])
def test_equals_plain_restatement(spark, hot, pairs):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in suffix_dedup.report(df.repartition(5), hot=hot, pairs=pairs).collect()}
    assert got == plain(rows)


def test_nulls_repeats_and_extra_columns(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(400)) + "q" * 3
    rows = [(None, long, 1, "x"), (7, long, 2, "y"), (7, long, 3, "z"), (8, None, 4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t bigint, payload string")
    got = sorted((tuple(r) for r in suffix_dedup.report(df).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()), key=repr)
    first = [x for x in got if x[0] is None][0]
    assert [x for x in got if x[0] == 7] == [(7, 403, 403, 1)] * 2  # one document, later than the null id
    assert first[2] < 403
    assert (8, 0, 0, 0) in got
    kept = suffix_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["t"], r["payload"], len(r["text"] or "")) for r in kept.collect())[1:3] == [(2, "y", 0), (3, "z", 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.report(df).collect() == []
    assert suffix_dedup.deduplicate(df).collect() == []


def test_merge_gives_order_and_prefixes():
    r = random.Random(1)
    keys = sorted({bytes(r.choice(b"ab") for _ in range(suffixes.WIDTH)) for _ in range(300)})
    runs = [sorted(r.sample(keys, 40)) for _ in range(7)]
    coded = [suffixes.front_coded(np.frombuffer(b"".join(x), np.uint8).reshape(-1, suffixes.WIDTH)) for x in runs]
    got = list(suffixes.merge([suffixes.rows(*c) for c in coded]))
    assert [k for _, k, _ in got] == sorted(k for x in runs for k in x)
    for (_, a, _), (n, b, _) in zip(got, got[1:]):
        assert n == suffixes.common(a, b, 0)
