"""Keywords looked up by grams and pieces against trying each on each text, by the words of the rule."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from procura.operators import matching

KEYWORD = "subscription_id string, value string, match_type string, case_sensitive boolean, is_required boolean, weight double"


def plain(texts, words):
    out = set()
    form = lambda x: unicodedata.normalize("NFKC", x)
    for i, text in texts:
        for value, kind, sensitive in words:
            if text is None or value is None:
                continue
            t, v = form(text), form(value)
            if kind == "regex":
                try:
                    hit = re.search(v, t, 0 if sensitive else re.IGNORECASE)
                except re.error:
                    hit = None
            else:
                if not sensitive:
                    t, v = t.lower(), v.lower()
                hit = {"exact": t == v, "contains": v in t, "starts_with": t.startswith(v), "ends_with": t.endswith(v)}[kind]
            if hit:
                out.add((i, value, kind, bool(sensitive)))
    return out


def data(seed: int):
    r = random.Random(seed)
    letters = "abAB 服务器éÉ①１x.\n🎉𝒜"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = [(i, word(r.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "Ａ B"), (103, "café 服务器采购"), (104, "build it " * 400 + "end")]
    words = [(word(n), k, c) for n in (0, 1, 2, 3, 4, 5, 7) for k in ("exact", "contains", "starts_with", "ends_with") for c in (False, True) for _ in range(3)]
    for _, t in r.sample(texts[:60], 30):
        a = r.randint(0, 20)
        words += [(t[a : a + r.randint(1, 30)], "contains", r.random() < 0.5), (t[: r.randint(1, 40)], "starts_with", r.random() < 0.5), (t[-r.randint(1, 40) :], "ends_with", r.random() < 0.5), (t.upper(), "exact", False)]
    patterns = ["(?P<x>build)", "bu{,3}ild", "[[a-z]uild", r"caf\w\b", r"^\d", r"服\w器", "(", "*a", r"\bend$", "(?i)BUILD", "", "a{2,1}", r"[^\x00-\x7f]{3}"]
    return texts, list(dict.fromkeys(words + [(p, "regex", c) for p in patterns for c in (False, True)])) + [(None, "contains", False)]


@pytest.mark.parametrize(("seed", "bound", "few"), [(1, 200_000, 0), (2, 5, 0), (3, 1, 0), (4, 200_000, 10_000)])
def test_against_trying_all(spark, monkeypatch, seed, bound, few):
    monkeypatch.setattr(matching, "BROADCAST_KEYWORDS", bound)
    monkeypatch.setattr(matching, "FEW", few)
    texts, words = data(seed)
    table = spark.createDataFrame([(f"s{i}", v, k, c, False, 1.0) for i, (v, k, c) in enumerate(words)], KEYWORD)
    hits = matching.keyword_hits(spark.createDataFrame(texts, "id long, text string"), table)
    rows = [tuple(r) for r in hits.select("id", "value", "match_type", "case_sensitive").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(texts, words)


def test_literals_are_not_tried_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(matching, "FEW", 0)
    words = [("build", "contains"), ("bu", "starts_with"), ("it", "ends_with"), ("x", "exact")]
    table = spark.createDataFrame([("s", v, k, False, False, 1.0) for v, k in words], KEYWORD)
    plan = matching.keyword_hits(spark.createDataFrame([(1, "build it")], "id long, text string"), table)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_keywords(spark):
    """200,001 keywords, more than are broadcast, each in one text."""
    table = spark.range(200_001).select(F.lit("s").alias("subscription_id"), F.concat(F.lit("key"), "id", F.lit("word")).alias("value"), F.lit("contains").alias("match_type"), F.lit(False).alias("case_sensitive"), F.lit(False).alias("is_required"), F.lit(1.0).alias("weight"))
    texts = spark.range(0, 200_001, 1000).select("id", F.concat(F.lit("a KEY"), "id", F.lit("word here")).alias("text"))
    hits = matching.keyword_hits(texts, table)
    assert sorted((r["id"], r["value"]) for r in hits.collect()) == [(i, f"key{i}word") for i in range(0, 200_001, 1000)]


def test_bad_patterns_are_told(spark):
    table = spark.createDataFrame([("s", v, "regex", False, False, 1.0) for v in ("(", "ok", "*a", None)] + [("s", "(", "contains", False, False, 1.0)], KEYWORD)
    got = {r["value"]: r["fault"] for r in matching.bad_patterns(table).collect()}
    assert set(got) == {"(", "*a"} and all(got.values())
