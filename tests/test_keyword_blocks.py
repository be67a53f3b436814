"""Keywords in blocks, of every match type, and compatibility forms."""

from __future__ import annotations

import pytest

from procura.operators import matching

KEYWORD = "subscription_id string, value string, match_type string, case_sensitive boolean, is_required boolean, weight double"
WORDS = (("build", "contains"), ("服务器", "contains"), ("++", "contains"), ("a build", "starts_with"), ("ina town", "ends_with"), ("whole text", "exact"), ("^[a-c] .*town$", "regex"))
ROWS = [(1, "A building in China town"), (2, "Whole Text"), (3, "nothing"), (4, "采购服务器一批"), (5, "C++")]


@pytest.mark.parametrize("bound", [0, 3, 200_000])
def test_results_are_the_same_at_every_size(spark, monkeypatch, bound):
    monkeypatch.setattr(matching, "BROADCAST_KEYWORDS", bound)
    table = spark.createDataFrame([(f"s{i}", v, k, False, False, 1.0) for i, (v, k) in enumerate(WORDS)], KEYWORD)
    got = {(r["id"], r["subscription_id"]) for r in matching.evaluate(spark.createDataFrame(ROWS, "id long, text string"), table).collect()}
    assert got == {(1, "s0"), (4, "s1"), (5, "s2"), (1, "s3"), (1, "s4"), (2, "s5"), (1, "s6")}


def test_compatibility_forms_match(spark):
    words = [("ＡＢＣ", "contains"), ("abc", "contains"), ("第①包", "exact"), ("^ａbc", "regex"), ("（", "regex")]
    table = spark.createDataFrame([(f"s{i}", v, k, False, False, 1.0) for i, (v, k) in enumerate(words)], KEYWORD)
    rows = spark.createDataFrame([(1, "abc (x)"), (2, "ＡｂＣ"), (3, "第1包"), (4, None)], "id long, text string")
    got = {(r["id"], r["subscription_id"]) for r in matching.evaluate(rows, table).collect()}
    assert got == {(i, s) for i in (1, 2) for s in ("s0", "s1", "s3")} | {(3, "s2")}
