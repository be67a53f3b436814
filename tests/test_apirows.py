"""Answers of interfaces and list rows: broken, nested and odd ones."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from procura.operators import apirows
from procura.operators.apirows import Field

FIELDS = [Field("title", ("a.b", "title"), "markup"), Field("n", ("n",), "long", 7), Field("x", ("x",), "double"), Field("ok", ("ok",), "boolean"), Field("day", ("day",), "date")]


def rows(spark, bodies, lists=("list", "data.list"), **options):
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    out = apirows.projected(apirows.answers(df, "body", lists), FIELDS, **options)
    return [(r["id"], r["place"], r["title"], r["n"], r["x"], r["ok"], r["day"] and str(r["day"])[:10], dict(r["rescued"])) for r in out.orderBy("id", "place").collect()]


def test_values_and_what_is_broken(spark):
    bodies = [
        json.dumps({"list": [{"title": "<i>t</i>", "n": 3, "x": "1.5", "ok": True, "day": "2024/1/2"}, {"a": {"b": "deep"}, "title": "no", "n": "three", "x": {"y": 1}, "ok": "perhaps", "day": "soon"}, 5, None]}),
        json.dumps({"list": [], "data": {"list": [{"data": {"title": "inner", "n": 12345678901234567890}}]}}), "{", None, "", json.dumps({"list": "text"}), json.dumps([1]), json.dumps({"list": []}),
    ]
    got = rows(spark, bodies)
    assert got[:2] == [(0, 0, "t", 3, 1.5, True, "2024-01-02", {}), (0, 1, "deep", None, None, None, None, {"n": "three", "x": '{"y":1}', "ok": "perhaps", "day": "soon"})]
    assert got[2][:2] == (0, 2) and got[2][-1] == {"_item": "5"}
    assert (1, 0, "inner", None, None, None, None, {"n": "12345678901234567890"}) in got
    assert [(g[0], g[-1]) for g in got if g[0] > 1] == [(2, {"_body": "{"}), (5, {"_list": bodies[5]}), (6, {"_list": "[1]"})]


def test_required_fields_and_defaults(spark):
    got = rows(spark, [json.dumps({"list": [{"n": 1}, {"title": " "}, {"title": "kept"}]}), "broken"], required=("title",))
    assert [(g[2], g[3], g[-1]) for g in got] == [("kept", 7, {}), (None, None, {"_body": "broken"})]


def test_prefilled_names(spark):
    data = [(1, {"pub_date": "2024-1-5", "BUDGET-amount": "3万", "Owner": "A", "z_title": "zt", "atitle": "at"}), (2, {"title": "", "subtitle": "s", "budget_amount": "free"}), (3, {}), (4, None)]
    df = spark.createDataFrame(data, "id int, m map<string,string>")
    got = {r["id"]: r for r in apirows.prefilled(df, "m", ("title", "tenderer", "publish_date", "budget_amount"), {"publish_date": ("day",)}).collect()}
    assert got[1]["title"] == "at" and got[1]["tenderer"] == "A" and str(got[1]["publish_date"])[:10] == "2024-01-05" and int(got[1]["budget_amount"]) == 30000 and got[1]["missing"] == []
    assert dict(got[1]["sources"]) == {"title": "atitle", "tenderer": "Owner", "publish_date": "pub_date", "budget_amount": "BUDGET-amount"}
    assert got[2]["title"] == "s" and got[2]["missing"] == ["tenderer", "publish_date", "budget_amount"]
    assert got[3]["missing"] == got[4]["missing"] == ["title", "tenderer", "publish_date", "budget_amount"]


def test_requests():
    assert apirows.request("zfcg", 3)["pageNo"] == 3 and apirows.request("zfcg", 1, word="x")["word"] == "x"
