"""Small fixtures with known answers: trends, scores, matches, parsing, classes, names, search and validation."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from test_segmented import plain_breaker

from procura import streaming
from procura.operators import classify, cleaning, extraction, markup, matching, merging, monitoring, paging, predicates, scoring, search, similarity, stats, tables, trends, validation
from procura.sources import sinks

AS_OF = "2024-06-01 00:00:00"
TREND = [
    ("t1", "2024-01-15", 500_000, "中国移动北京公司", "北京", "信息技术"), ("t2", "2024-01-20", 1_000_000, "中国联通上海公司", "上海", "通信"), ("t3", "2024-02-10", 800_000, "中国电信广东公司", "广东", "信息技术"),
    ("t4", "2024-02-15", 2_000_000, "华为技术有限公司", "深圳", "硬件"), ("t5", "2024-03-01", 100_000, "北京市政府", "北京", "办公"), ("t6", "2024-03-10", 5_000_000, "中建集团", "北京", "建筑"),
    ("t7", "2024-03-15", 300_000, "腾讯科技", "深圳", "信息技术"), ("t8", "2024-04-01", 200_000, "中国工商银行", "北京", "金融"),
]


@pytest.fixture(scope="module")
def notices(spark):
    df = spark.createDataFrame(TREND, "id string, day string, amount long, tenderer string, region string, industry string")
    return df.select("id", F.to_timestamp("day").alias("publish_date"), F.col("amount").cast("decimal(15,2)").alias("budget_amount"), "tenderer", "region", F.col("region").alias("region_name"), "industry")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(spark, rows: list, schema: str, column) -> list:
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_trend_fixture(notices):
    periods = {(r["kind"], r["period"]): r["count"] for r in stats.periods(notices).collect()}
    assert [periods["month", f"2024-0{m}"] for m in (1, 2, 3, 4)] == [2, 2, 3, 1]
    assert (periods["quarter", "2024-Q1"], periods["quarter", "2024-Q2"]) == (7, 1)
    regions = {r["key"]: (r["count"], r["rank"]) for r in stats.ranked_shares(notices, stats.known("region")).collect()}
    assert regions["北京"] == (4, 1) and regions["深圳"] == (2, 2) and {regions[k][0] for k in ("上海", "广东")} == {1}
    buckets = {r["range"]: r["count"] for r in stats.distribution(notices, stats.SIX).collect()}
    assert buckets == {"0-10万": 0, "10-50万": 3, "50-100万": 2, "100-500万": 2, "500-1000万": 1, "1000万以上": 0}


def test_empty_and_null_notices(notices):
    none = notices.limit(0)
    row = stats.overview(none, AS_OF).first()
    assert (row["total_count"], row["total_amount"], row["average_amount"]) == (0, 0.0, 0.0)
    assert {r["count"] for r in stats.distribution(none, stats.FIVE).collect()} == {0} and stats.ranked_shares(none, stats.known("region")).collect() == []
    assert trends.budget_trend(none).collect() == []
    blank = notices.limit(1).select("id", "publish_date", F.lit(None).cast("decimal(15,2)").alias("budget_amount"), F.lit("").alias("tenderer"), F.lit(None).cast("string").alias("region_name"), F.lit("").alias("industry"))
    keys = {(r["kind"], r["key"]) for r in stats.classification(blank).collect()}
    assert keys == {(k, "未知") for k in ("tenderer", "region", "industry", "amount")}


def test_score_boundaries(spark):
    amounts = [None, 9_999, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000]
    assert values(spark, [(a,) for a in amounts], "a long", scoring.amount_score(F.col("a"))) == [0, 5, 7.5, 10, 15, 17.5, 20, 22.5, 25]
    days = [None, -1, 2, 3, 7, 14, 20, 30, 45, 60]
    deadline = F.timestamp_add("DAY", F.col("d"), F.to_timestamp(F.lit(AS_OF)))
    assert values(spark, [(d,) for d in days], "d int", scoring.timeline_score(deadline, AS_OF)) == [10, 0, 2, 5, 8, 12, 14, 16, 18, 20]
    names = ["中国移动", "北京市政府", "某市人民医院", "腾讯科技", None]
    assert values(spark, [(n,) for n in names], "n string", scoring.history_score(F.col("n"))) == [12, 10, 9, 7.5, 7.5]
    assert values(spark, [("公开招标政府",), ("单一来源",), ("其他",)], "n string", scoring.competition_score(F.col("n"))) == [10, 20, 15]


def test_classes(spark):
    def pair(column):
        return F.concat_ws("/", column["category"], column["confidence"].cast("string"))

    names = ["中国移动通信集团有限公司", "北京市政府", "北京大学", "腾讯科技", "某公司", "", None]
    assert values(spark, [(n,) for n in names], "n string", pair(classify.tenderer(F.col("n")))) == ["国有企业/0.9", "政府/0.9", "事业单位/0.9", "民营企业/0.9", "其他企业/0.6", "未知/0.0", "未知/0.0"]
    places = ["北京市", "广东省", "新疆", "广西壮族自治区", "火星", ""]
    assert values(spark, [(n,) for n in places], "n string", pair(classify.region(F.col("n")))) == ["华北地区/0.98", "华南地区/0.98", "西北地区/0.98", "未知/0.3", "未知/0.3", "未知/0.0"]
    assert values(spark, [("医疗设备",), ("软件开发服务",), ("农业",)], "n string", classify.industry(F.col("n"))["category"]) == ["卫生和社会工作", "信息传输、软件和信息技术服务业", "未知"]
    assert values(spark, [(None,), (99_999,), (100_000,), (1_000_000,), (10_000_000,), (-1,)], "a long", classify.amount(F.col("a"))) == ["未知", "小额 (<10万)", "中额 (10-100万)", "大额 (100-1000万)", "超大额 (>=1000万)", "小额 (<10万)"]


KEYWORD = "subscription_id string, value string, match_type string, case_sensitive boolean, is_required boolean, weight double"


@pytest.mark.parametrize(("keywords", "text", "score", "is_match"), [
    ([("construction", False, 1.0)], "Building Construction Project", 10.0, True),
    ([("construction", True, 1.0), ("xyz", False, 1.0)], "Construction Project", 10.0, True),
    ([("xyz", True, 1.0), ("construction", False, 1.0)], "Construction Project", 10.0, False),
    ([("construction", False, 1.0), ("building", False, 1.0)], "Construction Building Project", 24.0, True),
    ([("construction", False, 5.0)], "Construction Project", 50.0, True),
    ([("construction", False, 20.0)], "Construction Project", 100.0, True),
])
def test_match_scores(spark, keywords, text, score, is_match):
    table = spark.createDataFrame([("s", v, "contains", False, required, w) for v, required, w in keywords], KEYWORD)
    row = matching.evaluate(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), table).collect()
    assert [(r["id"], r["score"], r["is_match"]) for r in row] == [(1, score, is_match)]


def test_many_keywords_are_found_by_words(spark, monkeypatch):
    table = spark.createDataFrame([("s", v, k, False, False, 1.0) for v, k in (("building", "contains"), ("china town", "contains"), ("whole text", "exact"))], KEYWORD)
    rows = spark.createDataFrame([(1, "A building in China town"), (2, "Whole Text"), (3, "nothing")], "id long, text string")
    few = sorted(map(tuple, matching.evaluate(rows, table).collect()))
    monkeypatch.setattr(matching, "BROADCAST_KEYWORDS", 0)
    assert sorted(map(tuple, matching.evaluate(rows, table).collect())) == few and len(few) == 2


def test_parsing(spark):
    texts = ["人民币100万元", "500000", "2亿元", "1,000,000", "5千元", "not a number", None, ""]
    got = values(spark, [(t,) for t in texts], "t string", cleaning.amount_text(F.col("t")).cast("double"))
    assert got == [1_000_000, 500_000, 200_000_000, 1_000_000, 5_000, None, None, None]
    dates = ["2024年01月15日", "2024-01-15", "2024-01-15 10:30:45", "2024/1/5", "invalid-date", None]
    got = values(spark, [(t,) for t in dates], "t string", F.date_format(cleaning.date_text(F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-15 00:00:00", "2024-01-15 00:00:00", "2024-01-15 10:30:45", "2024-01-05 00:00:00", None, None]
    names = ["某市 人民 医院", "某市人民医院（新院区）", "北大", "中国移动", "某某有限责任公司"]
    assert values(spark, [(n,) for n in names], "n string", cleaning.organisation(F.col("n"))) == ["某市人民医院", "某市人民医院", "北京大学", "中国移动通信集团有限公司", "某某有限公司"]
    page = "招标编号：ZB2026-001 中标人：某科技有限公司，发布时间：2026-03-20 中标金额：100万元"
    row = one(spark, *extraction.fields(F.lit(page), ("bid_number", "bidder", "date", "amount")))
    assert (row["bid_number"], row["bidder"], f"{row['date']:%Y-%m-%d}", float(row["amount"])) == ("ZB2026-001", "某科技有限公司", "2026-03-20", 1_000_000.0)


def test_validation(spark):
    rows = [("A good title", 5.0, "https://x.org/a", "bidding"), ("bad", -1.0, "nowhere", "qa"), (None, 1e13, "", "win"), ("x" * 201, None, None, "change")]
    df = spark.createDataFrame(rows, "title string, budget_amount double, source_url string, notice_type string").withColumn("publish_date", F.to_timestamp(F.lit(AS_OF))).withColumn("deadline_date", F.lit(None).cast("timestamp"))
    got = [[e["code"] for e in r[0]] for r in df.coalesce(1).select(validation.errors(AS_OF)).collect()]
    assert got == [[], ["TITLE_TOO_SHORT", "BUDGET_NEGATIVE", "INVALID_URL", "INVALID_NOTICE_TYPE"], ["REQUIRED", "BUDGET_TOO_LARGE"], ["TITLE_TOO_LONG"]]


def test_search_and_highlight(spark):
    text = "医疗设备" * 1000 + "关键词"
    assert "<mark>关键词</mark>" in one(spark, search.highlight(F.lit(text), ["关键词"]))[0]
    assert one(spark, search.highlight(F.lit("<b>C++ & c</b>"), ["c++", "C"]))[0] == "&lt;b&gt;<mark>C++</mark> &amp; <mark>c</mark>&lt;/b&gt;"
    assert search.snippet_of("word " * 100 + "needle" + " word" * 100, ["needle"]).count("needle") == 1
    assert search.cut("a" * 118 + " " + "b" * 60) == "a" * 118 + "..." and search.cut("a" * 117 + " " + "b" * 60) == "a" * 117 + " " + "b" * 29 + "..."
    assert search.snippets_of("x needle y needle" + "." * 80 + "needle" + "." * 80 + "needle", ["NEEDLE"], 5) == ["x needle y ne", "....." + "needle" + "....."]
    assert search.snippets_of("", ["a"]) == [] and search.snippets_of("abc", []) == []
    assert search.snippet_of("short text", ["zz"]) == "short text" and search.snippet_of("", ["a"]) == ""
    df = spark.createDataFrame([(1, "医疗 系统", "x"), (2, "其他", "医疗 系统 系统")], "id long, title string, description string")
    assert [r["id"] for r in search.ranked(df, "医疗 (系统)").orderBy(F.desc("rank")).collect()] == [1, 2]
    assert search.ranked(df, "  ").collect() == []
    with pytest.raises(ValueError):
        search.normalise(None)


def test_filters_refuse_bad_parameters():
    for bad in ({"budgetMin": 2, "budgetMax": 1}, {"dateFrom": "2024-02-01", "dateTo": "2024-01-01"}, {"dateFrom": "01.02.2024"}, {"regions": ["123"]}, {"regions": ["-"]}):
        with pytest.raises(ValueError):
            predicates.build(bad)
    assert paging.meta(101, 99, 20) == {"total": 101, "total_pages": 6, "page": 6, "has_next": False, "has_previous": True}


def clusters(spark, names: list[str]):
    df = spark.createDataFrame(list(enumerate(names)), "k long, name string").withColumn("normal", cleaning.organisation(F.col("name")))
    return similarity.cluster_names(df, "normal", "name", "k").collect()


def test_name_clusters(spark):
    (hospital,) = clusters(spark, ["某市人民医院", "某市第一人民医院", "某市人民医院（新院区）", "某市人民 医院"])
    assert hospital["canonical"] == "某市人民医院" and len(hospital["variants"]) == 4
    (mobile,) = clusters(spark, ["中国移动通信集团有限公司", "中国移动", "中国移动公司"])
    assert mobile["canonical"] == "中国移动通信集团有限公司" and mobile["short_name"] == "中国移动"
    assert len(clusters(spark, ["某市财政局", "某市财政局政府采购中心", "某市财政 局", "某市财政局（本级）"])) == 1
    assert len(clusters(spark, ["某市人民医院", "某县人民医院", "某市第二人民医院"])) == 3
    assert len(clusters(spark, ["北京大学", "北大"])) == 1


def test_known_titles_equal_all_pairs(spark):
    r = random.Random(2)
    stored = ["".join(r.choice("abcdefg ，。") for _ in range(r.randint(1, 40))) for _ in range(60)]
    news = [s[: r.randint(0, len(s))] + r.choice("abcz") + s[r.randint(0, len(s)) :] for s in stored] + ["", "q"] + [s[1:] for s in stored]
    got = {x["title"]: x["similarity"] for x in similarity.known_titles(spark.createDataFrame([(t,) for t in news], "title string"), spark.createDataFrame([(t,) for t in stored], "title string")).collect()}
    for title in set(news):
        best = max(similarity.title_similarity(title, s) for s in stored)
        if best >= 0.85 and similarity.title_form(title):
            assert got.get(title) == best, (title, best)
        else:
            assert title not in got
    assert SequenceMatcher(None, "ab", "ab").ratio() == 1.0


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "id long, v string, at long")
    news = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, at long")
    assert sorted((r["id"] or 0, r["v"]) for r in tables.upsert(stored, news, ["id"], [F.desc("at")]).collect()) == [(0, "n"), (1, "a"), (2, "d"), (3, "e")]
    assert tables.insert_new(stored, news, "id", [F.desc("at")]).select("id").collect() == [(3,)]


def test_months_are_replaced_alone(spark, tmp_path):
    def rows(data):
        return spark.createDataFrame(data, "id long, day string").select("id", F.to_timestamp("day").alias("publish_date"))

    path, archive = str(tmp_path / "months"), str(tmp_path / "archive")
    sinks.write_months(rows([(1, "2024-01-05"), (2, "2024-02-05"), (3, None)]), path)
    sinks.write_months(rows([(4, "2024-02-07")]), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 3, 4]
    assert [r["id"] for r in sinks.read_months(spark, path, "2024-02", "2024-03").collect()] == [4]
    sinks.archive_months(spark, path, archive, "2024-02")
    assert [r["id"] for r in spark.read.parquet(archive).collect()] == [1]


def test_breaker_equals_a_fold(spark, tmp_path):
    r = random.Random(6)
    data = [(i, f"k{i % 2}", f"i{r.randint(0, 5)}", 1_700_000_000 + i * 20, r.random() < 0.5) for i in range(120)]
    path = str(tmp_path / "events")
    frame = spark.createDataFrame(data, "event_id long, key string, item string, s long, ok boolean").select("event_id", "key", "item", "ok", F.timestamp_seconds("s").alias("ts"))
    frame.write.parquet(path)
    want = {}
    for k in ("k0", "k1"):
        want |= {place: (state, rejected) for place, state, rejected in plain_breaker([(s * 10**6, i, ok) for i, key, _, s, ok in data if key == k], 2, 45 * 10**6, 2)}
    batch = monitoring.breaker(frame, "key", "ts", "ok", 2, 45.0, 2)
    assert {x["place"]: (x["state"], x["rejected"]) for x in batch.collect()} == want
    stream = streaming.table_stream(spark, path, frame)
    got = streaming.drained(streaming.breaker(stream, "key", "ts", "ok", "event_id", 2, 45.0, 2))
    assert {x["place"]: (x["state"], x["rejected"]) for x in got.collect()} == want
    assert {s for s, _ in want.values()} == {"closed", "open", "half_open"}


def test_merging(spark):
    rows = [(1, "api_list", "A", None, 5.0), (1, "pdf", "B", "T", 7.0), (1, "fallback", "C", "", None), (2, "elsewhere", "D", None, None)]
    df = spark.createDataFrame(rows, "id long, source string, title string, tenderer string, budget_amount double")
    got = {r["id"]: tuple(r)[1:] for r in merging.merged(df, "id", ["title", "tenderer", "budget_amount"]).collect()}
    assert got == {1: ("B", "T", 7.0), 2: ("D", None, None)}
    tries = [(1, "structured", 0.4, "a"), (1, "rules", 0.45, "b"), (1, "model", 0.9, "c"), (2, "structured", 0.1, "a"), (2, "model", 0.2, "c"), (3, "rules", None, "b")]
    first = merging.cascade(spark.createDataFrame(tries, "id long, strategy string, confidence double, v string"), "id").collect()
    assert {r["id"]: r["v"] for r in first} == {1: "b", 2: "c", 3: "b"}


def test_items_parameters_and_main_documents(spark):
    text = "采购清单\n1. 服务器 2台\n2、交换机 10 套\n3. 合同期限 30 个\n货物名称：打印机，数量：5台\n| 1 | 扫描仪 | A4 | 3 | 台 |\n处理器：主频≥2.0GHz\n联系人：张三\n颜色: 黑"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    found = {(r["id"], r["name"], r["quantity"], r["unit"]) for r in extraction.items(df, "id", "text").collect()}
    assert found == {(1, "服务器", 2.0, "台"), (1, "交换机", 10.0, "套"), (1, "打印机", 5.0, "台"), (1, "扫描仪", 3.0, "台")}
    stated = {r["name"]: (r["value"], r["category"], r["is_mandatory"]) for r in extraction.parameters(df, "id", "text").collect()}
    assert stated["处理器"] == ("主频≥2.0GHz", "性能指标", True) and stated["颜色"] == ("黑", "其他", False) and "联系人" not in stated
    page = "<div class='content'><p><a href='/a.pdf'>x</a></p></div><a href='b.pdf'>招标公告</a><a href='c.html'>公告</a>"
    pages = spark.createDataFrame([(1, "http://h.org/d/", page), (2, "http://h.org/", "<a href='only.pdf'></a>"), (3, "http://h.org/", "<a href='1.pdf'></a><a href='2.pdf'></a>"), (4, None, None)], "id long, url string, html string")
    got = {r["key"]: (r["attachment"], r["score"]) for r in markup.main_documents(pages, "id", "url", "html").collect()}
    assert got == {1: ("http://h.org/d/b.pdf", 22), 2: ("http://h.org/only.pdf", 0)}


def test_pages_filters_and_matches(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(25)], "id int, k int")
    order = [F.desc("id")]
    assert [[r["id"] for r in paging.fallback_page(df, order, page, 10).collect()][:1] for page in (1, 3, 4, 0, -2, "x", None)] == [[24], [4], [24], [24], [24], [24], [24]]
    assert sorted(r["id"] for r in paging.recent(df, ["k"], order, 2).collect()) == [19, 20, 21, 22, 23, 24]
    with pytest.raises(ValueError, match="colour"):
        predicates.build({"colour": "red"})
    rows = spark.createDataFrame([(1, "a1b22c"), (2, ""), (3, None), (4, "9")], "id int, t string")
    got = {r["id"]: [tuple(x) for x in r["m"] or []] for r in rows.select("id", extraction.pattern_matches(F.col("t"), r"(\d)\d*").alias("m")).collect()}
    assert got == {1: [(1, 2, "1", "1"), (3, 5, "22", "2")], 2: [], 3: [], 4: [(0, 1, "9", "9")]}


@pytest.mark.parametrize(("params", "good"), [
    ({"regions": ["11", "1101", "110101", "北京", " 浙江省 "]}, True), ({"regions": ["1"]}, False), ({"regions": ["110"]}, False), ({"regions": ["Beijing"]}, False), ({"regions": [" "]}, False), ({"regions": [11]}, False),
    ({"budgetMin": "5", "budgetMax": 6}, True), ({"budgetMin": 7, "budgetMax": 6}, False), ({"budgetMin": "x", "budgetMax": 6}, False), ({"publishDateFrom": "2024-01-02", "publishDateTo": "01-01-2024"}, False), ({"dateFrom": "2024/01/01", "dateTo": "2024-01-01 10:00:00"}, True), ({"dateFrom": "soon", "dateTo": "2024-01-01"}, False),
])
def test_filters_are_checked(params, good):
    if good:
        predicates.validate(params)
    else:
        with pytest.raises(ValueError):
            predicates.validate(params)
