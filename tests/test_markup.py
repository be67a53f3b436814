"""Pages: elements, selectors and records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from procura.operators import cleaning, markup

PAGE = """<html><head><title>t</title></head><body id=top class="a  b">
<div class="menu x"><ul><li>one<li><a href="/1" rel=nofollow>two</a> <b>bold</b></ul></div>
<div id=main><p class=lead>First &amp; <em>second</em><p>Next<br>line<div class="x y"><p><a HREF='http://h.org/z.pdf'>Z</a></div></div>
<table><tr><th>Label<td>Value<tr><td>L2<td>V2</table><script>var p = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize(("selector", "texts"), [
    ("li", ["one", "two bold"]), ("ul > li > a", ["two"]), ("body > a", []), ("#main p", ["First & second", "Next\nline", "Z"]), ("#main > p", ["First & second", "Next\nline"]),
    (".x", ["one\ntwo bold", "Z"]), ("div.x.y", ["Z"]), (".y.menu", []), ("[href]", ["two", "Z"]), ("a[href^='/']", ["two"]), ("a[href$=pdf]", ["Z"]), ('a[href*="h.org"], .lead em', ["second", "Z"]),
    ("body.b li a[rel~=nofollow]", ["two"]), ("* > em", ["second"]), ("tr td", ["Value", "L2", "V2"]), ("tr > th", ["Label"]), ("p p", []), ("div div p a", ["Z"]), ("script", [""]), ("body#top.a", None), ("[rel|=nofollow]", ["two"]), ("[href='']", []),
])
def test_selectors(selector, texts):
    page, found = markup.Automaton({"s": selector}).matches(PAGE)
    got = [page.text[page.elements[p].start : page.elements[p].end] for p, _ in found]
    assert got == texts if texts is not None else len(got) == 1


@pytest.mark.parametrize("selector", ["", "a + b", "> a", "a:hover", "a ~ b", "a {"])
def test_unknown_selectors_are_refused(selector):
    with pytest.raises(ValueError, match="not understood"):
        markup.Automaton({"s": selector})


def test_many_selectors_in_one_pass(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>only"), (4, "</p></div>text")], "id long, html string")
    rows = markup.selected(df, "html", {"paragraphs": "p", "links": "a[href]", "none": "video"}, "id").collect()
    assert sorted((r["id"], r["selector"], r["text"]) for r in rows) == [(1, "links", "Z"), (1, "links", "two"), (1, "paragraphs", "First & second"), (1, "paragraphs", "Next\nline"), (1, "paragraphs", "Z"), (3, "paragraphs", "only")]
    firsts = {r["id"]: (r["p"], r["a"]) for r in markup.first_texts(df, "html", {"p": "p", "a": "a"}, "id").collect()}
    assert firsts == {1: ("First & second", "two"), 2: (None, None), 3: ("only", None), 4: (None, None)}


def detail(body: str, head: str = "") -> str:
    return f"<html><head>{head}</head><body><div class=nav><a href=/>Home</a></div>{body}</body></html>"


RECORDS = {
    detail("<h1>Road works at the river</h1><div id=content-1><table><tr><td>预算金额</td><td>120.5万元</td></tr><tr><td>采购人</td><td>City Office 联系电话 1</td></tr><tr><td>发布时间</td><td>2024年3月5日</td></tr></table><p>The works include a bridge and a road.</p></div>"): ("Road works at the river", "2024-03-05", 1_205_000, "City Office"),
    detail("<article><h2>某某学校设备采购公告项目</h2><p>招标人：第一中学，地址：甲路</p><p>项目预算为￥3,000元，发布日期：2023-1-9</p></article><h1>Site</h1>"): ("某某学校设备采购公告项目", "2023-01-09", 3000, "第一中学"),
    detail("<dl><dt>业主<dd>Water Board<dt>中标金额<dd>2亿元</dl><time datetime='2022-12-31T08:00'>yesterday</time>", "<title>Dam repair notice_Site name</title>"): ("Dam repair notice", "2022-12-31", 200_000_000, "Water Board"),
    "": (None, None, None, None), "<p>x": (None, None, None, None),
}


def test_records(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*RECORDS, None])], "id long, html string")
    rows = markup.records(df, "html", "id", date_of=cleaning.date_text, amount_of=cleaning.amount_text).withColumn("day", F.date_format("publish_date", "yyyy-MM-dd")).collect()
    got = {r["id"]: (r["title"], r["day"], None if r["budget_amount"] is None else int(r["budget_amount"]), r["tenderer"]) for r in rows}
    assert got == dict(enumerate([*RECORDS.values(), (None, None, None, None)]))
    assert "bridge" in next(r["description"] for r in rows if r["id"] == 0) and "Home" not in next(r["content"] for r in rows if r["id"] == 0)


def test_records_as_the_sql_states_them(spark):
    """References without a semicolon stay as they are written, and blanks don't count in a title's length, where the caller says so."""
    pages = ["<article><h1>Roads &amp;&amp and&amp</h1><p>a &lt b &amp;lt; c&#39;d&#39 &ampx; &zzz; &&eacute;</article>", "<article><h1>Au un.</h1>", "<article><h1>Auf un.</h1>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    options = dict(date_of=cleaning.date_text, amount_of=cleaning.amount_text)
    plain = {r["id"]: (r["title"], r["content"]) for r in markup.records(df, "html", "id", **options).collect()}
    assert plain[0] == ("Roads && and&", "Roads && and&\na < b &lt; c'd' &x; &zzz; &é") and plain[1][0] == "Au un."
    bare = {r["id"]: (r["title"], r["content"]) for r in markup.records(df, "html", "id", size=lambda t: F.length(F.replace(t, F.lit(" "), F.lit(""))), ended=True, **options).collect()}
    assert bare[0] == ("Roads &&amp and&amp", "Roads &&amp and&amp\na &lt b &lt; c'd&#39 &ampx; &zzz; &é") and bare[1][0] is None and bare[2][0] == "Auf un."


def test_safe_and_absolute_links(spark):
    links = {"http://h.org/a": True, "https://u:p@h.org:80/a": True, "ftp://h.org/": False, "http://localhost/x": False, "http://127.0.0.1": False, "http://10.1.1.1/": False, "http://172.20.0.1/": False, "http://172.32.0.1/": True, "http://192.168.1.1:8/": False, "http://[::1]/": False, "http://printer.local/": False, "javascript:x": False, "": False}
    df = spark.createDataFrame([(k,) for k in links], "u string")
    assert {r["u"]: r["s"] for r in df.select("u", markup.safe_link(F.col("u")).alias("s")).collect()} == links
    pages = {("a.pdf", "http://h.org/d/i.html?q=/x/"): "http://h.org/d/a.pdf", ("/a", "http://h.org"): "http://h.org/a", ("a", "http://h.org"): "http://h.org/a", ("//o.org/a", "https://h.org/"): "https://o.org/a", ("http://x/", "http://h/"): "http://x/"}
    df = spark.createDataFrame(list(pages), "l string, p string")
    assert {(r["l"], r["p"]): r["a"] for r in df.select("l", "p", markup.absolute(F.col("l"), F.col("p")).alias("a")).collect()} == pages


def test_deep_and_broken_pages_end_soon():
    """A megabyte of elements without ends."""
    page = markup.Page().read("<div>" * 3000 + "<span class=ad>x" * 20_000 + "</b>" * 20_000)
    assert len(page.elements) == 23_000
