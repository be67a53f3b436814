"""Main text of pages with known articles, votes of hosts, and odd markup."""

from __future__ import annotations

from procura.llm import html_text

SCHEMA = "page_id bigint, url string, html string, host string, paths string, text string"


def page(body: str, article: str = "div class='post-12 entry'") -> str:
    tag = article.split()[0]
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p {{ color: red }}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<aside class="sidebar"><p>{'aside words ' * 60}</p></aside><{article}>{body}</{tag}><div id="comments"><p>{'comment ' * 80}</p></div>
<form><p>Sign up</p></form><footer><p>&copy; all</p></footer></body></html>"""


def test_article(spark):
    body = "<h2>Head &amp; line</h2><p>One&nbsp;two\n three<br>four <b>bold</b> a&#x41;b<!-- no --></p><ul><li>item 1<li>item 2</ul><p>last &lt;b&gt;"
    want = "Head & line\nOne two three four bold aAb\nitem 1\nitem 2\nlast <b>"
    data = [(i, f"https://h.example.org/{i}", page(body.replace("last", f"last {i}")), "x", "y", "z") for i in range(5)]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: want.replace("last", f"last {i}") for i in range(5)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_consensus_helps_a_short_page(spark):
    """A page whose own best container is a long list of links text; its host's path gives the article."""
    long = "<p>" + "words of the article go on and on here. " * 20 + "</p>"
    odd = page("<p>Short text.</p>").replace("<div id=\"comments\">", "<div class='links'><p>" + "related thing to read elsewhere today " * 30 + "</p></div><div id=\"comments\">")
    data = [(i, "https://h.example.org/a", page(long), "", "", "") for i in range(4)] + [(9, "https://h.example.org/b", odd, "", "", "")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[9] == "Short text."
    alone = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(data[-1:], SCHEMA)).collect()}
    assert alone[9] != "Short text."


def test_a_host_of_many_templates(spark):
    """Every template of a host has its own winning path, however many there are."""
    long = "<p>" + "words of the article go on and on here. " * 20 + "</p>"
    links = "<div class='links'><p>" + "another thing to read elsewhere today " * 30 + "</p></div>"
    data = [(i, "https://h.example.org/a", page(long, f"div class='{'abcdefgh'[i % 8]}-template'"), "", "", "") for i in range(32)]
    data += [(100, "https://h.example.org/b", page("<p>Short text.</p>", "div class='h-template'").replace('<div id="comments">', links + '<div id="comments">'), "", "", "")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[100] == "Short text."


def test_edges(spark):
    data = [(1, None, None, "", "", ""), (2, "", "", "", "", ""), (3, "nonsense", "no markup at all", "", "", ""), (4, "http://h/", "<p>a<p>b<div>c", "", "", ""), (5, "http://h/", "<" * 5000 + "<script>", "", "", ""), (6, "http://h/", "<div>" * 3000 + "deep" + "</div>" * 3000, "", "", ""), (None, "http://h/", "<p>" + "long text " * 200_000, "", "", ""), (4, "http://h/", "<p>a<p>b<div>c", "", "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    got = html_text.main_text(df).collect()
    assert len(got) == len(data)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == by_id[2]["text"] == "" and by_id[1]["url"] is None and by_id[1]["n_chars"] == 0
    assert by_id[3]["text"] == "no markup at all" and by_id[4]["text"] == "a\nb\nc" and by_id[6]["text"] == "deep"
    assert len(by_id[None]["text"]) == 10 * 200_000 - 1
    assert html_text.main_text(df.limit(0)).collect() == []


def test_hosts_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    few = sorted(map(tuple, html_text.main_text(df).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_CHARS", -1)
    assert sorted(map(tuple, html_text.main_text(df).collect())) == few
