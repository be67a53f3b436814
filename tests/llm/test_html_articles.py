"""Articles keep all their blocks; the query against a plain restatement over all pages; broken pages end soon."""

from __future__ import annotations

import html
import re
import time
from collections import Counter, defaultdict

import pytest

from procura.llm import html_text
from procura.llm.html_text import extract

LONG = "words of the article go on and on here, sentence after sentence, until nobody reads them any more. " * 3
LONG = LONG.strip()
SCHEMA = "page_id bigint, url string, html string"


def test_every_node_of_the_winning_path(spark):
    """Two posts on one page of a host whose other pages have one."""
    two = f"<body><div class=post>{LONG} A</div><div class=post>{LONG} B</div></body>"
    data = [(i, "https://h.org/a", f"<body><div class=post>{LONG} {i}</div><div class=x>short</div></body>") for i in range(4)] + [(9, "https://h.org/b", two)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[9] == f"{LONG} A\n{LONG} B" == extract(two, None)


@pytest.mark.parametrize("page", [
    f"<body><h1>Title</h1><div class=content>{LONG}</div></body>", f"<body><div class=top><a href=/>Home</a></div><div class=title><h1>Title</h1></div><div class=content><p>{LONG}</p></div></body>",
    f"<body><nav><h1>Site</h1></nav><div class=wrap><h1>Title</h1><div class=row><div class=content>{LONG}</div></div></div></body>",
])
def test_titles_beside_the_container(page, spark):
    assert extract(page, None) == f"Title\n{LONG}"
    data = [(i, "https://h.org/a", page) for i in range(4)]
    assert {r["text"] for r in html_text.main_text(spark.createDataFrame(data, SCHEMA)).collect()} == {f"Title\n{LONG}"}


def test_leads_beside_the_container():
    assert extract(f"<body><div class=wrap><h1>Title</h1><p>lead</p><p><a href=/>all links</a></p><article>{LONG}</article></div></body>", None) == f"Title\nlead\n{LONG}"
    assert extract(f"<body><h1>Site name</h1><article><h1>Title</h1><p>{LONG}</p></article></body>", None) == f"Title\n{LONG}"


@pytest.mark.parametrize("part", ["<p class='notice-text'>", "<section class='social-history'>", "<div class='rail-transport'>", "<div id='share-prices'>", "<div class='menu-of-the-day'>"])
def test_words_inside_articles(part):
    tag = re.match(r"<(\w+)", part)[1]
    assert extract(f"<body><article><p>{LONG}</p>{part}{LONG} too</{tag}></article></body>", None) == f"{LONG}\n{LONG} too"
    links = "<a href=/>one to share</a> <a href=/>another to share</a> " * 9
    assert extract(f"<body><article><p>{LONG}</p>{part}Share this</{tag}>{part}{links}</{tag}></article></body>", None) == LONG


@pytest.mark.parametrize("part", ["<section id='responses'>", "<div class='comments'>", "<div class='comment-list share'>", "<aside class='notice'>", "<div class='advert'>"])
def test_readers_and_adverts_stay_out(part):
    tag = re.match(r"<(\w+)", part)[1]
    assert extract(f"<body><article><p>{LONG}</p>{part}{LONG} said a reader</{tag}></article></body>", None) == LONG


@pytest.mark.parametrize("tag", ["<span class=ad>", "<svg>", "<noscript>", "<blockquote>", "<iframe>", "<span class=ad><p>", "</p></div>", "<select><option>", "<dl><dd>"])
def test_a_megabyte_without_ends(tag):
    began = time.process_time()
    text = extract("<body><p>start</p>" + tag * (1_000_000 // len(tag)) + "end</body>", None)
    assert time.process_time() - began < 8 and "end" in text


def plain_pages(rows):
    """Votes and extraction again, with dictionaries."""
    votes, pages = defaultdict(Counter), defaultdict(Counter)
    host = lambda url: (re.findall(html_text.HOST, url or "") or [""])[0].lower()
    for _, url, page in rows:
        if page:
            path, value = html_text.vote(page)
            votes[host(url)][path] += round(value * 1000)
            pages[host(url)][path] += 1
    for i, url, page in rows:
        own = votes[host(url)]
        total = sum(own.values())
        won = sorted((-v, p) for p, v in own.items() if pages[host(url)][p] >= html_text.MIN_VOTES and v >= html_text.MIN_SHARE * total)
        yield i, extract(page or "", [p for _, p in won])


def test_all_pages_against_a_restatement(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in df.collect()]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got == dict(plain_pages(rows))
    # what is written between the tags of the article, block by block
    said = 0
    for i, _, page in rows:
        m = re.search("(?s)<article>(.*)</article>", page or "")
        if m:
            blocks = [" ".join(html.unescape(re.sub("(?s)<!--.*?-->|<[^>]*>", "", re.sub("<br[^>]*>", " ", b))).split()) for b in re.split(r"</?(?:p|h\d|ul|ol|li|div|table|tr|td|th|blockquote|pre|section|figure|figcaption)\b[^>]*>", m[1])]
            assert got[i] == "\n".join(b for b in blocks if b), i
            said += 1
    assert said > 100
