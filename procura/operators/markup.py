"""Pages as arrays of elements: one pass parses a page into a row, expressions answer questions about it.

`parsed` gives per page its text and its elements in document order; an element knows its parent, its next
sibling and which stretch of the text it holds. `selected` answers many CSS selectors in one pass over
the tags: all steps of all selectors are bits of one number, and what an element matches follows from the
bits of its parent and its ancestors.

Text keeps characters as they are but runs of white space, which become one blank, or one line end where a
block begins or ends. End tags that are left out are put in where a block, list item, row or cell begins; an
end tag without a start is ignored. Scripts and styles have no text. A null or empty page has none either.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: What the start of an element ends, if it is open below the nearest of the elements that bound it.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HOLDERS = {"td", "th", "table", "button", "li", "dd", "dt"}
SILENT = {"script", "style", "noscript", "template"}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: int
    start: int
    end: int = 0
    linked: int = 0
    next: int | None = None


class Page(HTMLParser):
    """Elements of a page in document order; `opened` is told of each with its place."""

    def __init__(self, opened=None):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open: list[int] = []
        self.parts: list[str] = []
        self.size, self.gap, self.silent, self.links = 0, "", 0, 0
        self.last_child: dict[int, int] = {}
        self.opened = opened

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        elif tag in BLOCKS and tag != "title":
            self.end_open({"p"}, HOLDERS)
        if tag in BLOCKS or tag == "br":
            self.gap = "\n" if self.size else ""
        place, parent = len(self.elements), self.open[-1] if self.open else -1
        own = Element(tag, {k: v or "" for k, v in reversed(attrs)}, parent, -1)
        if parent in self.last_child:
            self.elements[self.last_child[parent]].next = place
        self.last_child[parent] = place
        self.elements.append(own)
        if self.opened:
            self.opened(place, own)
        if tag in VOID:
            return
        self.open.append(place)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end_open(self, tags: set[str], bounds: set[str]) -> None:
        """Ends the lowest open element of these tags, and all in it, unless a bound comes first."""
        last = None
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.elements[self.open[at]].tag
            if tag in tags:
                last = at
            if tag in bounds or tag in tags and tags == {"p"}:
                break
        if last is not None:
            self.close_to(last)

    def close_to(self, at: int) -> None:
        while len(self.open) > at:
            own = self.elements[self.open.pop()]
            own.end = self.size
            if own.start < 0:
                own.start = self.size
            self.silent -= own.tag in SILENT
            self.links -= own.tag == "a"
            if own.tag in BLOCKS:
                self.gap = "\n" if self.size else ""

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[at]].tag == tag:
                self.close_to(at)
                return

    def handle_data(self, data):
        if self.silent:
            return
        words = data.split()
        if not words:
            self.gap = self.gap or (" " if data and self.size else "")
            return
        if data[0].isspace() and self.size:
            self.gap = self.gap or " "
        said = self.gap + " ".join(words)
        begin = self.size + len(self.gap)
        self.parts.append(said)
        self.size += len(said)
        self.gap = " " if data[-1].isspace() else ""
        for place in self.open:
            own = self.elements[place]
            if own.start < 0:
                own.start = begin
            if self.links:
                own.linked += self.size - begin

    def read(self, text: str | None) -> Page:
        self.feed(text or "")
        self.close()
        self.close_to(0)
        for own in self.elements:
            if own.start < 0:  # void
                own.start = own.end = 0
        return self

    @property
    def text(self) -> str:
        return "".join(self.parts)


REFERENCE = re.compile(r"&(#\d+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def ended_only(text: str | None) -> str:
    """A page whose references without a semicolon (`&amp</p>`), which parsers resolve like others, stay as they are written."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], text or "")


NODE = pa.struct([("tag", pa.string()), ("id", pa.string()), ("class", pa.string()), ("href", pa.string()), ("datetime", pa.string()), ("parent", pa.int32()), ("next", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("linked", pa.int32())])
NODES = "array<struct<tag:string,id:string,class:string,href:string,datetime:string,parent:int,next:int,start:int,end:int,linked:int>>"


def parsed(df: DataFrame, markup: str, *keep: str, ended: bool = False) -> DataFrame:
    """The columns to keep, the text of each page and its elements (`nodes`); rows stay in their tasks. With `ended`, only references that end in a semicolon are resolved."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pages = [Page().read(ended_only(t) if ended else t) for t in part.column("__markup").to_pylist()]
                nodes = [[{"tag": e.tag, "id": e.attributes.get("id"), "class": e.attributes.get("class"), "href": e.attributes.get("href"), "datetime": e.attributes.get("datetime"), "parent": e.parent, "next": e.next, "start": e.start, "end": e.end, "linked": e.linked} for e in p.elements] for p in pages]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([p.text for p in pages], pa.string()), pa.array(nodes, pa.list_(NODE))], names=[*keep, "page_text", "nodes"])

    return df.select(*keep, F.col(markup).cast("string").alias("__markup")).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", page_text string, nodes {NODES}")


def text_of(node: Column, text: Column | None = None) -> Column:
    """Text that an element holds."""
    return F.substring(F.col("page_text") if text is None else text, node["start"] + 1, node["end"] - node["start"])


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def tagged(*tags: str) -> Column:
    return F.filter("nodes", lambda n: n["tag"].isin(*tags))


# ---- selectors ----

STEP = re.compile(r"\s*([>+~]?)\s*((?:[#.]?[\w*-]+|\[[^\]]+\])+)")
PART = re.compile(r"([#.]?)([\w*-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*)?\]")


@dataclass(frozen=True)
class Compound:
    """What one element must be: a tag, an id, classes, attributes (name, operator, value); `child` if right below the step before."""

    tag: str
    identity: str | None
    classes: tuple[str, ...]
    attributes: tuple[tuple[str, str | None, str], ...]
    child: bool

    def fits(self, e: Element) -> bool:
        own = e.attributes
        return (
            self.tag in ("*", e.tag) and (self.identity is None or own.get("id") == self.identity)
            and (not self.classes or set(self.classes) <= set(own.get("class", "").split())) and all(test(own.get(n), op, v) for n, op, v in self.attributes)
        )


def test(held: str | None, op: str | None, value: str) -> bool:
    if held is None or op is None:
        return held is not None
    if op in ("^=", "$=", "*=") and not value:
        return False
    return {"=": held == value, "~=": value in held.split(), "^=": held.startswith(value), "$=": held.endswith(value), "*=": value in held, "|=": held == value or held.startswith(value + "-")}[op]


def compiled(selector: str) -> list[list[Compound]]:
    """Steps of each of a selector's alternatives; raises ValueError for what is not known."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps, at = [], 0
        while at < len(alternative.rstrip()):
            m = STEP.match(alternative, at)
            if not m or m[1] in ("+", "~") or m[1] and not steps:
                raise ValueError(f"selector not understood: {selector}")
            tag, identity, classes, attributes = "*", None, [], []
            for p in PART.finditer(m[2]):
                if p[3]:
                    attributes.append((p[3].lower(), p[4], next((v for v in (p[5], p[6], p[7]) if v is not None), "")))
                elif p[1] == "#":
                    identity = p[2]
                elif p[1] == ".":
                    classes.append(p[2])
                else:
                    tag = p[2].lower()
            steps.append(Compound(tag, identity, tuple(classes), tuple(attributes), m[1] == ">"))
            at = m.end()
        if not steps:
            raise ValueError(f"selector not understood: {selector}")
        out.append(steps)
    return out


class Automaton:
    """All steps of all selectors as bits; an element's bits follow from its own, its parent's and its ancestors'."""

    def __init__(self, selectors: dict[str, str]):
        self.names = list(selectors)
        self.steps: list[Compound] = []
        self.starts = self.child = self.below = 0
        self.ends: dict[int, int] = {}
        for number, selector in enumerate(selectors.values()):
            for steps in compiled(selector):
                for i, step in enumerate(steps):
                    bit = 1 << len(self.steps)
                    if i == 0:
                        self.starts |= bit
                    elif step.child:
                        self.child |= bit
                    else:
                        self.below |= bit
                    self.steps.append(step)
                self.ends[len(self.steps) - 1] = number
        self.by_tag: dict[str, list[int]] = {}
        for i, step in enumerate(self.steps):
            self.by_tag.setdefault(step.tag, []).append(i)

    def matches(self, page: str | None) -> tuple[Page, list[tuple[int, int]]]:
        """The page, and (place of the element, number of the selector) of all matches."""
        own: list[int] = []
        ancestors: list[int] = []
        found: list[tuple[int, int]] = []

        def opened(place: int, e: Element) -> None:
            up, above = (own[e.parent], ancestors[e.parent] | own[e.parent]) if e.parent >= 0 else (0, 0)
            possible = self.starts | self.child & up << 1 | self.below & above << 1
            bits = 0
            for i in (*self.by_tag.get(e.tag, ()), *self.by_tag.get("*", ())):
                if possible >> i & 1 and self.steps[i].fits(e):
                    bits |= 1 << i
            own.append(bits)
            ancestors.append(above)
            found.extend((place, n) for n in sorted({self.ends[i] for i in self.ends if bits >> i & 1}))

        return Page(opened).read(page), found


MATCH = pa.list_(pa.struct([("selector", pa.string()), ("place", pa.int32()), ("text", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))]))


def selected(df: DataFrame, markup: str, selectors: dict[str, str], *keep: str) -> DataFrame:
    """A row for each element that a named CSS selector matches: the columns to keep, selector, place, text, attributes.

    Selectors take tags, `*`, `#id`, `.class`, `[attribute]` with =, ~=, ^=, $=, *=, |=, blanks, `>` and commas;
    others are refused when the query is made.
    """
    automaton = Automaton(selectors)
    kinds = {c: df.schema[c].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for markup_ in part.column("__markup").to_pylist():
                    page, found = automaton.matches(markup_)
                    text = page.text
                    rows.append([{"selector": automaton.names[n], "place": p, "text": text[(e := page.elements[p]).start : e.end], "attributes": list(e.attributes.items())} for p, n in found])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, MATCH)], names=[*keep, "found"])

    rows = df.select(*keep, F.col(markup).cast("string").alias("__markup")).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", found array<struct<selector:string,place:int,text:string,attributes:map<string,string>>>")
    return rows.select(*keep, F.inline("found"))


def first_texts(df: DataFrame, markup: str, selectors: dict[str, str], *keep: str) -> DataFrame:
    """One row per row with the text of the first match of each selector, null without any; `keep` must tell rows apart."""
    firsts = [F.min_by(F.when(F.col("selector") == name, F.col("text")), F.when(F.col("selector") == name, F.col("place"))).alias(name) for name in selectors]
    return df.select(*keep).join(selected(df, markup, selectors, *keep).groupBy(*keep).agg(*firsts), list(keep), "left")


# ---- records of detail pages ----

#: Words of areas and of titles, labels of dates, amounts and purchasers, and forms of amounts and dates.
AREAS = ("content", "main", "article", "detail", "body")
TITLE_WORDS = "招标|采购|中标|成交|公告|公示|项目"
DATE_LABELS = "发布时间|发布日期|公告日期|时间|日期"
AMOUNT_LABELS = "预算|金额"
PURCHASER_LABELS = "采购人|招标人|采购单位|招标单位|业主|采购方|招标方|需求方|甲方"
AMOUNT = r"([¥￥]?\d[\d,]*(?:\.\d+)?\s*(?:亿元|万元|亿|万|元)?)"
DATE = r"(\d{4}[-/年.]\d{1,2}[-/月.]\d{1,2}日?)"


def labelled_values(labels: str) -> Column:
    """Values that stand beside a label: the cell or definition after it, or what follows a colon in its own cell or paragraph."""
    named = F.filter("nodes", lambda n: n["tag"].isin("th", "td", "dt", "b", "strong", "span", "label") & F.length(text_of(n)).between(2, 20) & text_of(n).rlike(labels) & n["next"].isNotNull())
    beside = F.transform(named, lambda n: text_of(F.get(F.col("nodes"), n["next"])))
    inline = F.regexp_extract_all("page_text", F.lit(rf"(?:{labels})[^：:\n]{{0,12}}[：:][ \t]*([^\n]+)"), F.lit(1))
    return F.filter(F.concat(beside, inline), lambda v: F.trim(v) != "")


def main_node() -> Column:
    """The element with the main content: an article, a main, one whose id or class names an area, or the smallest block with most of the text outside links."""
    blocks = F.filter("nodes", lambda n: n["tag"].isin("div", "section", "td"))
    told = lambda n: n["end"] - n["start"] - n["linked"]
    most = F.array_max(F.transform(blocks, told))
    dense = F.filter(blocks, lambda n: told(n) >= most * 0.6)
    smallest = F.array_min(F.transform(dense, lambda n: F.struct((n["end"] - n["start"]).alias("size"), (-n["start"]).alias("late"), n.alias("n"))))["n"]

    def called(attribute: str, word: str) -> Column:
        return first(F.filter("nodes", lambda n: F.contains(F.lower(n[attribute]), F.lit(word)) & ~n["tag"].isin("body", "html")))

    named = [called(attribute, word) for attribute in ("id", "class") for word in AREAS]
    return F.coalesce(first(tagged("article")), first(tagged("main")), *named, smallest, first(tagged("body")), first(F.col("nodes")))


def records(df: DataFrame, markup: str, *keep: str, date_of, amount_of, size: Callable[[Column], Column] = F.length, ended: bool = False) -> DataFrame:
    """title, publish_date, budget_amount, tenderer, description and content of detail pages, null where a page does not say.

    date_of and amount_of turn a found text into a date and an amount. What stands beside a label comes
    first, then the main content. A title is the first heading, or a line that speaks of a tender before one
    that does not; a line holds no further blocks. `size` says how long a title is; `ended` is that of `parsed`.
    """
    pages = parsed(df, markup, *keep, ended=ended).withColumn("__main", main_node()).withColumn("content", F.nullif(text_of(F.col("__main")), F.lit("")))
    heading = text_of(first(tagged("h1")))
    plain = F.when(size(heading).between(6, 199), heading)
    speaking = first(F.filter(F.transform(tagged("h1", "h2", "h3", "div", "p"), lambda n: text_of(n)), lambda t: size(t).between(11, 199) & t.rlike(TITLE_WORDS) & ~F.contains(t, F.lit("\n"))))
    tab = F.trim(F.regexp_extract(text_of(first(tagged("title"))), r"^([^_\-\\／]*)", 1))
    title = F.coalesce(F.when(plain.rlike(TITLE_WORDS), plain), speaking, plain, F.when(size(tab) > 5, tab))
    time = first(tagged("time"))
    dates = F.concat(F.filter(F.array(time["datetime"], text_of(time)), lambda x: x.isNotNull()), labelled_values(DATE_LABELS), F.array(F.coalesce("content", F.lit(""))))
    day = first(F.filter(F.transform(dates, lambda t: F.regexp_extract(t, DATE, 1)), lambda x: x != ""))
    amounts = F.concat(labelled_values(AMOUNT_LABELS), F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(rf"(?:{AMOUNT_LABELS})[^\d¥￥\n]{{0,12}}{AMOUNT}"), F.lit(1)))
    amount = first(F.filter(F.transform(amounts, lambda t: F.regexp_extract(t, AMOUNT, 1)), lambda x: x != ""))
    buyer = first(F.filter(F.transform(labelled_values(PURCHASER_LABELS), lambda t: F.trim(F.regexp_replace(F.regexp_extract(t, r"^([^\n，。；;]+)", 1), r"\s*(?:联系电话|地址|联系人|电话|邮编).*", ""))), lambda v: F.length(v).between(3, 99)))
    within = lambda n: n["tag"].isin("p", "div") & (n["start"] >= F.col("__main.start")) & (n["end"] <= F.col("__main.end"))
    paragraphs = F.filter(F.transform(F.filter("nodes", within), lambda n: text_of(n)), lambda t: F.length(t) > 20)
    description = F.nullif(F.substring(F.array_join(F.slice(paragraphs, 1, 10), "\n\n"), 1, 5000), F.lit(""))
    return pages.select(*keep, title.alias("title"), date_of(day).alias("publish_date"), amount_of(amount).alias("budget_amount"), buyer.alias("tenderer"), description.alias("description"), "content")


# ---- main documents ----

#: Words of a main document's link, the strongest first, and of the areas around it.
MAIN_WORDS = ("公告", "正文", "文件下载", "下载附件", "招标公告", "中标公告", "采购公告", "项目公告", "查看详情", "document", "download", "公告正文", "采购文件")
MAIN_AREAS = ("content", "main", "detail", "article", "body")
NEAR, IN_AREA = 3, 5
#: Hosts that no link may lead to.
PRIVATE = r"^(?:localhost|.*\.local|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|\[)"


def safe_link(link: Column) -> Column:
    """Whether a link leads by http or https to a host that is not of a private network."""
    host = F.regexp_extract(link, r"^(?i:https?)://(?:[^/@?#]*@)?([^/:?#]+|\[[^\]]*\])", 1)
    return F.coalesce((host != "") & ~F.lower(host).rlike(PRIVATE), F.lit(False))


def absolute(link: Column, page: Column) -> Column:
    """A link as seen from a page's address."""
    scheme, site = F.regexp_extract(page, r"^([a-zA-Z]+:)//", 1), F.regexp_extract(page, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(page, r"^([a-zA-Z]+://[^?#]*/)[^/?#]*", 1)
    folder = F.when(F.length(folder) > F.length(site), folder).otherwise(F.concat(site, F.lit("/")))
    return F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(site, link)).otherwise(F.concat(folder, link))


def main_documents(df: DataFrame, key: str, url: str, markup: str) -> DataFrame:
    """(key, attachment, name, score) of the document a page is about, among its links to PDF files that are safe to follow.

    Words of a link count by their rank, and so does a content area among the elements right around it. A
    page whose only candidate has no such sign still gives that one.
    """
    pages = parsed(df, markup, key, url)
    up = lambda n: F.get(F.col("nodes"), n["parent"])
    around = lambda n: reduce(lambda held, _: [*held, up(held[-1])], range(NEAR - 1), [up(n)])
    names = lambda n: F.lower(F.concat_ws(" ", n["class"], n["id"]))
    area = lambda n: reduce(lambda a, b: a | b, (F.coalesce(names(x).rlike("|".join(MAIN_AREAS)), F.lit(False)) for x in around(n)))
    words = lambda n: text_of(n)
    speaks = lambda n: reduce(lambda a, b: a + b, (F.when(F.contains(words(n), F.lit(w)) | F.contains(n["href"], F.lit(w)), F.lit(len(MAIN_WORDS) - i)).otherwise(0) for i, w in enumerate(MAIN_WORDS)))
    pdfs = F.filter("nodes", lambda n: (n["tag"] == "a") & (F.coalesce(n["href"], F.lit("")) != "") & (F.endswith(F.lower(n["href"]), F.lit(".pdf")) | F.contains(F.lower(words(n)), F.lit(".pdf"))))
    told = F.transform(pdfs, lambda n, i: F.struct((speaks(n) + F.when(area(n), IN_AREA).otherwise(0)).cast("long").alias("score"), (-i).alias("early"), absolute(n["href"], F.col(url)).alias("attachment"), F.coalesce(F.nullif(words(n), F.lit("")), F.lit("document.pdf")).alias("name")))
    safe = F.filter(told, lambda x: safe_link(x["attachment"]))
    rows = pages.select(F.col(key).cast("long").alias("key"), safe.alias("found")).select("key", F.size("found").alias("n"), F.array_max("found").alias("best"))
    return rows.where((F.col("best.score") > 0) | (F.col("n") == 1)).select("key", "best.attachment", "best.name", "best.score")
