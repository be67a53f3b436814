"""Main text of web pages by consensus host paths.

Each page's containers are scored by how much plain text they cover; the best one votes for its
generalised path of tags and classes. Votes are summed per host in Spark, and every page is extracted
again from the container on its host's winning path, or from its own best where it has none of them.

Defined results: null html counts as empty and gives an empty text; a null or odd url has the empty
host; repeated rows vote and are extracted separately; other columns are not read; an empty table gives
an empty table. A line break tag is white space inside its block.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, written

#: Pages that must vote for a path, the share of its host's votes it needs (a host has at most 1 / MIN_SHARE winners), and
#: characters of hosts and winning paths up to which they are broadcast.
MIN_VOTES = 2
MIN_SHARE = 0.01
BROADCAST_CHARS = 16 << 20

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg select object audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot caption option legend button".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("html body table td th ul ol dl article section div main aside nav header footer form".split())

#: What is no part of an article.
JUNK_TAGS = frozenset("nav footer aside form head dialog menu button fieldset search".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
JUNK_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist reply replies respond responses disqus cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations pagination pager toolbar widget widgets login skip alert toast copyright".split())
#: Words that inside an article, or a main, tell of junk only where a block is short or mostly links: they are words of articles, too.
MILD_WORDS = frozenset("notice notices rail menu share sharing social alert notification toast skip banner widget widgets toolbar promotion promo recommended recommendations copyright login signup subscribe navigation".split())
SHORT = 100
#: What says that a class is about the lack or the presence of a part, and not that part.
ABOUT = frozenset("has no with without not".split())
#: Tags whose junk flag can be lifted, as that of words can; raw tags that hold none of their own kind, and those that hold code.
WRAPPERS = frozenset("form fieldset".split())
SINGLE = frozenset("noscript iframe noembed noframes audio video canvas xmp".split())
CODE = frozenset("script style".split())
#: Inline tags that are left out where their class says so.
INLINE = frozenset("span ins small label".split())
GOOD_WORDS = frozenset("article content post entry story main body text prose".split())
CONTAINERS = frozenset("# html article main section div td body center".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by name; one without a value is empty."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}
    if "hidden" in raw.lower() and HIDDEN.search(QUOTED.sub("''", raw)):
        found.setdefault("hidden", "")
    return found


def is_hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


class Ends:
    """Where elements of a page end, found in one pass for each tag that asks; so pages without ends cost no more than others."""

    def __init__(self, page: str):
        self.page = page
        self.pairs: dict[str, dict[int, tuple[int, int]]] = {}
        self.closes: dict[str, list[tuple[int, int]]] = {}
        self.blocks: list[int] | None = None

    def of(self, tag: str, start: int) -> tuple[int, int] | None:
        """(start, end) of the end tag of the element whose start tag begins at a place; elements of its kind inside it are counted."""
        if tag not in self.pairs:
            found, opened = self.pairs.setdefault(tag, {}), []
            for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(self.page):
                if not m[1]:
                    if not m[0].endswith("/>"):
                        opened.append(m.start())
                elif opened:
                    found[opened.pop()] = m.span()
        return self.pairs[tag].get(start)

    def next(self, tag: str, at: int) -> tuple[int, int] | None:
        """(start, end) of the first end tag of a kind from a place on."""
        if tag not in self.closes:
            self.closes[tag] = [m.span() for m in re.compile(rf"</{tag}\s*>?", re.I).finditer(self.page)]
        closes = self.closes[tag]
        place = bisect_left(closes, (at, 0))
        return closes[place] if place < len(closes) else None

    def has_block(self, at: int, end: int) -> bool:
        if self.blocks is None:
            self.blocks = [m.start() for m in TOKEN.finditer(self.page) if m[2] and m[2].lower() in BLOCK]
        place = bisect_left(self.blocks, at)
        return place < len(self.blocks) and self.blocks[place] < end


class Node:
    __slots__ = ("tag", "parent", "label", "junk", "good", "depth", "inside", "covered", "named", "commented", "mild")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.good = self.junk = self.named = self.commented = self.mild = False
        self.covered = 0.0
        self.label = tag
        if attributes:
            found = attributes_of(attributes)
            names = f"{found.get('class', '')} {found.get('id', '')}"
            words = {w.lower() for w in WORD.findall(names)}
            role = found.get("role", "").lower()
            self.commented = tag == "article" and bool(words & JUNK_WORDS)
            if tag not in ("html", "body", "article", "main"):
                self.named = bool(words & JUNK_WORDS) and junk_words(names)
                self.junk = self.named or role in JUNK_ROLES or is_hidden(found)
                self.mild = self.named and parent.inside and not words & (JUNK_WORDS - MILD_WORDS) and not (role in JUNK_ROLES or is_hidden(found))
            self.good = bool(words & GOOD_WORDS) or role in ("main", "article") or found.get("itemprop") == "articleBody"
            first = found.get("class", "").split()
            self.label = f"{tag}.{DIGITS.sub('#', first[0]).replace('/', '|')}" if first else tag
        if tag in JUNK_TAGS or (tag == "header" and not (parent and parent.inside)):
            self.junk, self.mild = True, False
            self.named = tag in WRAPPERS

    def path(self) -> str:
        names, node = [], self
        while node:
            names.append(node.label)
            node = node.parent
        return "/".join(reversed(names))


def junk_words(names: str) -> bool:
    """Whether a class or id has a junk word that no earlier part of it takes back, as in has-sidebar."""
    for name in names.split():
        for word in map(str.lower, WORD.findall(name)):
            if word in ABOUT:
                break
            if word in JUNK_WORDS:
                return True
    return False


def settle(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Hands the junk flag down, but not from a named wrapper or form around the article, nor from a part of an article whose name alone speaks against it.

    Such a one holds main, or an article of more text than there is without the flagged parts, or most of the page's plain text with its first
    heading or with nothing left outside.
    """
    if any(n.named for n in nodes):
        plain, kept, holds, heads = dict.fromkeys(nodes, 0.0), 0.0, set(), set()
        for node, text, linked in blocks:
            plain[node] += max(0.0, len(text) - 2.0 * linked)
        flagged: set[Node] = set()
        for node in nodes:  # a parent stands before its children
            if node.junk or node.parent in flagged:
                flagged.add(node)
            else:
                kept += plain[node]
        for node in reversed(nodes):
            if node.parent:
                plain[node.parent] += plain[node]
                if node in holds or node.tag == "main" or (node.tag == "article" and not node.commented and plain[node] > kept):
                    holds.add(node.parent)
                if node in heads or node.tag == "h1":
                    heads.add(node.parent)
        total = plain[nodes[0]]
        for node in nodes:
            if node.mild and plain[node] >= SHORT:
                node.junk = False
            if node.named and (node in holds or (plain[node] > total / 2 and (node in heads or not kept))):
                node.junk = False
    for node in nodes:
        if node.parent and node.parent.junk:
            node.junk = True


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Nodes in page order, and blocks (node, text, characters inside links) in page order."""
    root = Node("#", None, "")
    stack, nodes, blocks = [root], [root], []
    pieces: list[str] = []
    linked, links = 0, 0
    ends, opened = Ends(page), Counter()

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append((stack[-1], text, linked))
        linked = 0

    def pop_to(tags: set[str] | frozenset[str], barrier: frozenset[str] = frozenset()) -> None:
        """Closes the innermost of these tags and what is open inside it, unless a barrier stands before it."""
        if not any(opened[t] for t in tags):
            return
        for at in range(len(stack) - 1, 0, -1):
            tag = stack[at].tag
            if tag in tags:
                opened.subtract(x.tag for x in stack[at:])
                del stack[at:]
                return
            if tag in barrier:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                pop_to({tag})
            continue
        if tag in RAW:
            close = ends.next(tag, at) if tag in CODE or tag in SINGLE or tag in ("textarea", "title") else ends.of(tag, m.start())
            if tag in CODE:
                at = close[1] if close else end
            elif close and not m[3].endswith("/") and not (tag in SINGLE and re.compile(rf"<{tag}[\s/>]", re.I).search(page, at, close[0])):
                at = close[1]
            pieces.append(" ")
            continue
        if tag == "a":
            links += 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in BLOCK:
            if tag in INLINE and m[3] and not m[3].endswith("/"):
                found = attributes_of(m[3])
                if is_hidden(found) or junk_words(f"{found.get('class', '')} {found.get('id', '')}"):
                    close = ends.of(tag, m.start())
                    # one without an end, or with blocks inside, is as any other
                    if close and close[0] >= at and not ends.has_block(at, close[0]):
                        at = close[1]
                        pieces.append(" ")
            continue
        flush()
        links = 0
        if tag in CLOSES_P:
            pop_to({"p"}, SCOPE)
        if tag in SIBLINGS:
            pop_to(SIBLINGS[tag], frozenset({"table", "ul", "ol", "dl", "select"}))
        if tag in VOID:
            continue
        node = Node(tag, stack[-1], m[3])
        stack.append(node)
        nodes.append(node)
        opened[tag] += 1
    flush()
    settle(nodes, blocks)
    return nodes, blocks


def score(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> tuple[Node, float]:
    """The best container: the share of the page's plain text it covers, what it is named, how deep it is."""
    total = 0.0
    for node, text, linked in blocks:
        if not node.junk:
            plain = max(0.0, len(text) - 2.0 * linked)
            total += plain
            node.covered += plain
    for node in reversed(nodes):  # a parent stands before its children
        if node.parent:
            node.parent.covered += node.covered
    best, most = nodes[0], -1.0
    for node in nodes:
        if node.tag in CONTAINERS and not node.junk:
            share = node.covered / total if total else 0.0
            value = share * (1.0 + 0.5 * (node.tag in ("article", "main")) + 0.25 * node.good) + (0.01 * node.depth if share > 0.9 else 0.0)
            if value > most:
                best, most = node, value
    return best, most


def vote(page: str) -> tuple[str, float]:
    nodes, blocks = parse(page)
    best, value = score(nodes, blocks)
    return best.path(), value


def before_it(chosen: Node, nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> set[int]:
    """Places of the blocks that stand between the title and a container without one: the nearest first heading before it, and plain text from there on.

    The heading is looked for among what the container's parents hold, up to three of them.
    """
    above, parent = [], chosen.parent
    while parent and parent.tag != "#" and len(above) < 3 and not parent.junk:
        above.append(parent)
        parent = parent.parent

    def within(node: Node, holder: Node) -> bool:
        while node and node.depth > holder.depth:
            node = node.parent
        return node is holder

    def heading(node: Node) -> bool:
        while node and node.tag != "h1" and node.tag not in CONTAINERS:
            node = node.parent
        return bool(node) and node.tag == "h1"

    own = [i for i, (node, _, _) in enumerate(blocks) if within(node, chosen)]
    if not own or any(heading(blocks[i][0]) for i in own):
        return set()
    for holder in above:
        title = next((i for i in range(own[0] - 1, -1, -1) if heading(blocks[i][0]) and not blocks[i][0].junk and within(blocks[i][0], holder)), None)
        if title is not None:
            return {i for i in range(title, own[0]) if not blocks[i][0].junk and within(blocks[i][0], holder) and 2 * blocks[i][2] <= len(blocks[i][1])}
    return set()


def extract(page: str, paths: list[str] | None) -> str:
    """Blocks of all containers on the first of the paths that the page has, else of its own best one, from the title on."""
    nodes, blocks = parse(page)
    best, _ = score(nodes, blocks)
    chosen = [best]
    for path in paths or ():
        depth = path.count("/")
        there = [n for n in nodes if n.depth == depth and n.tag in CONTAINERS and not n.junk and n.covered > 0 and n.path() == path]
        if there:
            chosen = there
            break
    inside = set(chosen)
    for node in nodes:
        if node.parent in inside:
            inside.add(node)
    led = before_it(chosen[0], nodes, blocks)
    return "\n".join(text for i, (node, text, _) in enumerate(blocks) if not node.junk and (node in inside or i in led))


def pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1))
    return df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def host_paths(rows: DataFrame) -> DataFrame:
    """host and its winning paths, the strongest first."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [vote(h) for h in part.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("host"), pa.array([p for p, _ in found]), pa.array([v for _, v in found], pa.float64())], names=["host", "path", "value"])

    votes = map_slices(rows.where("html != ''").select("host", "html"), run, "host string, path string, value double")
    # votes are sums of thousandths: the order of adding can't change a winner
    summed = written(votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("votes")))
    totals = summed.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    winners = summed.where(F.col("pages") >= MIN_VOTES).join(totals, "host").where(F.col("votes") >= MIN_SHARE * F.col("all_votes"))
    lists = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("place"), "path"))), lambda x: x["path"])
    return winners.groupBy("host").agg(lists.alias("paths"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The winners are broadcast while they are small, which is measured; beyond that the pages are joined with
    them by host, where adaptive execution splits a hot host.
    """
    rows = pages(df, id_col, url_col, html_col)
    winners = written(host_paths(rows))
    size = winners.agg(F.sum(F.length("host") + F.length(F.array_join("paths", "/")) + 64)).first()[0] or 0
    if size <= BROADCAST_CHARS:
        winners = F.broadcast(winners)
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("paths").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_slices(joined, run, "page_id bigint, url string, text string, n_chars long")
