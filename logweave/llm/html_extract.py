"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes text blocks (runs of text between block-level tags) and marked elements (those whose tag,
role or names say what they hold). Both are nodes of one graph:

* terminal capacities are the costs of a classifier. A block's come from its own words, links, end, tag
  and form controls nearby; a marked element's from its mark, firm ones (nav, footer, comments, ...) far
  above loose ones (related, promo, ...);
* smoothness edges tie each block to the nearest marked element around it, neighbouring blocks by their
  distance in the tree, and successive blocks of one parent.

A maximum flow finds the labelling of least total cost; the blocks on the content side are the text. No
mark decides alone: many firm sentences turn a loosely marked element over, and a short line follows its
neighbours. Only whole names count (``related-work`` is not ``related``), and only block elements carry them.

Parsing and graph are linear in the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import fresh, table

#: Tag classes of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas noembed xmp".split())
BOILER_TAGS = frozenset("nav footer aside form select menu dialog head".split())
MAIN_TAGS = frozenset(("article", "main"))
CONTROLS = frozenset("input button select textarea".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog menu form alert".split())
#: Names that say boilerplate for sure, and those that may mislead; names of main text; and what may stand beside them in one name.
FIRM_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pager pagination respond sidebar signup sponsored subscribe subscription toolbar topbar".split())
LOOSE_NAMES = frozenset("banner header notice notices overlay popular popup privacy promo promoted promotion recommended related replies reply search share sharing skip social sponsor tags teaser trending widget".split())
MAIN_NAMES = frozenset("article articlebody body content entry main maincontent post postbody prose story text".split())
PLAIN_NAMES = frozenset("area bar bottom box block btn buttons card center col column container form global group holder icons id inner item items js left links list mobile outer page panel primary right row secondary section site slot sticky sub top unit wrap wrapper".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_UNSEEN = re.compile(r"type\s*=\s*[\"']?(?:hidden|checkbox)", re.I)
_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=\d)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
#: The classifier's log-odds of a block by its own text.
WEIGHTS = {"bias": -1.0, "length": 0.8, "sentence": 0.6, "p": 0.8, "heading": 0.4, "links": -3.5, "control": -2.5, "legal": -2.0}
#: Costs of going against a mark, for the element itself, and the ties between nodes.
FIRM, LOOSE, MAIN = 40.0, 5.0, 12.0
HELD, ADJACENT, SIBLING, ACROSS = 3.0, 0.6, 0.5, 0.1
#: Capacities are integers: hundredths.
SCALE = 100


class Frame:
    """An open block element: its nearest marked element (a node number, -1: none), whether it hides its text, its open inline elements and whether it has form controls."""

    __slots__ = ("controls", "held", "hidden", "inline", "last", "mark", "opened", "tag")

    def __init__(self, tag: str, mark: int, hidden: bool):
        self.tag, self.mark, self.hidden = tag, mark, hidden
        self.inline: list[tuple[str, bool]] = []
        self.opened: dict[str, int] = {}
        self.controls = False
        self.last, self.held = -1, 0  # the last text block right below it, and their number


class Block:
    """A text block: its element and the one around it, its depth, and its distance in the tree from the block before."""

    __slots__ = ("apart", "depth", "frame", "linked", "outer", "parts", "sibling", "text")

    def __init__(self, frame: Frame, outer: Frame, depth: int, apart: int):
        self.frame, self.outer, self.depth, self.apart = frame, outer, depth, apart
        self.parts, self.linked, self.text, self.sibling = [], 0, "", -1


def named(attributes: str) -> tuple[float, bool]:
    """What the attributes of an element say (log-odds of its mark, 0 for none), and whether it is hidden."""
    mark, hidden = 0.0, False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDING.search(value):
            hidden = True
        elif name == "role":
            mark = -FIRM if value in BOILER_ROLES else MAIN if value in ("main", "article") else mark
        elif name in ("class", "id"):
            for word in value.split():
                parts = {x for x in _PART.split(word) if x and not x.isdigit()}
                if parts <= FIRM_NAMES | LOOSE_NAMES | MAIN_NAMES | PLAIN_NAMES:
                    if parts & FIRM_NAMES:
                        mark = -FIRM
                    elif parts & LOOSE_NAMES:
                        mark = min(mark, -LOOSE)
                    elif not mark and parts & MAIN_NAMES:
                        mark = MAIN
    return mark, hidden


def _tag_end(page: str, at: int) -> int:
    """The place after the ``>`` of a tag whose name ends at ``at``; quoted values may hold one."""
    while m := _STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=" and (close := page.find(m[0], at)) >= 0:
            at = close + 1
    return len(page) + 1


class Page:
    """The text blocks of a page in order, and its marked elements: (log-odds, the marked element around it)."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.marks: list[tuple[float, int]] = []
        self.frames = [Frame("", -1, False)]
        self.now: Block | None = None
        self.links = 0
        self.low = 0  # least depth since the last block
        self.count: dict[str, int] = {}
        self._read(page)
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
        self.blocks = [b for b in self.blocks if b.text]
        for i, b in enumerate(self.blocks):
            b.sibling, b.outer.last = b.outer.last, i
            b.outer.held += 1

    def _text(self, raw: str) -> None:
        top = self.frames[-1]
        if not raw or top.hidden or (top.inline and top.inline[-1][1]):
            return
        if self.now is None:
            if not raw.strip():
                return
            depth = len(self.frames)
            before = self.blocks[-1].depth if self.blocks else depth
            self.now = Block(top, self.frames[-2] if depth > 1 else top, depth, before + depth - 2 * min(self.low, depth))
            self.blocks.append(self.now)
            self.low = depth
        text = html.unescape(raw)
        self.now.parts.append(text)
        if self.links:
            self.now.linked += len(text.strip())

    def _pop(self) -> None:
        frame = self.frames.pop()
        self.links -= frame.opened.get("a", 0)
        self.count[frame.tag] -= 1
        self.low = min(self.low, len(self.frames))
        self.now = None

    def _close(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.now = None
            if self.count.get(tag):
                while self.frames[-1].tag != tag:
                    self._pop()
                self._pop()
            return
        frame = self.frames[-1]  # an inline end tag doesn't close blocks
        if frame.opened.get(tag):
            while True:
                t, _ = frame.inline.pop()
                frame.opened[t] -= 1
                self.links -= t == "a"
                if t == tag:
                    return

    def _open(self, tag: str, attributes: str) -> None:
        top = self.frames[-1]
        if tag in CONTROLS and not _UNSEEN.search(attributes):
            top.controls = True
        if tag in VOID_TAGS:
            return
        mark, hidden = named(attributes) if attributes else (0.0, False)
        if tag not in BLOCK_TAGS:
            if not attributes.endswith("/"):
                top.inline.append((tag, hidden or tag == "button" or bool(top.inline and top.inline[-1][1])))
                top.opened[tag] = top.opened.get(tag, 0) + 1
                self.links += tag == "a"
            return
        self.now = None
        closes = CLOSED_BY.get(tag, ())
        while top.tag == "p" or top.tag in closes:
            done = top.tag in closes and not (tag == "tr" and top.tag != "tr")
            self._pop()
            top = self.frames[-1]
            if done:
                break
        around = self.marks[top.mark][0] if top.mark >= 0 else 0.0
        if tag in BOILER_TAGS or (tag == "header" and around <= 0):
            mark = -FIRM
        elif tag in MAIN_TAGS and mark > -FIRM:
            mark = MAIN
        elif tag in ("html", "body"):
            mark = 0.0
        at = top.mark
        if mark:
            at = len(self.marks)
            self.marks.append((mark, top.mark))
        self.frames.append(Frame(tag, at, top.hidden or hidden))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            start = page.find("<", at)
            if start < 0:
                self._text(page[at:])
                return
            m = _OPEN.match(page, start)
            if m is None:
                if page.startswith("<!--", start):
                    end = page.find("-->", start + 4)
                    self._text(page[at:start])
                    at = size if end < 0 else end + 3
                elif page[start + 1 : start + 2] in ("!", "?", "/"):
                    end = page.find(">", start)
                    self._text(page[at:start])
                    at = size if end < 0 else end + 1
                else:  # no tag
                    self._text(page[at : start + 1])
                    at = start + 1
                continue
            self._text(page[at:start])
            at = _tag_end(page, m.end())
            if at > size:  # a tag that never ends
                return
            tag, attributes = m[2].lower(), page[m.end() : at - 1]
            if tag == "br":
                if self.now is not None:
                    self.now.parts.append(" ")
            elif tag == "hr":
                self.now = None
            elif m[1]:
                self._close(tag)
            elif tag in RAW_TAGS and not attributes.endswith("/"):
                if tag in CONTROLS:
                    self._open(tag, attributes + "/")
                end = _RAW_END[tag].search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = size if close < 0 else close + 1
                if tag in BLOCK_TAGS:
                    self.now = None
            else:
                self._open(tag, attributes)


def log_odds(b: Block) -> float:
    """How much more likely a block is content than boilerplate, by its own text."""
    w, words = WEIGHTS, b.text.count(" ") + 1
    score = w["bias"] + w["length"] * min(2.5, math.log1p(words) - 1.0)
    tag = b.frame.tag
    score += w["p"] if tag in ("p", "blockquote", "pre") else w["heading"] if tag[:1] == "h" and tag[1:].isdigit() else 0.0
    score += w["links"] * min(1.0, b.linked / len(b.text))
    if b.frame.controls or b.outer.controls and b.outer.tag not in ("", "body", *MAIN_TAGS):
        score += w["control"] * min(1.0, 3 / max(1, b.outer.held))  # a form has few lines
    if b.text[0] == "©" or b.text[:9].lower() == "copyright":
        score += w["legal"]
    return score + (w["sentence"] if b.text[-1] in ".!?。…:\"”" else 0.0)


def minimum_cut(to_content: list[int], to_boiler: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the content side of a least cut, by Dinic's blocking flows.

    to_content[i] is what it costs to call node i boilerplate, to_boiler[i] what it costs to call it content;
    edges (i, j, c): c is what it costs to call i and j differently.
    """
    n = len(to_content)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int):
        graph[a].append(len(head))
        head.append(b)
        room.append(there)
        graph[b].append(len(head))
        head.append(a)
        room.append(back)

    for i in range(n):
        both = min(to_content[i], to_boiler[i])  # flows straight through
        if to_content[i] > both:
            join(source, i, to_content[i] - both, 0)
        if to_boiler[i] > both:
            join(i, sink, to_boiler[i] - both, 0)
    for i, j, c in edges:
        if c > 0:
            join(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        upto = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if not room[e])
                a = head[path[k] ^ 1]
                del path[k:]
                continue
            while upto[a] < len(graph[a]):
                e = graph[a][upto[a]]
                if room[e] and level[head[e]] == level[a] + 1:
                    break
                upto[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = head[path.pop() ^ 1]
                continue
            path.append(e)
            a = head[e]


def _costs(score: float) -> tuple[int, int]:
    """What it costs to call a node boilerplate and to call it content."""
    return round(SCALE * max(0.0, score)), round(SCALE * max(0.0, -score))


def graph(page: Page) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Capacities and edges of the page: its blocks first, then its marked elements."""
    found, n = page.blocks, len(page.blocks)
    costs = [_costs(log_odds(b)) for b in found] + [_costs(mark) for mark, _ in page.marks]
    edges = [(n + i, n + around, round(SCALE * ACROSS)) for i, (_, around) in enumerate(page.marks) if around >= 0]
    for i, b in enumerate(found):
        mark = b.frame.mark
        if mark >= 0:
            edges.append((i, n + mark, round(SCALE * HELD)))
        if i:
            same = found[i - 1].frame.mark == mark
            edges.append((i - 1, i, round(SCALE * (ADJACENT / (1 + b.apart / 4) if same else ACROSS))))
        if b.sibling >= 0 and found[b.sibling].frame.mark == mark:
            edges.append((b.sibling, i, round(SCALE * SIBLING)))
    return [c for c, _ in costs], [c for _, c in costs], edges


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by line ends."""
    parsed = Page(page or "")
    if not parsed.blocks:
        return ""
    side = minimum_cut(*graph(parsed))
    return "\n".join(b.text for b, keep in zip(parsed.blocks, side, strict=False) if keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text under ``text_col``, or under a name with underscores before it if ``pages`` has such a column.

    Null and empty pages give an empty text. All rows stay, repeated ones too; empty tables give empty results.
    """

    @F.pandas_udf("string")
    def texts(html_: pd.Series) -> pd.Series:
        return html_.map(lambda h: main_text(h) if isinstance(h, str) else "")

    (name,) = fresh(pages, text_col)
    return pages.withColumn(name, texts(F.col(html_col)))


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row; other columns are ignored, null ids and repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))
