"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import free_name, table

# Kinds of HTML elements, and words of class, id and role that name what is not the article.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp noembed noframes".split())
OUTSIDE = frozenset("head nav header footer aside form menu button select dialog fieldset audio video map".split())
BLOCKS = frozenset(
    """html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th
    blockquote pre address figure figcaption hgroup details summary center hr""".split()
) | (OUTSIDE - {"button", "select"})
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre address figcaption summary center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("hr br img input meta link area base col embed param source track wbr".split())
#: An opening tag closes these where they are still open, up to one of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
OTHER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu
    menus nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice
    notices alert popup modal overlay comment comments commentlist disqus respond reply replies share sharing social related
    recommended newsletter subscribe subscription widget widgets login signup pagination pager toolbar toc skip
    complementary contentinfo search dialog aside""".split()
)
OWN_WORDS = frozenset("article post entry content main story body page wrapper container".split())
READERS = frozenset("comment comments commentlist disqus respond reply replies ad ads advert advertisement sidebar cookie".split())
KEPT_TAGS = frozenset("html body article main".split())
FRAME = frozenset("html body main".split())
#: A paragraph beside an article in the page's frame ends like a sentence or is so long.
LONG_PARAGRAPH = 80

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_COMMAS = re.compile("[,、，،]")
_SENTENCE = re.compile("[.!?。！？؟…][\"'”’»)]*$")


class _Node:
    __slots__ = ("tag", "parent", "outside", "other", "score", "chars", "linked", "order", "levels")

    def __init__(self, tag: str, parent: _Node | None, outside: bool, order: int, other: bool = False):
        self.tag, self.parent, self.outside, self.order, self.other = tag, parent, outside, order, other
        self.score, self.chars, self.linked = 0.0, 0, 0
        # Points held here, by its children, by theirs, and below these.
        self.levels = [0.0, 0.0, 0.0, 0.0]


class _Tags:
    """The page's tags in order, read once: no place is looked at again, whatever quotes and brackets are open."""

    def __init__(self, html: str):
        self.html, self.at = html, 0
        self.last = {q: html.rfind(q) for q in "\"'>"}
        self.quotes = True

    def _tag_end(self, at: int) -> int:
        """The bracket that ends a tag, -1 if none does. Brackets in quotes do not, as long as quotes are closed."""
        first, start = -1, at
        while self.quotes:
            stop = _STOP.search(self.html, at)
            if stop is None:
                break
            at = stop.start()
            if stop[0] == ">":
                return at
            at = self.html.index(stop[0], at + 1) + 1 if self.last[stop[0]] > at else at + 1
        # No bracket is left outside of quotes: from here on quotes mean nothing.
        self.quotes = False
        first = self.html.find(">", start) if self.last[">"] >= start else -1
        return first

    def next(self) -> tuple[str, str, str, str] | None:
        """Text up to the next tag, what kind of tag it is (open, close, other or none), its name and its attributes."""
        html, begin, look = self.html, self.at, self.at
        while True:
            at = html.find("<", look)
            if at < 0:
                self.at = len(html)
                return (html[begin:], "none", "", "") if begin < len(html) else None
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                self.at = end + 3 if end >= 0 else len(html)
                return html[begin:at], "other", "", ""
            if html.startswith(("<!", "<?"), at):
                end = html.find(">", at) if self.last[">"] > at else -1
                self.at = end + 1 if end >= 0 else len(html)
                return html[begin:at], "other", "", ""
            closing = html.startswith("/", at + 1)
            name = _TAG_NAME.match(html, at + 1 + closing)
            if name is None:
                look = at + 1
                continue
            end = (html.find(">", name.end()) if self.last[">"] >= name.end() else -1) if closing else self._tag_end(name.end())
            self.at = end + 1 if end >= 0 else len(html)
            if end < 0:
                return html[begin:at], "other", "", ""
            return html[begin:at], "close" if closing else "open", name[0].lower(), html[name.end() : end]


def _is_outside(tag: str, attributes: str) -> bool:
    """Whether an element holds something other than the article."""
    if tag in OUTSIDE or tag in KEPT_TAGS:
        return tag in OUTSIDE
    return _is_other(attributes, READERS if tag in PARAGRAPHS else OTHER_WORDS)


def _is_other(attributes: str, others: frozenset[str] = OTHER_WORDS) -> bool:
    """Whether attributes hide an element or name something other than the article, in one of the words ``others``."""
    if not attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id", "role"):
            words = set(_WORDS.findall(value))
            if words & others and (words & READERS or not words & OWN_WORDS):
                return True
    return False


def parse_page(html: str) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """The page's blocks of text in order (the element that holds each, its text, its characters inside links), and all elements.

    Time grows with the page's length alone: tags are read once, and of every kind of tag it is known where the innermost open one is.
    """
    root = _Node("html", None, False, 0)
    open_: list[_Node] = [root]
    nodes = [root]
    places: dict[str, list[int]] = {"html": [0]}
    blocks: list[tuple[_Node, str, int]] = []
    words: list[str] = []
    linked = links = 0
    tags = _Tags(html)

    def flush() -> None:
        nonlocal linked, links
        if words:
            said = " ".join(unescape("".join(words)).split())
            words.clear()
            if said:
                blocks.append((open_[-1], said, min(linked, len(said))))
        linked = links = 0

    def innermost(kinds) -> int:
        return max((places[t][-1] for t in kinds if places.get(t)), default=0)

    def cut(depth: int) -> None:
        """Close the element at ``depth`` and all inside it; the root stays."""
        while depth and len(open_) > depth:
            places[open_.pop().tag].pop()

    while found := tags.next():
        raw, kind, tag, attributes = found
        if raw:
            words.append(raw)
            if links:
                linked += len(raw)
        if kind == "open":
            if tag in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(html, tags.at)
                    tags.at = end.end() if end else len(html)
            elif tag == "br":
                words.append(" ")
            elif tag == "a":
                links += 1
            elif tag in BLOCKS or tag in OUTSIDE:
                flush()
                if tag in VOID:
                    continue
                if open_[-1].tag == "p" or (open_[-1].tag in HEADINGS and tag in PARAGRAPHS):
                    cut(len(open_) - 1)
                if tag in CLOSES:
                    shut, until = CLOSES[tag]
                    if innermost(shut) > innermost(until):
                        cut(innermost(shut))
                if tag == "html" or (tag == "body" and places.get("body")):
                    continue
                outside = open_[-1].outside or _is_outside(tag, attributes)
                node = _Node(tag, open_[-1], outside, len(nodes), tag == "article" and _is_other(attributes))
                places.setdefault(tag, []).append(len(open_))
                open_.append(node)
                nodes.append(node)
        elif kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS or tag in OUTSIDE:
                flush()
                if places.get(tag):
                    cut(places[tag][-1])
    flush()
    return blocks, nodes


def _score(blocks: list[tuple[_Node, str, int]], nodes: list[_Node]) -> None:
    """Give every element its points and characters, from the innermost outwards; each is looked at once."""
    for node, said, linked in blocks:
        holder = node.parent if node.tag in PARAGRAPHS and node.parent else node
        size = len(said)
        holder.levels[0] += (min(size, 25) / 25 + len(_COMMAS.findall(said)) + min(size / 100, 3)) * (1 - linked / size)
        holder.chars += size
        holder.linked += linked
    for node in reversed(nodes):
        own, children, theirs, below = node.levels
        node.score = own + children / 2 + theirs / 6 + below / 12
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.linked += node.linked
            up.levels[1] += own
            up.levels[2] += children
            up.levels[3] += theirs + below


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, one a line. Empty if there is none.

    Each paragraph earns points for its length and commas, less by its share of linked text; its parent gets them
    all, the grandparent half, those above a shrinking part. The container with most points (discounted by its own
    share of links) is the article, or the ``article`` or ``main`` element around it, or one inside with at least half
    of its points. What stands beside it belongs to it: in a parent that is not the page's frame all siblings that are not
    mostly links, in the frame (``html``, ``body``, ``main``) siblings that score like it, paragraphs, and the headings before it. So it does beside
    an ``article``, with the other articles that score like it, wherever they stand, and with what holds the page's title; in ``main``
    all levels up to it count as beside. A ``main`` is whole. Elements that hold something else never count.
    """
    blocks, nodes = parse_page(html or "")
    blocks = [b for b in blocks if not b[0].outside]
    _score(blocks, nodes)
    scored = [n for n in nodes if n.chars]
    if not scored:
        return ""
    value = {id(n): n.score * (1 - n.linked / n.chars) for n in scored}
    best = max(scored, key=lambda n: (value[id(n)], -n.order))
    if value[id(best)] <= 0:
        return ""
    around, up = best, best
    while up and up.tag not in ("article", "main"):
        up = up.parent
    if up is None:
        # The page's frame may have a little more than the article in it.
        named = [n for n in scored if n.tag in ("article", "main") and 2 * value[id(n)] >= value[id(best)]]
        up = max(named, key=lambda n: (value[id(n)], -n.order), default=None)
    around = up or best
    above, up = set(), around
    while up:
        above.add(id(up))
        up = up.parent
    kept = {id(around)}
    levels = {} if around.tag == "main" or not around.parent else _levels(around)
    least = 0.2 * value[id(best)]
    for n in scored:
        if n.other or id(n) in above:
            continue
        beside = id(n.parent) in levels
        whole = beside and around.tag != "article" and n.parent.tag not in FRAME and 2 * n.linked <= n.chars
        if whole or ((beside or around.tag == n.tag == "article") and value[id(n)] >= least):
            kept.add(id(n))
    # The element right below one of the levels that each lies in, and whether it lies in what is kept.
    branch: dict[int, _Node | None] = {}
    inside: dict[int, bool] = {}
    for n in nodes:
        branch[id(n)] = n if id(n.parent) in levels else branch[id(n.parent)] if n.parent else None
    if around.tag == "article":
        titled = {id(branch[id(node)]): branch[id(node)] for node, _, _ in blocks if node.tag == "h1"}
    else:
        # Without an article, what stands before the container and holds nothing but headings.
        titled = {id(branch[id(node)]): branch[id(node)] for node, _, _ in blocks if node.tag in HEADINGS}
        for node, said, linked in blocks:
            if node.tag not in HEADINGS or 2 * linked > len(said) or node.order > around.order:
                titled.pop(id(branch[id(node)]), None)
    kept |= {key for key, n in titled.items() if n and not n.other and key not in above}
    for n in nodes:
        inside[id(n)] = id(n) in kept or (n.parent is not None and inside[id(n.parent)])

    def belongs(node: _Node, said: str, linked: int) -> bool:
        if inside[id(node)]:
            return True
        paragraph = node.tag in PARAGRAPHS
        holder = levels.get(id(node.parent if paragraph else node))
        if holder is None or node.tag == "li" or linked * 4 > len(said):
            return False
        if around.tag != "article":
            return paragraph
        sentence = len(said) >= LONG_PARAGRAPH or _SENTENCE.search(said) is not None
        return sentence or node.tag in HEADINGS or (paragraph and holder.tag not in ("html", "body"))

    return "\n".join(said for node, said, linked in blocks if belongs(node, said, linked))


def _levels(around: _Node) -> dict[int, _Node]:
    """The elements whose children stand beside a container: its parent, and for an article in ``main`` all up to that."""
    line, up = [], around.parent
    while up:
        line.append(up)
        if up.tag in FRAME:
            break
        up = up.parent
    inside = around.tag == "article" and line[-1].tag == "main"
    return {id(n): n for n in (line if inside else line[:1])}


def extract_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``text``, its pages' main text, in place of ``html``, and ``n_chars``, its code points.

    Null, empty and unreadable pages have an empty text. Columns ``text`` and ``n_chars`` of ``df`` are replaced.
    Pages are read whole, in small batches; nothing is shuffled.
    """
    kept = [c for c in df.columns if c != html and c.lower() not in ("text", "n_chars")]
    body = free_name(df, "body")
    rows = df.select(*kept, F.col(html).cast("string").alias(body))
    schema = T.StructType(
        [*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h) for h in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=schema.names,
                )

    return rows.mapInArrow(read, schema)


def op8_tree_scoring(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op8_tree_scoring": op8_tree_scoring}
ORACLE: dict[str, str] = {}
