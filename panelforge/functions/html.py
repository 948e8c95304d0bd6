"""Visible text of article pages, on the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What may hold an article, in order; (tag, attribute, how it must match, value).
ROOTS = (
    ("article", None, "", ""), ("main", None, "", ""), (None, "itemprop", "is", "articleBody"), (None, "itemtype", "is", "http://schema.org/NewsArticle"), (None, "itemtype", "is", "https://schema.org/NewsArticle"),
    *((None, "id", "is", v) for v in ("article-body", "articleBody", "story-body", "storyBody", "main-content", "mainContent", "content", "article", "news-article", "newsArticle")),
    *((None, "class", "has", v) for v in ("article-body", "articleBody", "story-body", "storyBody", "post-content", "entry-content", "entryContent", "content-body", "contentBody", "news-article", "newsArticle",
                                           "article-content", "articleContent", "article-text", "articleText", "story-content", "storyContent")),
)
# What may hold the body within an article, in order; any of the alternatives.
BODIES = (
    ((None, "itemprop", "is", "articleBody"),),
    tuple((None, "id", "is", v) for v in ("article-body", "articleBody", "story-body", "storyBody")),
    tuple(("div", "class", "has", v) for v in ("article-body", "articleBody")),
    tuple(("div", "class", "has", v) for v in ("story-body", "storyBody")),
    tuple(("div", "class", "has", v) for v in ("post-content", "entry-content", "entryContent")),
    tuple(("div", "class", "has", v) for v in ("article-content", "articleContent", "article-text", "articleText")),
    tuple(("div", "class", "has", v) for v in ("content-body", "contentBody", "story-content", "storyContent")),
    tuple(("section", "class", "has", v) for v in ("article", "content")),
    (("p", None, "", ""),),
)
INVISIBLE = frozenset(("style", "script", "head", "title", "meta", "link", "svg"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
LEAST_WORDS = 25


class Node:
    """An element: its tag, attributes, and children, which are elements and texts."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        """The elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag not in skip:
                stack.extend(reversed(item.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag == "p" and self.open[-1].tag == "p":
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _matches(node: Node, rule: tuple) -> bool:
    tag, attribute, how, value = rule
    if tag and node.tag != tag:
        return False
    if not attribute:
        return True
    has = node.attrs.get(attribute)
    return has is not None and (has == value if how == "is" else value in has)


def _longest(root: Node, rules: tuple) -> Node | None:
    return max((n for n in root.walk() if any(_matches(n, r) for r in rules)), key=lambda n: len(n.text()), default=None)


def element_text(node: Node, least_words: int = LEAST_WORDS) -> str:
    """Visible text with single spaces, upper case and ASCII only; empty below `least_words` words, counted before characters go."""
    words = node.text(INVISIBLE).split()
    if len(words) < least_words:
        return ""
    return " ".join(" ".join(words).encode("ascii", "ignore").decode().split()).upper()


def article_text(html: str | None, least_words: int = LEAST_WORDS) -> str | None:
    """The article on a page: in the longest element of each kind that may hold one, the longest body; None if no body is long enough."""
    if not html or not html.strip():
        return None
    page = parse(html)
    for rule in ROOTS:
        here = _longest(page, (rule,))
        if here is None:
            continue
        for body in BODIES:
            inner = _longest(here, body)
            if inner is not None:
                here = inner
                if found := element_text(here, least_words):
                    return found
    return None


def visible_text(html: Column, least_words: int = LEAST_WORDS) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: article_text(p, least_words))

    return run(html)


def table_cells(html: str) -> list[list[str]]:
    """Texts of the cells of every table row of a page."""
    return [[re.sub(r"\s+", " ", c.text()).strip() for c in row.walk() if c.tag in ("td", "th")] for row in parse(html).walk() if row.tag == "tr"]


def column_for_key(html: str | None, key_header: str, value_header: str, key: str) -> str | None:
    """The cell under `value_header` in the row whose cell under `key_header` is `key`; headers and key are compared in upper case."""
    places = None
    for cells in table_cells(html or ""):
        upper = [c.upper() for c in cells]
        if key_header.upper() in upper and value_header.upper() in upper:
            places = (upper.index(key_header.upper()), upper.index(value_header.upper()))
        elif places and len(cells) > max(places) and upper[places[0]] == key.upper():
            return cells[places[1]]
    return None


def labelled_text(html: str | None, label: str, label_class: str = "infoHead", value_class: str = "info") -> str | None:
    """Text of the first element of `value_class` behind the one of `label_class` whose text is `label`, both children of one element."""
    for parent in parse(html or "").walk():
        wanted = False
        for child in (c for c in parent.children if isinstance(c, Node)):
            names, text = child.attrs.get("class", ""), re.sub(r"\s+", " ", child.text()).strip()
            if wanted and value_class in names and label_class not in names:
                return text
            wanted = wanted or label_class in names and text == label
    return None
