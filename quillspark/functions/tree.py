"""Elements of HTML pages: a small tree over the standard parser, and what is read from it, through Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from .lazy import arrow_function, rows_of

# Tags without an end, and the pieces of a notebook's pages.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "table", "hr", "div", "ul", "ol", "dl", "blockquote", "pre", "form"}
BOOK = ("div", ".kp-notebook-library-each-book")
BOOK_FIELDS = {"title": ("h2", ".kp-notebook-searchable"), "authors": ("p", ".kp-notebook-searchable"), "cover_url": ("img", ".kp-notebook-cover-image")}
CARDS, CARD = ("div", "#kp-notebook-annotations"), ("div", ".kp-notebook-row-separator")
CARD_FIELDS = {"text": ("span", "#highlight"), "note": ("span", "#note"), "location": ("input", "#kp-annotation-location"), "color": ("input", ".kp-annotation-type"), "created_at": ("span", "#annotationHighlightHeader")}
ID_PREFIX = "kp-notebook-library-each-book-"
#: A page without the container of its cards is broken if its text is as long as a page's or as short as an error's.
LONG_PAGE, SHORT_PAGE = 200, 50

#: Plain tags, comments and texts. A page of anything else, or with elements whose content is no markup, is left to the standard
#: parser, which reads pages of these alike but takes longer.
PLAIN = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z]+="[^"<>&]*")*) ?/?>|</([a-z][a-z0-9]*)>|([^<]+)|<!--[^<>-]*-->')
ATTRIBUTE = re.compile(r' ([a-z]+)="([^"]*)"')
NO_MARKUP = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}

#: Open elements in each other; a page with more is taken for broken.
MOST_DEEP = 500

CELL = "struct<classes: array<string>, id: string, text: string, strong: string, marks: map<string, string>>"
ROWS = f"array<struct<cells: array<{CELL}>>>"
BOOK_ROW = "asin string, title string, authors string, cover_url string"
BOOKS = f"array<struct<{BOOK_ROW}>>"
CARDS_FOUND = "struct<status: string, highlights: array<struct<text: string, note: string, location: string, page: string, color: string, created_at: string>>>"


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)  # nodes and texts

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def below(self):
        """The nodes below in document order."""
        left = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while left:
            node = left.pop()
            yield node
            left += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def find(self, tag: str, mark: str = ""):
        """The nodes below with the tag and the class (.name) or id (#name)."""
        name = mark[1:]
        return [n for n in self.below() if n.tag == tag and (not mark or (name in n.classes() if mark[0] == "." else n.attrs.get("id") == name))]

    def pieces(self) -> list[str]:
        """All texts in document order, a break as a line feed."""
        out, left = [], list(reversed(self.parts))
        while left:
            p = left.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.tag == "br":
                out.append("\n")
            else:
                left += reversed(p.parts)
        return out

    def strings(self) -> list[str]:
        """All texts in document order, without breaks."""
        out, left = [], list(reversed(self.parts))
        while left:
            p = left.pop()
            if isinstance(p, str):
                out.append(p)
            else:
                left += reversed(p.parts)
        return out

    def text(self) -> str:
        """All text, a break as a line feed."""
        return "".join(self.pieces())

    def plain(self) -> str:
        """The texts without white space at their ends, joined."""
        return "".join(x.strip() for x in self.strings())


class Malformed(ValueError):
    """A page that isn't read: its tags are nested too deeply."""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]
        self.count: Counter = Counter()

    def shut(self, tag):
        """Ends the innermost open element with the tag, and those in it."""
        if self.count[tag]:
            while (last := self.open.pop()).tag != tag:
                self.count[last.tag] -= 1
            self.count[tag] -= 1

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH and self.count["p"] and not self.count["table"]:
            self.shut("p")
        node = Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in VOID:
            if len(self.open) > MOST_DEEP:
                raise Malformed(f"tags nested more than {MOST_DEEP} deep")
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        """<br/> and <hr/> have no end; of other tags the slash means nothing."""
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.shut(tag)

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def _plain_tree(page: str) -> Node | None:
    """The elements of a page of plain tags; null for any other."""
    builder, end = _Builder(), 0
    for m in iter(PLAIN.scanner(page).match, None):
        tag, attrs, shut, text = m.groups()
        if text:
            builder.handle_data(unescape(text) if "&" in text else text)
        elif shut:
            builder.shut(shut)
        elif tag:
            if tag in NO_MARKUP:
                return None
            builder.handle_starttag(tag, ATTRIBUTE.findall(attrs) if attrs else ())
        end = m.end()
    return builder.open[0] if end == len(page) else None


def tree(page: str) -> Node:
    """The page's elements; Malformed where they are nested too deeply. A paragraph ends where a block begins."""
    if (found := _plain_tree(page)) is not None:
        return found
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.open[0]


def read(page: str | None) -> Node | None:
    """The page's elements, of a null page none; null for a malformed one."""
    try:
        return tree(page or "")
    except Malformed:
        return None


def _lines(text: str) -> str:
    """Blanks collapsed, lines stripped, empty lines out."""
    return "\n".join(filter(None, (re.sub(r"[ \t\r]+", " ", line).strip() for line in text.split("\n"))))


def _cells(tr: Node) -> list[dict]:
    def cell(td: Node) -> dict:
        strong = td.find("strong")
        marks = [(c, _lines(s.text())) for s in td.find("span") for c in s.classes()]
        return {"classes": td.classes(), "id": td.attrs.get("id"), "text": _lines(td.text()), "strong": _lines(strong[0].text()) if strong else None, "marks": dict(reversed(marks))}

    return [cell(td) for td in tr.find("td")]


@arrow_function(ROWS)
def table_rows(page: pd.Series) -> pd.Series:
    """The rows of a page's tables: of each cell its classes, id, text, the text in <strong>, and texts of its spans by
    class. A null page has none; a malformed one gives null."""
    return page.map(lambda p: None if (root := read(p)) is None else [{"cells": _cells(tr)} for tr in root.find("tr")])


def rows_of_tables(pages: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each row of the tables of pages (html, and the columns `keep`), at: its place; cells as in table_rows. A
    malformed page has none."""
    rows = lambda p: () if (root := read(p)) is None else ({"at": i, "cells": _cells(tr)} for i, tr in enumerate(root.find("tr")))
    return rows_of(pages, ["html"], keep, rows, f"at int, cells array<{CELL}>")


def _fields(node: Node, wanted: dict) -> dict:
    """Of the first element of each kind its text, or of an input its value and of an image its source; null if empty."""
    out = {}
    for name, (tag, mark) in wanted.items():
        first = next(iter(node.find(tag, mark)), None)
        out[name] = first and ((first.attrs.get("value") if tag == "input" else first.attrs.get("src") if tag == "img" else first.plain()) or None)
    return out


def _books(page: str | None) -> list[dict] | None:
    """Books of a notebook's first page; those without a product number are left out. Of a malformed page null."""

    def book(node: Node) -> dict:
        own = node.attrs.get("id") or ""
        asin = own[len(ID_PREFIX) :] if own.startswith(ID_PREFIX) else own if re.fullmatch("B[0-9A-Z]{9}", own) else ""
        found = _fields(node, BOOK_FIELDS)
        return {"asin": asin or node.attrs.get("data-asin") or "", **found, "title": found["title"] or "", "authors": found["authors"] or ""}

    return None if (root := read(page)) is None else [b for b in map(book, root.find(*BOOK)) if b["asin"]]


@arrow_function(BOOKS)
def notebook_books(page: pd.Series) -> pd.Series:
    """Books of a notebook's first page; those without a product number are left out. A malformed page gives null."""
    return page.map(_books)


def rows_of_books(pages: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each book of notebooks' first pages (html, and the columns `keep`), as in notebook_books. A malformed page has
    none."""
    return rows_of(pages, ["html"], keep, lambda p: _books(p) or (), BOOK_ROW)


@arrow_function(CARDS_FOUND)
def notebook_highlights(page: pd.Series) -> pd.DataFrame:
    """Highlights of a book's page, and a status: ok, none, or broken where the page isn't what it should be."""

    def found(p: str | None) -> dict:
        root = read(p)
        if root is None:
            return {"status": "broken", "highlights": []}
        box = next(iter(root.find(*CARDS)), None)
        if box is None:
            return {"status": "none" if SHORT_PAGE <= len(root.plain()) < LONG_PAGE else "broken", "highlights": []}
        cards = [_fields(card, CARD_FIELDS) for card in box.find(*CARD)]
        for c in cards:
            after = (c["location"] or "").partition("Page")[2].split()
            c["page"] = f"Page{after[0]}" if after else None
        return {"status": "ok" if cards else "none", "highlights": [c for c in cards if c["text"]]}

    return pd.DataFrame([found(p) for p in page], columns=["status", "highlights"])
