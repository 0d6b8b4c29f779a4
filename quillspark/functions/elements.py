"""Pages as rows: the elements of a page's body, and the events of a running text, through Arrow batches.

Both tell only what stands where; nothing is carried from one element to the next here. A page that is nested too deeply has
no elements but an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .lazy import rows_of
from .tree import Malformed, Node, tree

#: How a numbered text's heading begins.
BEGINS = re.compile(r"\d+\. ")

CELL = "struct<classes: array<string>, told: string, text: string, lines: string>"
ELEMENT = f"at int, tag string, id string, classes array<string>, style string, text string, spaced string, raw string, apart string, strong string, psalm string, rows array<array<{CELL}>>, error string"
EVENT = "at int, kind string, text string, number int, error string"


def squeezed(text: str) -> str:
    """White space of any kind as single blanks, none at the ends."""
    return " ".join(text.split())


def body(root: Node) -> Node:
    """The element that holds a page's content."""
    for tag in ("body", "html"):
        if found := root.find(tag):
            return found[0]
    return root


def _joined(node: Node, between: str) -> str:
    """The node's own texts, and of each element in it the texts with something between them; a break is a blank."""
    return squeezed("".join(p if isinstance(p, str) else " " if p.tag == "br" else between.join(p.strings()) for p in node.parts))


def _lines(node: Node) -> str:
    text = "".join(p if isinstance(p, str) else "\n" if p.tag == "br" else "".join(p.strings()) for p in node.parts)
    return "\n".join(filter(None, (" ".join(x.replace("\xa0", " ").split(" ")).strip() and squeezed(x) for x in text.split("\n"))))


def _element(node: Node, wanted: set[str]) -> dict:
    strings = node.strings()
    raw = "".join(strings)
    # without elements in it, a text is the same in each form
    same = None if any(isinstance(p, Node) for p in node.parts) else squeezed(raw)
    out = {"tag": node.tag, "id": node.attrs.get("id"), "classes": node.classes(), "style": node.attrs.get("style"), "raw": raw, "psalm": None, "rows": []}
    if "text" in wanted:
        out["text"] = _joined(node, "") if same is None else same
    if "spaced" in wanted:
        out["spaced"] = _joined(node, " ") if same is None else same
    if "apart" in wanted:
        out["apart"] = " ".join(strings)
    if "strong" in wanted:
        strong = None if same is not None else next((n for n in node.below() if n.tag == "strong"), None)
        out["strong"] = None if strong is None else squeezed("".join(strong.strings()))
    if node.tag == "table" and not wanted.isdisjoint(("psalm", "rows")):
        number = next((n for mark in (".psnum", ".pshead") for n in node.below() if mark[1:] in n.classes()), None)
        out["psalm"] = None if number is None else "".join(number.strings())
        out["rows"] = [[{"classes": td.classes(), "told": squeezed(" ".join(td.strings())), "text": _joined(td, " "), "lines": _lines(td)} for td in tr.find("td")] for tr in node.find("tr")]
    return out


def page_elements(pages: DataFrame, keep: list[str], fields: list[str] | None = None) -> DataFrame:
    """A row for each element right below the body of pages (html, and the columns `keep`), at: its place; tag, id, classes,
    style; text (that of inner elements without breaks), spaced (with blanks between the strings of inner elements), both with
    white space squeezed; raw and apart (all strings together, and with blanks between them); strong (the text of the first
    <strong>, null without one); of a table the text that numbers a psalm, and its rows of cells. A page that can't be read is
    one row with an error and nothing else; a null page has none. fields: of those between at and error, the ones that are
    made (all of them without it)."""
    kind = StructType.fromDDL(ELEMENT)
    wanted = set(kind.names[1:-1] if fields is None else fields)
    if unknown := wanted - set(kind.names[1:-1]):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    schema = StructType([f for f in kind if f.name in wanted or f.name in ("at", "error")])

    def read(p: str | None) -> Iterator[dict]:
        try:
            inner = [n for n in body(tree(p or "")).parts if isinstance(n, Node)]
        except Malformed as e:
            yield {"error": str(e)}
        else:
            yield from ({"at": i, **_element(n, wanted)} for i, n in enumerate(inner))

    return rows_of(pages, ["html"], keep, read, schema)


def _flat(node: Node) -> str:
    """All texts, breaks as blanks, white space squeezed."""
    return squeezed("".join(" " if x == "\n" else x for x in node.pieces()))


def _anchors(node: Node) -> list[Node]:
    return [n for n in node.below() if n.tag == "a" and "name" in n.attrs]


def _is_number(name: str | None) -> bool:
    return bool(name) and name.isascii() and name.isdigit()


def text_events(root: Node) -> list[tuple[str, str, int | None]]:
    """What a page of numbered texts says, in document order: (kind, text, number). start: a text's number as its anchor has
    it, and the anchor's text; section: a heading over texts; page: the text of a page mark; rubric; text. White space of texts is
    squeezed."""
    out: list[tuple[str, str, int | None]] = []

    def anchor(node: Node) -> None:
        name = node.attrs.get("name") or ""
        if _is_number(name):
            out.append(("start", _flat(node), int(name) if len(name) < 10 else None))
        elif name and (text := _flat(node)):
            out.append(("section", text, None))

    left = list(reversed(body(root).parts))
    while left:
        node = left.pop()
        if isinstance(node, str):
            if text := squeezed(node):
                out.append(("text", text, None))
            continue
        classes, tag = set(node.classes()), node.tag
        if tag == "p" and classes & {"rightfoot", "leftfoot"}:
            out.append(("page", " ".join(node.strings()), None))
        elif tag in ("hr", "br", "h1", "h2", "h3", "h4"):
            continue
        elif tag in ("p", "em") and "rubric" in classes:
            out.append(("rubric" if tag == "p" else "note", _flat(node), None))
        elif tag == "strong":
            for a in _anchors(node):
                if (name := a.attrs.get("name")) and not _is_number(name) and (text := _flat(a) or _flat(node)):
                    out.append(("section", text, None))
            left += reversed(node.parts)
        elif tag == "em":
            first = next(iter(_anchors(node)), None)
            name = first.attrs.get("name") if first else None
            if name and (not _is_number(name) or BEGINS.match(_flat(first))):
                anchor(first)
            elif text := _flat(node):
                out.append(("text", text, None))
        elif tag == "p":
            inner = _anchors(node)
            if any(_is_number(a.attrs.get("name")) for a in inner):
                left += reversed(node.parts)
                continue
            for a in inner:
                anchor(a)
            if text := _flat(node):
                out.append(("text", text, None))
        elif tag == "a":
            anchor(node)
        else:
            left += reversed(node.parts)
    return out


def page_events(pages: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each event of pages of numbered texts (html, and the columns `keep`), at: its place; kind, text, number (see
    text_events). A page that can't be read is one row with an error; a null page has none."""

    def read(p: str | None) -> Iterator[dict]:
        try:
            found = text_events(tree(p or ""))
        except Malformed as e:
            yield {"error": str(e)}
        else:
            yield from ({"at": i, "kind": k, "text": t, "number": n} for i, (k, t, n) in enumerate(found))

    return rows_of(pages, ["html"], keep, read, EVENT)
