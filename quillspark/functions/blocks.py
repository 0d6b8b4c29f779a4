"""Pages of a block editor as JSON: properties and summaries as Columns, block trees through Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import arrow_function
from .text import let, optional, strip

RICH = "array<struct<plain_text: string>>"
PROPERTIES = f"struct<properties: map<string, struct<type: string, rich_text: {RICH}, title: {RICH}, select: struct<name: string>>>>"
HEADINGS = {"heading_1": "#", "heading_2": "##", "heading_3": "###"}
#: Lists of blocks in each other; a tree with more isn't read.
MOST_DEEP = 200
#: Marks around text, innermost first.
MARKS = [("code", "`"), ("bold", "**"), ("italic", "*"), ("strikethrough", "~~")]


def plain_text(rich: Column) -> Column:
    return strip(F.array_join(F.transform(rich, lambda r: r["plain_text"]), ""))


def _value(entry: Column) -> Column:
    p = entry["value"]
    return F.when(p["type"] == "rich_text", plain_text(p["rich_text"])).when(p["type"] == "title", plain_text(p["title"])).when(p["type"] == "select", p["select"]["name"])


def _entries(page: Column) -> Column:
    return F.map_entries(F.from_json(page, PROPERTIES)["properties"])


def property_text(page: Column, names: list[str]) -> Column:
    """The first text of a rich-text, title or select property that has one of the names, in any case; null without one."""
    wanted = [n.lower() for n in names]
    texts = lambda entries: F.filter(F.transform(F.filter(entries, lambda e: F.lower(e["key"]).isin(wanted)), lambda e: optional(_value(e))), lambda t: t.isNotNull())
    return F.get(let(_entries(page), texts), F.lit(0))


def page_title(page: Column) -> Column:
    """The text of the page's title property; empty without one."""
    titles = F.filter(_entries(page), lambda e: e["value"]["type"] == "title")
    return F.coalesce(_value(F.get(titles, F.lit(0))), F.lit(""))


def page_summary(page: Column) -> Column:
    """struct<page_id, title, last_edited_time, url>."""
    told = lambda path: F.coalesce(F.get_json_object(page, path), F.lit(""))
    return F.struct(told("$.id").alias("page_id"), page_title(page).alias("title"), told("$.last_edited_time").alias("last_edited_time"), F.get_json_object(page, "$.url").alias("url"))


def session_fields(page: Column, told_type: Column, therapist: str) -> Column:
    """struct<therapist, session_type>: the page's own where it has them (of two types only), else what is told."""
    kind = F.lower(property_text(page, ["Session Type", "session_type", "Type"]))
    return F.struct(F.coalesce(property_text(page, ["Therapist"]), F.lit(therapist)).alias("therapist"), F.coalesce(F.when(kind.isin("individual", "couples"), kind), told_type).alias("session_type"))


@arrow_function("string")
def markdown(blocks: pd.Series) -> pd.Series:
    """A tree of blocks, as a JSON array, as Markdown; what isn't a block counts for nothing. Null, what is no JSON array,
    and what is nested too deeply give null."""

    def read(text):
        try:
            tree = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return None
        if not isinstance(tree, list) or (lines := _lines(tree)) is None:
            return None
        return "\n".join(_tidy(lines)).rstrip() + "\n"

    return blocks.map(read)


def _marked(rich) -> str:
    out = ""
    for piece in rich if isinstance(rich, list) else ():
        if not isinstance(piece, dict) or not isinstance(piece.get("plain_text"), str):
            continue
        text = piece["plain_text"].replace("`", "\\`")
        told = piece.get("annotations")
        for name, mark in MARKS if text and isinstance(told, dict) else ():
            if told.get(name):
                text = mark + text + mark
        out += f"[{text}]({piece['href']})" if text and isinstance(piece.get("href"), str) else text
    return out.strip()


class _Open:
    """A list of blocks that is being written: those left, the lines so far, and how its lines go into the list above."""

    def __init__(self, blocks: list, depth: int, into=None):
        self.left, self.depth, self.into = iter(blocks), depth, into
        self.out: list[str] = []
        self.number = 1


def _lines(tree: list) -> list[str] | None:
    """Lines with a blank one after each block; lists are numbered anew after anything but text between their items. Null
    for a tree that is nested too deeply."""
    held = [_Open(tree, 0)]
    while True:
        here = held[-1]
        block = next(here.left, held)
        if block is held:  # no block is left
            held.pop()
            if not held:
                return here.out
            held[-1].out += here.into(here.out)
            continue
        if not isinstance(block, dict):
            continue
        kind = block.get("type") if isinstance(block.get("type"), str) else ""
        own = block.get(kind) if isinstance(block.get(kind), dict) else {}
        below = block.get("children") if isinstance(block.get("children"), list) else []
        text, indent = _marked(own.get("rich_text")), "  " * here.depth
        into = None
        if kind in ("bulleted_list_item", "numbered_list_item"):
            mark, here.number = ("-", 1) if kind.startswith("b") else (f"{here.number}.", here.number + 1)
            here.out.append(f"{indent}{mark} {text}")
            depth, into = here.depth + 1, lambda lines: [*filter(None, lines), ""]
        elif kind in HEADINGS:
            here.out += [f"{HEADINGS[kind]} {text}", ""] * bool(text)
        elif kind == "quote":
            here.out += [f"{indent}> {text}", ""] * bool(text)
            depth, into = here.depth, lambda lines: [f"> {x}".rstrip() for x in lines]
        elif kind == "divider":
            here.out += ["---", ""]
        elif kind == "child_page":
            title = own["title"].strip() if isinstance(own.get("title"), str) else ""
            here.out += [f"## {title}", ""] * bool(title)
        elif text:
            here.out += [indent + text, ""]
        if kind not in ("paragraph", "quote", "bulleted_list_item", "numbered_list_item", *HEADINGS):
            here.number = 1
        if into:
            if len(held) > MOST_DEEP:
                return None
            held.append(_Open(below, depth, into))


def _tidy(lines: list[str]) -> list[str]:
    """No blank line first, and never two together."""
    out: list[str] = []
    for line in map(str.rstrip, lines):
        if line or (out and out[-1]):
            out.append(line)
    return out
