"""Strict formats of model output: judgments, summaries and profiles, checked a batch at a time.

Each function returns a struct with `error` (null if the text keeps the format) and what it says.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from ..functions.lazy import arrow_function

JUDGMENT = "struct<error: string, accepted: array<struct<id: string, reason: string>>, rejected: array<struct<id: string, reason: string>>, groups: array<struct<ids: array<string>, reason: string>>>"
SUMMARY = "struct<error: string, source_kind: string, title: string, word_count: int, too_short: boolean, description: string, key_points: array<string>, quotes: array<string>>"
PROFILE = "struct<error: string, sections: array<struct<name: string, items: array<struct<text: string, tag: string>>>>>"
# Most words of reasons, sizes of groups, most items, bullets and quotes.
REASON_WORDS = {"accepted": 30, "rejected": 15, "triangulation_groups": 30}
GROUP_SIZE, MOST_SURFACED, BULLETS, QUOTES = (2, 4), 2, (5, 8), (2, 4)
_TAGGED = re.compile(r"^- (?P<text>.*\S) \[(?P<tag>[^\[\]]+)\]$")


class Malformed(ValueError):
    pass


def _need(condition: bool, error: str) -> None:
    if not condition:
        raise Malformed(error)


def _text(value, where: str) -> str:
    _need(isinstance(value, str) and bool(value.strip()), f"{where} must be text")
    return value


def judgment(text: str, expected: list[str] | None = None) -> dict:
    _need((text or "").lstrip().startswith("{"), "must start with {")
    try:
        data = json.loads(text)
    except ValueError:
        raise Malformed("no JSON") from None
    for name, most in REASON_WORDS.items():
        _need(isinstance(data.get(name), list), f"{name} must be a list")
        for entry in data[name]:
            _need(isinstance(entry, dict), f"{name}: entries must be objects")
            _need(len(_text(entry.get("reason"), f"{name}: reason").split()) <= most, f"{name}: reason over {most} words")
    ids = []
    for name in ("accepted", "rejected"):
        ids += [_text(e.get("id"), f"{name}: id") for e in data[name]]
    for e in data["triangulation_groups"]:
        _need(isinstance(e.get("ids"), list) and GROUP_SIZE[0] <= len(e["ids"]) <= GROUP_SIZE[1], "group size")
        ids += [_text(i, "group: id") for i in e["ids"]]
    _need(len(data["accepted"]) + len(data["triangulation_groups"]) <= MOST_SURFACED, f"over {MOST_SURFACED} surfaced")
    _need(len(ids) == len(set(ids)), "an id appears twice")
    if expected is not None:
        _need(set(ids) == set(expected), "ids differ from those expected")
    pick = lambda e: {"id": e["id"], "reason": e["reason"]}
    return {"accepted": [pick(e) for e in data["accepted"]], "rejected": [pick(e) for e in data["rejected"]], "groups": [{"ids": e["ids"], "reason": e["reason"]} for e in data["triangulation_groups"]]}


def front_matter(text: str) -> tuple[dict[str, str], list[str]]:
    """Keys of the block between the first two --- lines, and the lines after it."""
    lines = text.splitlines()
    marks = [i for i, line in enumerate(lines) if line.strip() == "---"]
    _need(len(marks) >= 2 and marks[0] == 0, "no front matter")
    found: dict[str, str] = {}
    for line in filter(str.strip, lines[1 : marks[1]]):
        key, colon, value = line.partition(":")
        _need(bool(colon) and bool(key.strip()), "front matter line without key")
        _need(key.strip() not in found, "front matter key twice")
        found[key.strip()] = value.strip()
    return found, lines[marks[1] + 1 :]


def summary(text: str) -> dict:
    head, body = front_matter(text or "")
    _need(head.get("summary_version") == "1", "unsupported version")
    for key in ("source_kind", "title"):
        _need(bool(head.get(key)), f"no {key}")
    _need(bool(re.fullmatch(r"[+-]?\d+", head.get("word_count", ""))), "word_count must be an integer")
    out = {"source_kind": head["source_kind"], "title": head["title"], "word_count": int(head["word_count"]), "too_short": "too_short" in head, "description": None, "key_points": [], "quotes": []}
    if out["too_short"]:
        _need(head["too_short"].lower() == "true", "too_short must be true")
        _need(not "".join(body).strip(), "a short one has no body")
        return out
    heads = [(i, line.strip()) for i, line in enumerate(body) if line.startswith("#")]
    _need([h for _, h in heads] == ["# Summary", "## Key points", "## Quotes"], "sections must be Summary, Key points, Quotes")
    _need(not "".join(body[: heads[0][0]]).strip(), "text before the summary")
    cut = [body[a + 1 : b] for (a, _), b in zip(heads, [*(i for i, _ in heads[1:]), len(body)])]
    out["description"] = "\n".join(cut[0]).strip()
    _need(bool(out["description"]), "empty summary")
    for name, lines, mark, (low, high) in (("key_points", cut[1], "- ", BULLETS), ("quotes", cut[2], "> ", QUOTES)):
        some = [line.strip() for line in lines if line.strip()]
        _need(all(line.startswith(mark) for line in some), f"{name}: a line without {mark.strip()}")
        out[name] = [line[len(mark) :].strip() for line in some]
        _need(low <= len(out[name]) <= high, f"{name}: {low} to {high} wanted")
    return out


def profile(text: str, order: list[str], most_tokens: int = 500) -> dict:
    """Sections in the canonical order, every bullet with one tag at its end."""
    lines = (text or "").splitlines()
    _need(bool(lines) and lines[0].startswith("# "), "no title")
    words = len((text or "").split())
    _need(int(max(1.3 * words, len(text) / 4) + 0.5) <= most_tokens, "too long")
    sections: list[dict] = []
    for line in lines[1:]:
        if line.startswith("## "):
            sections.append({"name": line[3:].strip(), "items": []})
        elif line.strip():
            m = _TAGGED.match(line.strip())
            _need(bool(sections) and bool(m), "a line that is no tagged bullet")
            sections[-1]["items"].append({"text": m["text"], "tag": m["tag"]})
    names = [s["name"] for s in sections]
    _need(names == [n for n in order if n in names], "sections out of order")
    return {"sections": sections}


def _checked(check, empty: dict):
    def one(*args):
        try:
            return {"error": None, **check(*args)}
        except Malformed as e:
            return {"error": str(e), **empty}

    return one


@arrow_function(JUDGMENT)
def parse_judgment(text: pd.Series, expected: pd.Series) -> pd.DataFrame:
    one = _checked(judgment, {"accepted": [], "rejected": [], "groups": []})
    return pd.DataFrame([one(t, None if e is None else list(e)) for t, e in zip(text, expected)])


@arrow_function(SUMMARY)
def parse_summary(text: pd.Series) -> pd.DataFrame:
    one = _checked(summary, {"source_kind": None, "title": None, "word_count": None, "too_short": None, "description": None, "key_points": [], "quotes": []})
    return pd.DataFrame([one(t) for t in text]).astype({"word_count": "Int32"})


def profile_parser(order: list[str]):
    @arrow_function(PROFILE)
    def parse_profile(text: pd.Series) -> pd.DataFrame:
        one = _checked(lambda t: profile(t, order), {"sections": []})
        return pd.DataFrame([one(t) for t in text])

    return parse_profile
