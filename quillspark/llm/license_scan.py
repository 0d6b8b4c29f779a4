"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; licence expressions after a tag are
put in postfix order by a shunting-yard parser and evaluated.

The automaton runs over the text's words (A-Z lower-cased, joined by single blanks), so that phrases match across line
breaks and punctuation. Everything happens where the text is read; nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, per_worker, texts

# Phrases and labels that the query's contract names.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices and their labels.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
# Beginnings of identifiers in expressions, their labels and how much they ask (0 least).
FAMILIES = [
    ("agpl", "agpl", 3),
    ("lgpl", "lgpl", 2),
    ("gpl", "gpl", 3),
    ("mpl", "mpl", 2),
    ("epl", "epl", 2),
    ("apache", "apache", 1),
    ("bsd", "bsd", 1),
    ("mit", "mit", 1),
    ("isc", "isc", 1),
    ("bsl", "boost", 1),
    ("cc-by-nc", "cc-by-nc", 4),
    ("cc-by-nd", "cc-by-nd", 4),
    ("cc-by-sa", "cc-by-sa", 3),
    ("cc-by", "cc-by", 1),
    ("cc0", "cc0", 0),
    ("unlicense", "public-domain", 0),
]
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
#: An expression stands on the tag's line, or where nothing more is on that, on the next one.
_REST = re.compile(rb"[ \t]*:?[ \t]*(?:\r?\n[^0-9A-Za-z(\n]*)?([^\n]*)")
#: Bytes that part words, and A-Z, as the contract's pattern has them.
_TO_WORDS = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))


def postfix(expression: str) -> list[str] | None:
    """The expression's identifiers and operators in postfix order, up to where prose begins; None if it is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether an operand is due
    for found in _TOKEN.finditer(expression):
        token, word = found[0], found[0].lower()
        if token == "(":
            if not operand:
                break
            waiting.append(token)
        elif token == ")":
            if operand or "(" not in waiting:
                return None
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif word in _BINDS:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = True
        elif operand and identifier(token):
            out.append(token.rstrip(".:"))
            operand = False
        elif operand and waiting and waiting[-1] in _BINDS:  # "or" and the like begin the prose after the expression
            waiting.pop()
            operand = False
            break
        else:
            break
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def identifier(token: str) -> bool:
    """Whether a token is a licence's identifier rather than a word of prose: of a known family, or with a digit, a hyphen
    or a capital."""
    return family(token)[1] < 5 or any(c.isdigit() or c == "-" or c.isupper() for c in token)


def family(identifier: str) -> tuple[str, int]:
    """Label and demands of a licence identifier; an unknown one stands for itself and asks the most."""
    name = identifier.lower()
    return next(((label, asks) for start, label, asks in FAMILIES if name.startswith(start)), (name.rstrip("+"), 5))


def evaluate(expression: str) -> tuple[set[str], int] | None:
    """Labels that an expression names, and its demands: the least of an or's sides, the most of an and's; an exception
    after with takes one off. None if it is malformed."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], int]] = []
    for token in order:
        if token not in _BINDS:
            label, asks = family(token)
            stack.append(({label}, asks))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], max(0, left[1] - 1)))
        else:
            stack.append((left[0] | right[0], (min if token == "or" else max)(left[1], right[1])))
    return stack[0]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for phrase, label in {**MORE, **BASE, TAG: None}.items():
            self.found.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
        self.found.make_automaton()

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, asks."""
        words = text.translate(_TO_WORDS).split()
        line = " ".join(["", *(w.decode() for w in words), ""]) if not text.isascii() else (b" " + b" ".join(words) + b" ").decode()
        places: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        tags, counted, at = [], 0, 0
        for end, (phrase, label, is_base) in self.found.iter(line):
            if label is None:
                tags.append(line.count(" ", 0, end) - 1)  # the tag's last word
                continue
            labels.add(label)
            if is_base:
                start = end - len(phrase) - 1  # of the blank before the phrase
                counted, at = (counted + line.count(" ", at, start), start) if start >= at else (line.count(" ", 0, start), start)
                places.append(counted)
                base.add(label)
        asks, parsed = None, 0
        if tags:
            ends = [m.end() for m in _WORD.finditer(text)]
            for last in tags:
                if got := evaluate(_REST.match(text, ends[last])[1].decode(errors="replace")):
                    parsed += 1
                    labels |= got[0]
                    asks = max(asks or 0, got[1])
        notices = len(labels)
        score = 1.0 - 0.1**parsed * 0.3 ** min(notices, 8) if parsed or notices else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, asks


SCHEMA = [("n_words", pa.int64(), "bigint"), ("n_base", pa.int64(), "bigint"), ("first_word", pa.int64(), "bigint"), ("last_word", pa.int64(), "bigint"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"), ("expression_demands", pa.int32(), "int")]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest word position, from 0), base_labels, labels (distinct, sorted, comma-joined), score (0 to 1, more with more
    evidence), expression_demands (of the strictest licence expression; null without one).

    A null text counts as empty: no words, empty labels, score 0, null positions. Equal labels count once. An expression
    follows a tag on its line or, if nothing more stands there, on the next, and ends where prose begins; a malformed one
    adds nothing. Repeated rows and null ids keep their rows; an empty table gives an empty result; other
    columns of docs are dropped, so that names cannot clash. Long texts are scanned whole.
    """
    scanner = per_worker(Scanner)
    kind = dict(docs.dtypes)[id_col]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scanner().scan(t or b"") for t in texts(batch, text_col)]
        out = {id_col: batch.column(id_col)}
        for i, (name, arrow, _) in enumerate(SCHEMA):
            out[name] = pa.array([r[i] for r in rows], arrow)
        return pa.record_batch(out)

    return map_slices(docs.select(id_col, text_col), text_col, make, f"`{id_col}` {kind}, " + ", ".join(f"{name} {sql}" for name, _, sql in SCHEMA))
