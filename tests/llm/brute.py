"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs: list[tuple], least: int = 13) -> list[tuple]:
    """(id, n_words, n_removed, kept_sha256) in the order of docs; ids and texts may be null."""
    first: dict[tuple, int] = {}
    cut = [WORD.findall(t or "") for _, t in docs]
    for (d, _), ws in zip(docs, cut):
        if d is not None:
            for i in range(len(ws) - least + 1):
                key = tuple(ws[i : i + least])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), ws in zip(docs, cut):
        gone = set()
        if d is not None:
            for i in range(len(ws) - least + 1):
                if first[tuple(ws[i : i + least])] < d:
                    gone.update(range(i, i + least))
        out.append((d, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


def line_dedup(docs: list[tuple], shortest: int = 40, least: int = 5) -> list[tuple]:
    holders = defaultdict(set)
    key = lambda line: ascii_lower(line.strip(STRIP))
    for d, t in docs:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= shortest:
                    holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(key(x)) < shortest or len(holders[key(x)]) < least or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    ws = [ascii_lower(w) for w in WORD.findall(text or "")]
    if len(ws) < size:
        return frozenset([tuple(ws)]) if ws else frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))


def near_dedup(docs: list[tuple], size: int = 3, hundredths: int = 85) -> list[tuple]:
    """(id, n_shingles, component_id, kept); ids are distinct and not null."""
    sets = {d: shingles(t, size) for d, t in docs}
    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    both = defaultdict(int)
    for ds in held.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= hundredths * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return [(d, len(s), root(d), root(d) == d) for d, s in sets.items()]


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels."""
    ws = LICENSE_WORD.findall(ascii_lower(text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_search(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    """(item, rank, id, score) of all scores of all documents."""
    terms = lambda t: Counter(TERM.findall(ascii_lower(t or "")))
    held = [(d, c) for d, c in ((d, terms(t)) for d, t in docs) if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, c in held:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in q.items() if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def leaf(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests: list[str], arity: int) -> tuple[str, list[list[str]]]:
    """The root, and for each leaf the siblings on its way up, a pair of texts for each level."""
    paths = [[] for _ in digests]
    held = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [digests[i : i + arity] for i in range(0, len(digests), arity)]
        for at, own in enumerate(held):
            run, slot = runs[at // arity], at % arity
            for i in own:
                paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        held = [sum(held[i : i + arity], []) for i in range(0, len(held), arity)]
        digests = [sha("".join(run)) for run in runs]
    return digests[0], paths


def merkle(rows: list[tuple], arity: int = 16) -> list[tuple]:
    """rows: id, group, leaf. (id, leaf, subroot, root, path) of each."""
    groups = defaultdict(list)
    for d, g, x in rows:
        groups[g].append((d is not None, d or 0, x))
    subroots, below = [], []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        own = sorted(groups[g])
        top, paths = tree([x for _, _, x in own], arity)
        subroots.append(top)
        below.append([(d if some else None, x, top, path) for (some, d, x), path in zip(own, paths)])
    root, over = tree(subroots, arity) if subroots else (None, [])
    return [(d, x, top, root, [*path, *above]) for own, above in zip(below, over) for d, x, top, path in own]


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text: str | None) -> list[tuple]:
    """(kind, start, end) of the base patterns, by kind and place."""
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out
