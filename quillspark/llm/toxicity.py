"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows around what they find.

The lexicon is learned from a bounded sample of labelled documents, as counts in Spark: words much commoner in toxic texts.
Its trie and the Levenshtein automata of its words are intersected into one table of states, which reads all words of a
slice of texts side by side in numpy; a word that ends in an accepting state is a lexicon word or a misspelling of one. For
each hit, a window of characters around it tells quotation (quote marks around it, words of report) from abuse (words of
address). A logistic model over the hits' sums gives the score. Scoring happens where the text is read and shuffles nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_slices, slices, texts, written
from .words import mix

#: Labelled documents that training takes at most; a hash of the id picks them.
TRAINING_ROWS = 8_000
#: Characters of context on either side of a hit.
WINDOW = 60
# Words of report and of address, in the languages of the corpus.
REPORT = "said says wrote writes called calls quote quoted quotes word words dit appelle mot sagte nannte wort dijo palabra".split()
ADDRESS = "you your youre u tu toi vous du dich sie ihr te usted".split()
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
_WORD = re.compile(r"[^\W\d_]+")


def edits(word: str) -> int:
    """How many edits a misspelling of the word may have."""
    return 1 if len(word) >= 5 else 0


class Automaton:
    """The trie's words under Levenshtein distance, as one deterministic table over classes of characters."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = lexicon
        letters = sorted(set("".join(lexicon)))
        self.classes = np.zeros(1 << 16, np.uint16)
        for i, c in enumerate(letters):
            if ord(c) < len(self.classes):
                self.classes[ord(c)] = i + 1
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, word in enumerate(lexicon):
            node = 0
            for c in word:
                letter = letters.index(c) + 1
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][letter]
            ends[node] = k
        most = max(map(edits, lexicon), default=0)

        def closed(state: dict[int, int]) -> frozenset:
            """With the nodes that are reached by leaving out lexicon letters."""
            waiting = list(state.items())
            while waiting:
                node, d = waiting.pop()
                if d < most:
                    for child in children[node].values():
                        if state.get(child, most + 1) > d + 1:
                            state[child] = d + 1
                            waiting.append((child, d + 1))
            return frozenset(state.items())

        def step(state: frozenset, letter: int) -> frozenset:
            out: dict[int, int] = {}
            for node, d in state:
                if d < most:
                    out[node] = min(out.get(node, most + 1), d + 1)
                for c, child in children[node].items():
                    cost = d + (c != letter)
                    if cost <= most:
                        out[child] = min(out.get(child, most + 1), cost)
            return closed(out)

        numbers: dict[frozenset, int] = {frozenset(): 0, closed({0: 0}): 1}
        rows: list[list[int]] = []
        states = list(numbers)
        while len(rows) < len(states):
            row = []
            for letter in range(len(letters) + 1):
                to = step(states[len(rows)], letter)
                if to not in numbers:
                    numbers[to] = len(states)
                    states.append(to)
                row.append(numbers[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.word = np.full(len(states), -1, np.int32)
        self.edits = np.zeros(len(states), np.int8)
        for i, state in enumerate(states):
            best = min(((d, ends[node]) for node, d in state if ends[node] >= 0 and d <= edits(lexicon[ends[node]])), default=None)
            if best:
                self.edits[i], self.word[i] = best
        self.longest = max(map(len, lexicon), default=0) + most

    def read(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The state in which each word ends; 0 is the dead one."""
        state = np.where(lengths <= self.longest, 1, 0).astype(np.int32)
        alive = np.flatnonzero(state)
        for j in range(self.longest):
            alive = alive[lengths[alive] > j]
            if not len(alive):
                break
            point = points[starts[alive] + j]
            letter = np.where(point < len(self.classes), self.classes[np.minimum(point, len(self.classes) - 1)], 0)
            state[alive] = self.table[state[alive], letter]
            alive = alive[state[alive] > 0]
        return state


@dataclass
class Model:
    lexicon: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    automaton: Automaton | None = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "automaton": None}

    def ready(self) -> Automaton:
        if self.automaton is None:
            self.automaton = Automaton(self.lexicon)
        return self.automaton


FEATURES = 6
_letter: list[np.ndarray] = []
_space: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    return _letter[0]


def _spaces() -> np.ndarray:
    if not _space:
        _space.append(np.array([chr(i).isspace() for i in range(1 << 16)]))
    return _space[0]


def quoted(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether the window around a hit shows a quotation, and whether it addresses someone."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    opened = max((before.rfind(q) for q in _OPEN), default=-1)
    closed = any(q in after for q in _CLOSE)
    open_now = opened >= 0 and closed and sum(before.count(q) for q in _OPEN) > sum(before.count(q) for q in set(_CLOSE) - set(_OPEN))
    near = {w for w in _WORD.findall(before + " " + after)}
    return open_now or bool(near & set(REPORT)), bool(near & set(ADDRESS))


def features(model: Model, batch: list[bytes | None]) -> np.ndarray:
    """By text: 1; exact hits, misspelled hits, quoted hits, hits that address (logs of counts + 1); hits in 100 words."""
    automaton = model.ready()
    lower = [t.decode().lower() if t else "" for t in batch]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
    points = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le"), np.uint32)
    letter = _letters()[np.minimum(points, (1 << 16) - 1)] & (points < (1 << 16) - 1)
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    state = automaton.read(points, starts, ends - starts)
    n_words = np.diff(np.searchsorted(starts, at))
    # one digit or symbol between letters can stand for a letter, or be put in: words on both sides of it are read as one
    # too (with more than one, it is more than one edit), unless one of them is a hit by itself
    hit = automaton.word[state] >= 0
    joins = np.flatnonzero((starts[1:] - ends[:-1] == 1) & ~hit[:-1] & ~hit[1:]) if len(starts) else starts
    joins = joins[~_spaces()[np.minimum(points[ends[joins]], (1 << 16) - 1)]]
    joined = automaton.read(points, starts[joins], ends[joins + 1] - starts[joins])
    starts, ends, state = np.concatenate([starts, starts[joins]]), np.concatenate([ends, ends[joins + 1]]), np.concatenate([state, joined])
    hits = np.flatnonzero(automaton.word[state] >= 0)
    of = np.searchsorted(at, starts[hits], side="right") - 1
    counts = np.zeros((len(batch), 4))
    for h, text in zip(hits.tolist(), of.tolist()):
        start = int(starts[h] - at[text])
        said, told = quoted(lower[text], start, start + int(ends[h] - starts[h]))
        if said:
            counts[text, 2] += 1
        else:
            counts[text, int(automaton.edits[state[h]] > 0)] += 1
            counts[text, 3] += told
    rate = 100.0 * counts[:, :2].sum(axis=1) / np.maximum(1, n_words)
    return np.column_stack([np.ones(len(batch)), np.log1p(counts), np.log1p(rate)])


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Words of toxic texts, all that are significantly commoner there than in others. Near copies count once: a text counts by the least hash of its runs of five words."""

    def distinct(batches):
        for batch in slices(batches, "text"):
            word, toxic, sign = [], [], []
            for text, label in zip(texts(batch, "text"), batch.column("toxic").to_pylist()):
                own = _WORD.findall(text.decode().lower()) if text else []
                hashes = np.array([hash_of(w) for w in own], np.uint64)
                runs = sum((hashes[i : max(i, len(hashes) - 4 + i)] * np.uint64(2 * i + 3) for i in range(5)), np.zeros(max(0, len(hashes) - 4), np.uint64))
                own = sorted(set(own))
                word += own
                toxic += [label] * len(own)
                sign += [int(mix(runs).min() >> np.uint64(1)) if len(runs) else 0] * len(own)
            yield pa.record_batch({"word": pa.array(word, pa.string()), "toxic": pa.array(toxic, pa.int32()), "sign": pa.array(sign, pa.int64())})

    seen = rows.mapInArrow(distinct, "word string, toxic int, sign bigint").distinct()
    counted = seen.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    totals = seen.agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("sign"))).alias("bad"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("sign"))).alias("good")).first()
    bad, good = max(1, totals["bad"]), max(1, totals["good"])
    share, rest = F.col("bad") / bad, (F.col("good") + 0.5) / good
    even = (F.col("bad") + F.col("good") + 0.5) / (bad + good)
    telling = (F.col("bad") >= 3) & (share >= 5 * rest) & ((share - rest) / F.sqrt(even * (1 - even) * (1 / bad + 1 / good)) >= 4)
    return sorted(r["word"] for r in counted.filter(telling).select("word").collect())


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode())


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the first column, the constant, isn't held back."""
    weights, hold = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """A model from at most `rows` labelled documents outside the held-out fold. Of several labels of one id the largest
    counts. Without both labels in the sample, the model gives all texts the sample's share of 1 (0.5 without a sample)."""
    given = labels.filter(~held_out(labels[id_col]) & labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    picked = given.orderBy(F.xxhash64("id"), "id").limit(rows)  # `rows` rows of two numbers: small enough to broadcast
    sample = written(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(picked), "id").select("text", "toxic"), "toxicity-sample")
    model = Model(learn_lexicon(sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(shared.value, texts(batch, "text"))
        return pa.record_batch({"x": pa.array(list(x), pa.list_(pa.float64())), "y": batch.column("toxic").cast(pa.float64())})

    found = map_slices(sample, "text", describe, "x array<double>, y double").collect()
    y = np.array([r["y"] for r in found])
    if len(y) and 0 < y.mean() < 1:
        model.weights = fit(np.array([r["x"] for r in found]), y)
    else:
        share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
        model.weights[0] = np.log(share / (1 - share))
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold, else 0).

    A null or empty text, or one without a hit, gets the model's score for no hits. Repeated rows and null ids keep their
    rows; an empty table gives an empty result; other columns are dropped, so that names cannot clash. Texts are scored
    whole, whatever their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        odds = features(model, texts(batch, text_col)) @ model.weights
        score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return pa.record_batch({id_col: batch.column(id_col), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())})

    return map_slices(docs.select(id_col, text_col), text_col, make, f"`{id_col}` {kind}, score double, predicted int", limit=2 << 20)
