"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-gram buckets per language on a bounded sample of the labelled rows, as a Spark aggregation. The matrix of
log-probabilities (languages x buckets, so bounded by the number of languages) is broadcast with the scoring tasks, which
sum matrix entries over the n-grams of whole texts in numpy, slice by slice. Scoring shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_slices, texts

#: Bits of a bucket's number; each n-gram length has its own range of buckets.
BITS = 15
ORDERS = (1, 2, 3)
#: Rows that training takes at most, on average; a hash of the id picks them.
TRAINING_ROWS = 20_000
UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass
class Model:
    languages: list[str]
    #: By language, bucket.
    weights: np.ndarray
    priors: np.ndarray


def joined(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a blank before, between and after them; where each text's blank is."""
    lower = [t.decode().lower() if t else "" for t in batch]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
    return np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le"), np.uint32), at


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point (but for the last ones)."""
    n = len(points) - order + 1
    mixed = np.zeros(n, np.uint32)
    for i in range(order):
        mixed += points[i : i + n] * _FACTORS[i]
        mixed ^= mixed >> np.uint32(15)
        mixed *= _FACTORS[0]
    return (mixed >> np.uint32(32 - BITS)).astype(np.int32) + (ORDERS.index(order) << BITS)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAINING_ROWS) -> Model:
    """A model from the rows outside the held-out fold that have a label and a text."""
    labelled = docs.filter(~held_out(docs[id_col]) & docs[label_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[label_col].alias("label"))
    there = labelled.count()
    share = min(1.0, rows / max(1, there))
    picked = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("text", "label")

    def count(batches):
        width = len(ORDERS) << BITS
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), texts(batch, "text")):
                points, _ = joined([text])
                total = sums.setdefault(label, np.zeros(width + 1, np.int64))
                total[width] += 1
                for order in ORDERS:
                    if len(points) >= order:
                        found = np.bincount(buckets(points, order))
                        total[: len(found)] += found
        for label, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.record_batch({"label": pa.array([label] * len(some), pa.string()), "bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    counts = picked.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique().tolist())
    if not languages:
        return Model([], np.zeros((0, len(ORDERS) << BITS), np.float32), np.zeros(0))
    total = np.zeros((len(languages), (len(ORDERS) << BITS) + 1))
    total[[languages.index(x) for x in counts["label"]], counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    seen, priors = total[:, :-1].reshape(len(languages), len(ORDERS), -1) + 0.1, total[:, -1]
    weights = np.log(seen / seen.sum(axis=2, keepdims=True)).reshape(len(languages), -1)
    return Model(languages, np.ascontiguousarray(weights, np.float32), np.log(priors / priors.sum()))


def scores(model: Model, batch: list[bytes | None]) -> np.ndarray:
    """Posterior probabilities, by text and language."""
    points, at = joined(batch)
    sums = np.tile(model.priors, (len(batch), 1))
    for order in ORDERS:
        if len(points) < order:
            continue
        found = buckets(points, order)
        # a text's n-grams start at its blank at the earliest and end at the blank after it
        starts, ends = np.minimum(at[:-1], len(found)), np.clip(at[1:] - order + 2, at[:-1], len(found))
        for k in range(len(model.languages)):
            run = np.concatenate([[0.0], np.cumsum(model.weights[k][found], dtype=np.float64)])
            sums[:, k] += run[ends] - run[starts]
    sums -= sums.max(axis=1, keepdims=True)
    odds = np.exp(sums)
    return odds / odds.sum(axis=1, keepdims=True)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(map(str.isalpha, text.decode()))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter, which are those that identify() gives a language if the model learned one."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([has_letter(t) for t in texts(batch, text_col)], pa.bool_()))

    return map_slices(docs, text_col, pick, schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, lang_pred, score, and the columns in keep.

    A text that is null or has no letter gets `und` with score 0, as does every text if the model learned no language.
    Between equal scores the alphabetically first language wins. Repeated rows and null ids keep their rows; an empty table
    gives an empty result; other columns are dropped, and those in keep named as the results are replaced by them. Long
    texts are scored whole.
    """
    kinds = dict(docs.dtypes)
    kept = [id_col, *(c for c in keep or [] if c not in (id_col, "lang_pred", "score"))]
    schema = "".join(f"`{c}` {kinds[c]}, " for c in kept) + "lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, found = shared.value, texts(batch, text_col)
        out = {c: batch.column(c) for c in kept}
        if model.languages:
            odds = scores(model, found)
            best, some = odds.argmax(axis=1), [has_letter(t) for t in found]
            out["lang_pred"] = pa.array([model.languages[k] if x else UNDETERMINED for k, x in zip(best, some)], pa.string())
            out["score"] = pa.array([float(o) if x else 0.0 for o, x in zip(odds.max(axis=1), some)], pa.float64())
        else:
            out["lang_pred"] = pa.array([UNDETERMINED] * len(found), pa.string())
            out["score"] = pa.array([0.0] * len(found), pa.float64())
        return pa.record_batch(out)

    return map_slices(docs.select(*dict.fromkeys([*kept, text_col])), text_col, make, schema, limit=1 << 20)
