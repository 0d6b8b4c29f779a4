"""Ranked lexical search by the threshold algorithm.

A first pass over the texts writes the forward index: of each document its length and how often it holds each term that an
item asks for. Counts over that table (documents, lengths, documents of a term) give every posting its impact, an integer.
A second pass searches blocks of the forward index, each where it is read: the postings of a block are sorted into lists by
falling impact, and each item reads its lists round-robin. Every document seen there for the first time gets its whole score
by look-ups in the block's forward index; when what the lists can still give together (the threshold) falls strictly below
the k-th score found so far, no document that wasn't seen can be among the best, not even by a tie, and the block is left.
The k-th score goes along from block to block of a task. Blocks are cut by postings, so that a term that every document
holds is no list of its own in one task; only the best k of a task leave it, and they meet in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, texts, written

#: Distinct terms of the items that go to the documents at once; items with more are searched in several passes.
TERMS = 500_000
#: Postings and documents of a block.
BLOCK = 1 << 20
#: Sorted accesses to each list in one round.
ROUND = 64
#: Bytes of a text that are cut into terms at once.
PIECE = 4 << 20

#: Digits, letters and what lies beyond ASCII make terms; A-Z are lower-cased, all else parts them.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

FORWARD = "id bigint, n bigint, terms array<int>, tfs array<bigint>"


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    bare = (text or b"").translate(_TERM_BYTES)
    at = 0
    while at < len(bare):
        stop = bare.find(b" ", at + PIECE) if at + PIECE < len(bare) else -1
        stop = len(bare) if stop < 0 else stop
        yield bare[at:stop].split()
        at = stop


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, term, times: how often an item holds a term; rows of one id count together."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, term.decode(), n) for i, t in zip(batch.column("item").to_pylist(), texts(batch, "text")) for term, n in sum((Counter(some) for some in terms_of(t)), Counter()).items()]
        return pa.record_batch({"item": pa.array([r[0] for r in rows], pa.int64()), "term": pa.array([r[1] for r in rows], pa.string()), "times": pa.array([r[2] for r in rows], pa.int64())})

    named = items.filter(items[id_col].isNotNull()).select(items[id_col].cast("long").alias("item"), items[text_col].alias("text"))
    return map_slices(named, "text", count, "item bigint, term string, times bigint").groupBy("item", "term").agg(F.sum("times").alias("times"))


def forward_index(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the text, with repeats), terms (numbers in the vocabulary, ascending), tfs: a row for each document
    that has a term at all."""
    numbers = docs.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(vocabulary)})

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        number, n, held = numbers.value.get, [], []
        for text in texts(batch, "text"):
            total, own = 0, Counter()
            for some in terms_of(text):
                total += len(some)
                own.update(map(number, some))
            own.pop(None, None)
            n.append(total)
            held.append(sorted(own.items()))
        out = pa.record_batch({"id": batch.column("id"), "n": pa.array(n, pa.int64()), "terms": pa.array([[t for t, _ in h] for h in held], pa.list_(pa.int32())), "tfs": pa.array([[c for _, c in h] for h in held], pa.list_(pa.int64()))})
        return out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    return map_slices(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), "text", index, FORWARD)


class Block:
    """Documents with their impacts, as a forward index (sorted by document and term) and as lists by falling impact."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        column = lambda name: batch.column(name).combine_chunks() if isinstance(batch, pa.Table) else batch.column(name)
        ids = column("id")
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        sizes = column("terms").value_lengths().to_numpy(zero_copy_only=False)
        terms, tf = (column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
        of = np.repeat(np.arange(len(sizes)), sizes)
        m = np.array([75 + 25 * n * n_docs // n_terms for n in column("n").to_pylist()], np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[of]))
        self.width = len(weights)
        self.keys, self.impacts = of * self.width + terms, impact
        order = np.lexsort((of, -impact, terms))
        self.docs, self.falling = of[order], impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(self.width + 1))

    def scores(self, docs: np.ndarray, query: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Random accesses: the documents' whole scores."""
        asked = docs[:, None] * self.width + query[None, :]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.impacts[at], 0) @ times

    def best(self, query: np.ndarray, times: np.ndarray, k: int, kth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the best k and their scores, where `kth` is a k-th score already found elsewhere (0
        without one); and how many rounds were read."""
        starts, ends = self.starts[query], self.starts[query + 1]
        some = ends > starts
        query, times, starts, ends = query[some], times[some], starts[some], ends[some]
        seen = np.zeros(len(self.ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = rounds = 0
        while len(query) and depth < (ends - starts).max():
            met = np.unique(np.concatenate([self.docs[s + depth : min(e, s + depth + ROUND)] for s, e in zip(starts, ends)]))
            new = met[~seen[met]]
            seen[new] = True
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new, query, times)])
            if len(docs) > k:
                top = np.lexsort((self.ids[docs], self.none[docs], -scores))[:k]
                docs, scores = docs[top], scores[top]
                kth = max(kth, int(scores[-1]))
            elif len(docs) == k:
                kth = max(kth, int(scores.min()))
            depth, rounds = depth + ROUND, rounds + 1
            last = starts + depth - 1
            threshold = int((times * np.where(last < ends, self.falling[np.minimum(last, ends - 1)], 0)).sum())
            if threshold < kth:
                break
        return docs, scores, rounds


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per item and rank: item id, rank (from 1), doc id, score: the k documents of highest score above 0, equal
    scores by ascending id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. N documents with
    a term at all hold L terms; df of them hold a term, whose weight is floor(1000 ln((2N+2)/(2df+1))). A document of n terms
    has m = 75 + 25nN div L; each of the item's terms, repeats included, that it holds tf times adds
    weight * (1e9 tf div (1000 tf + 12 m)).

    Null and empty texts and texts without a term count for nothing and are never found. Items without terms, and those
    whose terms no document holds, give no rows; items with a null id take no part; rows with one item id are one item.
    Documents with a null id come after all others of their score; repeated rows are each ranked. Empty tables give an empty
    result. Other columns are ignored. Texts of any length are read whole; ids must be integers.
    """
    spark, kinds = docs.sparkSession, (dict(items.dtypes)[item_col], dict(docs.dtypes)[id_col])
    asked = written(item_terms(items, item_col, item_text_col), "item-terms")
    passes = max(1, math.ceil(asked.count() / TERMS))
    found = None
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        some = _best(docs, part, k, id_col, text_col)
        found = some if found is None else found.unionByName(some)
    # the best of each task meet in about as many groups as there are tasks in each of them
    groups = max(1, math.isqrt(max(1, found.agg(F.max("part")).first()[0] or 0)))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", F.pmod("part", F.lit(groups))).orderBy(*order))).filter(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select(F.col("item").cast(kinds[0]).alias(item_col), "rank", F.col("id").cast(kinds[1]).alias(id_col), "score")


def _best(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """item, id, score, part: the best k of each task for the items of one pass."""
    spark = docs.sparkSession
    vocabulary = sorted(r["term"] for r in asked.select("term").distinct().collect())
    forward = written(forward_index(docs, vocabulary, id_col, text_col), "forward-index")
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["count"] for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    number = {w: i for i, w in enumerate(vocabulary)}
    queries: dict[int, list[tuple[int, int]]] = {}
    for r in asked.collect():
        queries.setdefault(r["item"], []).append((number[r["term"]], r["times"]))
    sent = spark.sparkContext.broadcast((weights, [(i, np.array([t for t, _ in sorted(q)]), np.array([c for _, c in sorted(q)])) for i, q in sorted(queries.items())]))

    def rank(batches):
        weights, items = sent.value
        none = np.zeros(0, np.int64)
        tops = [(none, none, none.astype(bool))] * len(items)
        held: list[pa.RecordBatch] = []
        size = 0

        def settle():
            block = Block(pa.Table.from_batches(held), weights, n_docs, n_terms)
            if not len(block.keys):
                return
            for i, (_, query, times) in enumerate(items):
                scores, ids, without = tops[i]
                found, more, _ = block.best(query, times, k, int(scores[-1]) if len(scores) == k else 0)
                if len(found):
                    scores, ids, without = np.concatenate([scores, more]), np.concatenate([ids, block.ids[found]]), np.concatenate([without, block.none[found]])
                    best = np.lexsort((ids, without, -scores))[:k]
                    best = best[scores[best] > 0]
                    tops[i] = scores[best], ids[best], without[best]

        for batch in batches:
            sizes = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False) + 1)
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, before + BLOCK - size, side="right")))
                held.append(batch.slice(at, stop - at))
                size += int(sizes[stop - 1]) - before
                at = stop
                if size >= BLOCK or at < batch.num_rows:
                    settle()
                    held.clear()
                    size = 0
        if held:
            settle()
        part = TaskContext.get().partitionId()
        for (item, _, _), (scores, ids, without) in zip(items, tops):
            if len(scores):
                yield pa.record_batch({"item": pa.array([item] * len(scores), pa.int64()), "id": pa.array(ids, pa.int64(), mask=without), "score": pa.array(scores, pa.int64()), "part": pa.array([part] * len(scores), pa.int64())})

    return written(forward.mapInArrow(rank, "item bigint, id bigint, score bigint, part bigint"), "best-of-tasks")
