"""The threshold algorithm against scores of all documents."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import ranked_search

from . import brute
from .test_operators import EMPTY, frame, some_docs

ITEMS = "item_id long, text string, rank string, score int"


def ranked(found):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect())


def some_items(docs, seed=3):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choice(docs)[1].split()[:20] if docs and rnd.random() < 0.7 else ["alpha", "Alpha", "nowhere"])) for i in range(12)]
    return [(i, t, "x", 1) for i, t in [*items, (20, None), (21, ""), (22, "?!"), (None, "alpha"), (23, "alpha"), (23, "beta beta"), (24, "ÄRGER ärger")]]


@pytest.mark.parametrize("block, terms, rounds", [(1 << 20, 500_000, 64), (50, 500_000, 1), (300, 10, 3)])
def test_ranked_search(spark, monkeypatch, block, terms, rounds):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "TERMS", terms)
    monkeypatch.setattr(ranked_search, "ROUND", rounds)
    monkeypatch.setattr(ranked_search, "PIECE", 100)
    docs = [(d, t) for d, t in some_docs(11) if t is not None]
    docs += [(None, docs[0][1]), (docs[0]), (9000, docs[0][1]), (9001, "Ärger ärger"), (9002, "...")]
    items = some_items([x for x in docs if len(x[1].split()) > 5])
    found = ranked_search.search(frame(spark, [*docs, (9003, None)]).repartition(3), spark.createDataFrame(items, ITEMS))
    assert ranked(found) == brute.ranked_search(docs, [(i, t) for i, t, *_ in items])


def test_ranked_search_stops_early_without_losing_ties(spark):
    """Rare terms lead their lists: the rest isn't read. Of many equal scores, the smallest ids win."""
    docs = [(i, "common words " + ("rare" if i < 30 else f"x{i}")) for i in range(5000)]
    weights, rows = np.array([2000, 3]), pa.table({"id": [i for i, _ in docs], "n": [3] * 5000, "terms": pa.array([[0, 1] if i < 30 else [1] for i, _ in docs], pa.list_(pa.int32())), "tfs": pa.array([[1, 1] if i < 30 else [1] for i, _ in docs], pa.list_(pa.int64()))})
    found, scores, rounds = ranked_search.Block(rows, weights, 5000, 15000).best(np.array([0, 1]), np.array([1, 1]), 20, 0)
    assert found.tolist() == list(range(20)) and len(set(scores.tolist())) == 1 and rounds == 1
    items = spark.createDataFrame([(1, "rare common", "", 0), (2, "common", "", 0)], ITEMS)
    assert ranked(ranked_search.search(spark.createDataFrame(docs, EMPTY), items)) == brute.ranked_search(docs, [(1, "rare common"), (2, "common")])


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], EMPTY)
    assert ranked_search.search(none, spark.createDataFrame([(1, "alpha", "", 0)], ITEMS)).count() == 0
    assert ranked_search.search(spark.createDataFrame([(1, "alpha")], EMPTY), spark.createDataFrame([], ITEMS)).count() == 0
    found = ranked_search.search(spark.createDataFrame([(1, "alpha " * 300_000 + "beta"), (2, "beta")], EMPTY), spark.createDataFrame([(1, "beta", "", 0)], ITEMS), k=1)
    assert [(r["rank"], r.doc_id) for r in found.collect()] == [(1, 2)]
