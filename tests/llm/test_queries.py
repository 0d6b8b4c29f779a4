"""The registered queries and the pipeline on the small tables."""

import zlib

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import queries

from ..parity import connection, duck_rows, spark_rows
from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(connection(sf_dir), queries.ORACLE_SQL[name])


def test_forest_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    found = queries.op1_ann_forest(spark, sf_dir).collect()
    hits = asked = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in found if r.query_id == ids[q]} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        asked += 20
    assert len(found) == asked and hits / asked >= 0.9


def test_token_counts(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path(queries.WORD_BPE))
    want = [(d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 2048) for d, t in docs]
    assert sorted(tuple(r) for r in queries.op2_token_counts(spark, sf_dir).collect()) == want


def test_sentencepiece(spark, sf_dir, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=path(queries.PIECE_BPE))
    found = {r.doc_id: r for r in queries.op4_sentencepiece(spark, sf_dir).collect()}
    for d, t in docs:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert found[d].n_tokens == len(ids) and found[d].decoded_sha256 == brute.sha(library.decode(ids))


def test_license_scan(spark, sf_dir, docs):
    found = {r.doc_id: r for r in queries.op5_license_scan(spark, sf_dir).collect()}
    assert [(found[d].n_words, found[d].n_base, found[d].first_word, found[d].last_word, found[d].base_labels) for d, _ in docs] == [brute.license_base(t) for _, t in docs]


def test_toxicity_and_language_on_held_out(spark, sf_dir, docs):
    toxic = queries.op7_toxicity(spark, sf_dir).collect()
    assert len(toxic) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in toxic)
    found = queries.op10_language_id(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = [r for r in found if r.held_out]
    assert {r.doc_id for r in out} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.95


def test_decontamination(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, item in items if item in t}
    assert {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf_dir).collect()} == want


def test_pipeline(spark, sf_dir, docs):
    """Each stage against a plain version, on what its predecessor kept."""
    held = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = held.columns
    kept = dict(docs)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, held, sf_dir)
        rows = {r.doc_id: r for r in found.collect()}
        if name == "language_id":
            kept = {d: t for d, t in kept.items() if any(map(str.isalpha, t))}
        elif name == "line_dedup":
            plain = {d: s for d, _, _, s in brute.line_dedup(sorted(kept.items()))}
            assert {d: brute.sha(r.text) for d, r in rows.items()} == plain
            kept = {d: r.text for d, r in rows.items()}
        elif name == "near_dedup":
            kept = {d: kept[d] for d, _, _, stays in brute.near_dedup(sorted(kept.items()), 5, 80) if stays}
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            kept = {d: t for d, t in kept.items() if not any(i in t for i in items)}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=path(queries.PIECE_BPE))
            assert {d: r.ids for d, r in rows.items()} == {d: library.encode(t, add_bos=True, add_eos=True) for d, t in kept.items()}
            break
        assert found.columns == columns and {d: r.text for d, r in rows.items()} == kept, name
        held = found


def test_pipeline_without_labels(spark):
    rows = [(1, "a clean text", None), (2, None, None), (3, "", None), (4, "12 !?", None), (5, "7 \u00e9", None), (None, "no id", None)]
    held = spark.createDataFrame([(*r, "web", 12) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.identify_language(spark, held, "")
    assert found.columns == held.columns and {tuple(r) for r in found.collect()} == {(*rows[i], "web", 12) for i in (0, 4, 5)}
    labelled = held.withColumn("lang", F.when(F.col("doc_id").isNull(), "en"))  # the label's row is held out
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, labelled, "").collect()} == {1, 5, None}
