"""The pipeline's stages and the operators on odd tables: clashing names, nulls, repeated rows, empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from quillspark.llm import common, decontaminate, language_id, license_scan, line_dedup, near_dedup, sentencepiece_codec, substring_dedup, token_counts, toxicity

#: Names that operators and stages use themselves.
CLASHES = ["id", "n", "k", "v", "z", "key", "block", "part", "bucket", "score", "Lang_Pred", "kept", "N_Lines", "n_dropped", "lost_id", "lost_keys", "held_id", "gone_id", "is_query", "size", "hash", "class_id", "component", "text_sha", "content", "ids", "value", "digest"]
ITEM = "what is the boiling point of pure water at sea level then"
LINE = "this line is clearly longer than forty characters and stands in many documents"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    body = "some words of a document that is about nothing in particular number"
    texts = [f"{body} {i} and goes on for {i * 7} more words\n{LINE}" for i in range(6)]
    texts += [texts[0], "so " + ITEM + " and more", None, "", "12 34", "x"]
    found = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    return [*found, found[1], (None, texts[2], "en", "web", len(texts[2]))]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def with_clashes(spark, docs):
    return spark.createDataFrame([(*r, *(f"own {c}" for c in CLASHES)) for r in docs], DOCS + "".join(f", {c} string" for c in CLASHES))


def told(found, columns):
    return sorted(map(str, (tuple(r[c] for c in columns) for r in found.collect())))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_other_columns(spark, sf, name, stage):
    plain = spark.createDataFrame(rows(), DOCS)
    want, found = stage(spark, plain, sf), stage(spark, with_clashes(spark, rows()), sf)
    assert told(found, want.columns) == told(want, want.columns)
    if name != "sentencepiece":
        assert found.columns == [*plain.columns, *CLASHES] and want.columns == plain.columns
        assert all(r[c] == f"own {c}" for r in found.collect() for c in CLASHES)
    assert stage(spark, plain.limit(0), sf).count() == 0


def test_stages_on_nulls_and_repeated_rows(spark, sf):
    docs = spark.createDataFrame(rows(), DOCS)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name: sorted((r.doc_id for r in stages[name](spark, docs, sf).collect()), key=lambda d: (d is None, d))
    assert ids("language_id") == [0, 1, 1, 2, 3, 4, 5, 6, 7, 11, None]
    assert ids("line_dedup") == [*range(2), 1, *range(2, 12), None]
    left = {r.doc_id: r for r in stages["line_dedup"](spark, docs, sf).collect()}
    assert LINE in left[6].text and all(LINE not in left[i].text and left[i].n_chars == len(left[i].text) for i in range(6)) and LINE in left[None].text
    assert ids("near_dedup") == [0, 1, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, None]
    assert ids("decontamination") == [0, 1, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, None]
    assert len(ids("sentencepiece")) == 14


OPERATORS = {
    "token_counts": lambda d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
    "substring_dedup": lambda d: substring_dedup.dedup_substrings(d),
    "sentencepiece": lambda d: sentencepiece_codec.encode_decode(d, public_tokenizers.path("piece_bpe_32k.model")),
    "license_scan": lambda d: license_scan.scan_licenses(d),
    "line_dedup": lambda d: line_dedup.dedup_lines(d, keep=["lost_id", "lost_keys", "id"]) if "lost_id" in d.columns else line_dedup.dedup_lines(d),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))),
    "decontamination": lambda d: decontaminate.find_leaks(d, d.selectExpr("doc_id AS item_id", "text").filter("item_id = 7")),
    "near_dedup": lambda d: near_dedup.near_duplicates(d),
    "language_id": lambda d: language_id.identify(d, language_id.train(d), keep=["held_id"] if "held_id" in d.columns else None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_other_columns(spark, name):
    plain, clash = spark.createDataFrame(rows(), DOCS), with_clashes(spark, rows())
    want = OPERATORS[name](plain)
    assert told(OPERATORS[name](clash), want.columns) == told(want, want.columns)
    assert OPERATORS[name](clash.limit(0)).count() == 0


def test_rows_among_ids(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i, f"{i}") for i in range(2000)] + [(None, 0, "x")], "at long, word long, found string")
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 10)], "id long")
    some = common.among(rows, "at", ids)
    kept = {r["at"] for r in some.collect()}
    assert some.columns == rows.columns and set(range(0, 2000, 10)) <= kept and len(kept) < 500 and None not in kept
    assert common.among(rows, "at", ids.limit(0)).count() == 0
    monkeypatch.setattr(common, "FILTER_BITS", 128)
    assert common.among(rows, "at", ids).count() == 2001
