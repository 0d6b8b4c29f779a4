"""The corpus pipeline: five operators one after the other, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before wrote, and returns the documents that stay, with
the columns of documents (the last stage returns encodings). A stage that changes texts keeps n_chars in step.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_codec
from quillspark.llm.common import set_aside, unused, written
from quillspark.llm.queries import PIECE_BPE, documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go, whether or not there were labels to learn from."""
    model = language_id.train(docs)
    if not model.languages:
        return language_id.with_letters(docs)
    own, back = set_aside(docs, ["lang_pred", "score"])
    found = language_id.identify(own, model, keep=own.columns).filter(F.col("lang_pred") != language_id.UNDETERMINED)
    return back(found.select(*own.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents hold stay in the last one only; emptied documents stay, empty."""
    own, back = set_aside(docs, ["kept", "n_lines", "n_dropped"])
    found = line_dedup.dedup_lines(own, keep=[c for c in own.columns if c != "text"])
    length = F.when(F.col("n_dropped") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return back(found.select(*[F.col("kept").alias(c) if c == "text" else length.alias(c) if c == "n_chars" else c for c in own.columns]))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by a similarity of 0.8 on five-word shingles, the one with the smallest id
    stays."""
    found = near_dedup.near_duplicates(docs)
    name = unused("gone_id", docs.columns)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of the documents that stayed."""
    return sentencepiece_codec.encode_decode(docs, public_tokenizers.path(PIECE_BPE), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written, and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
