"""Token counts with a digest cache.

Each text is normalised, as far as the tokenizer does so itself, and digested. Digests, together with a digest of the
tokenizer file, are joined to the cache of stored counts; only distinct digests that the cache lacks are encoded, and what
they give is appended to the cache, from which all counts are then joined. Contents travel only where their digest is
missing.

A tokenizer whose file says that it lower-cases, joins white space and splits at it (SPLITTING) is counted by words: runs of
white space don't matter, and a text's count is the sum over its words; a bounded table of words counted before saves most
calls of the library. Any other tokenizer gets whole texts as they are.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, fresh_path, map_slices, per_worker, slices, texts, written

#: Words kept in each Python worker's table; it is emptied when full.
WORD_TABLE = 100_000
#: Words that the library encodes at once; its encodings are large.
ENCODED_AT_ONCE = 2_000

CACHE_SCHEMA = "text_sha binary, tokenizer_sha binary, n_tokens bigint"


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


# The settings of a tokenizer file under which tokens don't cross white space, and case doesn't matter.
SPLITTING = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


def splits_at_white_space(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    plain = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word")) and not any(c.isspace() for c in a["content"]) and a["content"].startswith("<|") for a in told["added_tokens"])
    return plain and (told["normalizer"], told["pre_tokenizer"]) == SPLITTING


def normalised(text: bytes | None, splitting: bool) -> bytes:
    """Null is empty. Where the tokenizer splits at white space, its runs and ends don't matter."""
    return b" ".join((text or b"").split()) if splitting else text or b""


#: In texts of Latin-1 characters without apostrophes and special strings, a run of letters is a piece of its own.
_LETTERS = "a-zª\u00b5ºß-öø-ÿ"
_PARTS = re.compile(f"[{_LETTERS}]+|[^{_LETTERS} ]+")


def parts(text: str) -> list[str]:
    """Parts of a text whose token counts add up to the text's."""
    if "'" not in text and "<|" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return _PARTS.findall(text.lower())
    return text.split(" ")


class WordCounter:
    """Counts of whole texts as sums over parts, each part encoded by the library once while kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.splitting = splits_at_white_space(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, int] = {}

    def counts(self, batch: list[str]) -> list[int]:
        if not self.splitting:
            return [len(self.library.encode(text, add_special_tokens=False)) for text in batch]
        words = [parts(text) for text in batch]
        known = self.known
        if len(known) > WORD_TABLE:
            known.clear()
        new = [w for w in {w for ws in words for w in ws} if w not in known]
        for i in range(0, len(new), ENCODED_AT_ONCE):
            some = new[i : i + ENCODED_AT_ONCE]
            known.update(zip(some, map(len, self.library.encode_batch_fast(some, add_special_tokens=False))))
        return [sum(map(known.__getitem__, ws)) for ws in words]


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and ids, null ids among them, each keep their row. An
    empty table gives an empty result. Other columns of docs are ignored. cache_path names a Parquet folder to read from
    and append to; without it, the call starts a cache of its own in the shared folder. Texts are cut into words at blanks
    only, whatever their length.
    """
    spark = docs.sparkSession
    version, splitting = F.lit(tokenizer_digest(tokenizer_path)), splits_at_white_space(tokenizer_path)
    cache_path = cache_path or fresh_path(spark, "token-counts")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_sha") == version)

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("content"))

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = texts(batch, "content")
        return pa.record_batch({"id": batch.column("id"), "n_bytes": pa.array([len(t or b"") for t in found], pa.int64()), "text_sha": pa.array([hashlib.sha256(normalised(t, splitting)).digest() for t in found], pa.binary())})

    def contents(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Each content of a slice once, so that copies don't travel."""
        found = {hashlib.sha256(t).digest(): t for t in (normalised(t, splitting) for t in texts(batch, "content"))}
        return pa.record_batch({"text_sha": pa.array(list(found), pa.binary()), "content": pa.array([t.decode() for t in found.values()], pa.string())})

    keyed = written(map_slices(narrow, "content", digests, f"id {kind}, n_bytes bigint, text_sha binary"), "digests")
    missing = written(keyed.select("text_sha").distinct().join(cache, "text_sha", "left_anti"), "missing")
    each = map_slices(narrow.select("content"), "content", contents, "text_sha binary, content string")
    # contents that are cached stay where they are; equal ones meet in one partition, where the first is encoded
    misses = among(each, "text_sha", missing, "text_sha").repartition("text_sha").join(missing, "text_sha", "left_semi")
    counter = per_worker(lambda: WordCounter(tokenizer_path))

    def encode(batches):
        done: set[bytes] = set()
        for batch in slices(batches, "content", 1 << 20):
            shas = batch.column("text_sha").to_pylist()
            new = [i for i, sha in enumerate(shas) if sha not in done and not done.add(sha)]
            found = texts(batch, "content")
            counts = counter().counts([found[i].decode() for i in new])
            yield pa.record_batch({"text_sha": pa.array([shas[i] for i in new], pa.binary()), "n_tokens": pa.array(counts, pa.int64())})

    fresh = misses.select("text_sha", "content").mapInArrow(encode, "text_sha binary, n_tokens bigint")
    fresh.select("text_sha", version.alias("tokenizer_sha"), "n_tokens").write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_sha") == version).groupBy("text_sha").agg(F.max("n_tokens").alias("n_tokens"))
    # as a table of its own, so that a very common text's rows can be split in the join
    stored = written(stored, "counts")
    return keyed.join(stored, "text_sha", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
