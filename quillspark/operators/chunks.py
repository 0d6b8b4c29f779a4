"""Text in pieces: paragraphs, token windows, and the hybrid of both."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, paragraphs, words

MERGE_FLOOR, CAP, WINDOW, OVERLAP = 400, 1500, 512, 64
SCHEMA = "array<struct<text: string, token_count: int>>"


def token_windows(tokens: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Windows of `size` tokens, each starting size - overlap after the one before, up to the one that reaches the end."""
    step = size - overlap

    def cut(held):
        n = F.greatest(F.lit(1), F.ceil((F.size(held) - overlap) / step).cast("int"))
        windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(held, i * step + 1, F.lit(size)))
        return F.when(F.size(held) == 0, F.array().cast("array<array<string>>")).otherwise(windows)

    return let(tokens, cut)


def chunks(text: Column) -> Column:
    """The hybrid chunker over white-space tokens, in one pass over the paragraphs: a paragraph over the cap becomes
    windows; any other joins the last chunk while that is short and both fit the cap. Null or blank text has none.

    Tokens here are words between white space, so that counts of joined paragraphs add up and no text is encoded again.
    """

    def add(done, paragraph):
        return let(words(paragraph), lambda own: joined(done, paragraph, own))

    def joined(done, paragraph, own):
        n = F.size(own)
        last = F.element_at(done, -1)
        piece = lambda t, k: F.struct(t.alias("text"), k.cast("int").alias("token_count"))
        cut = F.transform(token_windows(own), lambda w: piece(F.array_join(w, " "), F.size(w)))
        joins = (F.size(done) > 0) & (last["token_count"] < MERGE_FLOOR) & (last["token_count"] + n <= CAP)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(piece(F.concat(last["text"], F.lit("\n\n"), paragraph), last["token_count"] + n)))
        return F.when(n > CAP, F.concat(done, cut)).when(joins, longer).otherwise(F.concat(done, F.array(piece(paragraph, n))))

    none = F.array().cast(SCHEMA)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", none).otherwise(F.aggregate(paragraphs(text), none, add))


def chunks_by(encode, decode):
    """The same chunker over an injected tokenizer, as an Arrow function: encode(text) -> ids, decode(ids) -> text."""

    def one(text: str | None) -> list[dict]:
        done: list[dict] = []
        for paragraph in (p.strip() for p in re.split("\n{2,}", text or "")):
            if not paragraph:
                continue
            ids = encode(paragraph)
            if len(ids) > CAP:
                for start in range(0, len(ids), WINDOW - OVERLAP):
                    part = ids[start : start + WINDOW]
                    done.append({"text": decode(part), "token_count": len(part)})
                    if start + WINDOW >= len(ids):
                        break
                continue
            if done and done[-1]["token_count"] < MERGE_FLOOR:
                both = done[-1]["text"] + "\n\n" + paragraph
                n = len(encode(both))
                if n <= CAP:
                    done[-1] = {"text": both, "token_count": n}
                    continue
            done.append({"text": paragraph, "token_count": len(ids)})
        return done

    @F.pandas_udf(SCHEMA)
    def chunked(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return chunked


def exploded(documents: DataFrame, pieces: Column, key: str) -> DataFrame:
    """A row for each piece: key, chunk_index, text, token_count."""
    return documents.select(key, F.posexplode(pieces).alias("chunk_index", "chunk")).select(key, "chunk_index", "chunk.text", "chunk.token_count")


def reassembled(pieces: DataFrame, key: str) -> DataFrame:
    """Texts from their pieces in order, blank lines between."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def stored_summary(pieces: DataFrame, key: str) -> DataFrame:
    return pieces.groupBy(key).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
