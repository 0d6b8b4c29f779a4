"""Seams for what happens outside the engine: embedders, judges, extractors. Each is a callable that runs on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def embedder(embed: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A Column function over embed(texts) -> vectors, a batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if v is None else np.asarray(v, np.float32) for v in embed([t or "" for t in texts])])

    return run


def hash_embedding(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: signed hashes of words, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1.0
        return out.tolist()

    return embed


def text_function(run: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A Column function over run(text) -> text: judges, summarisers, extractors."""

    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(run)

    return each
