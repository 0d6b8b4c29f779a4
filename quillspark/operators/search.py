"""Nearest neighbours with metadata filters, fan-out per type, title matches and hydration.

Filters come before ranking: the vectors are restricted by a left semi join, then ranked, so that a filter never costs hits.
A query vector is one row and is broadcast; ranking is a top-k per query, which Spark keeps to k rows a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_phrases, phrase_in
from ..functions.vectors import cosine_distance, norm, similarity
from ..session import checkpointed

MOST = 50


def clamp(limit: int, most: int = MOST) -> int:
    return max(1, min(limit, most))


def all_of(conditions: list[Column | None]) -> Column:
    """All conditions that are given; none is true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def like_pattern(column: Column, fragment: str | None) -> Column | None:
    """Contains the fragment, whatever the case; % and _ in it stay wildcards."""
    return None if fragment is None else column.ilike(f"%{fragment}%")


def between_dates(column: Column, first: str | None, last: str | None) -> Column:
    """ISO text compared as text; a last day of ten characters holds to its end."""
    last = f"{last}T23:59:59Z" if last and len(last) == 10 else last
    return all_of([column >= first if first else None, column <= last if last else None])


def restricted(vectors: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """The vectors whose key is allowed."""
    return vectors.join(allowed.select(key), key, "left_semi")


def with_norm(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn("norm", norm(F.col(vector)))


def distances(vectors: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each vector's cosine distance to the one row of `query` (column q); vectors without a norm are left out. Without a
    row, or with a null vector, there is none; several rows are an error. A column `norm` (with_norm) saves its computation."""
    rows = query.select(F.col("q").cast("array<double>").alias("q"), norm(F.col("q")).alias("n")).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a search has one query vector")
    # the vector becomes part of the plan, which has no join then
    asked, length = (rows[0]["q"], rows[0]["n"]) if rows and rows[0]["q"] is not None else (None, None)
    q, n = F.lit(asked).cast("array<double>"), F.lit(length).cast("double")
    own = F.col("norm") if "norm" in vectors.columns else norm(F.col(vector))
    return vectors.withColumn("distance", cosine_distance(F.col(vector), q, own, n)).filter(F.col("distance").isNotNull())


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k nearest vectors, ties to the smaller key."""
    return distances(vectors, query, vector).orderBy("distance", key).limit(clamp(k))


def nearest_of_each(vectors: DataFrame, query: DataFrame, facet: str, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k nearest of each value of the facet."""
    order = Window.partitionBy(facet).orderBy("distance", key)
    return distances(vectors, query, vector).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merged(ranked: DataFrame, document: str, limit: int, key: str) -> DataFrame:
    """Of fanned-out hits the best of each document, nearest first, `limit` of them."""
    best = ranked.withColumn("of_document", F.row_number().over(Window.partitionBy(document).orderBy("distance", key)))
    return best.filter("of_document = 1").drop("of_document").orderBy("distance", key).limit(limit)


def over_floor(hits: DataFrame, floor: float) -> DataFrame:
    """Hits whose similarity reaches the floor (before rounding), with the similarity to four places."""
    s = similarity(F.col("distance"))
    return hits.withColumn("similarity", F.round(s, 4)).filter(s >= floor)


def title_matches(documents: DataFrame, seeds: DataFrame, limit: int = 5, eligible: Column | None = None) -> DataFrame:
    """Documents whose title, or a phrase derived from it, stands in a seed: for each seed the `limit` longest matches.

    documents: id, title; seeds: seed_id (unique), seed. A phrase can only stand in a seed that holds all of its words, so
    that seeds' words that no phrase has go first, and each phrase then meets the seeds that hold its rarest word, once.
    Phrases without any word meet all seeds.
    """
    chosen = documents.filter(F.col("title").isNotNull() & (F.length("title") >= 4) & (F.lit(True) if eligible is None else eligible))
    phrases = chosen.select("id", F.explode(match_phrases(F.col("title"))).alias("phrase"))
    words_of = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(c), r"(?U)\W+")), "")
    phrases = checkpointed(phrases.withColumn("words", words_of(F.col("phrase"))))
    wanted = phrases.select(F.explode("words").alias("word")).distinct()
    said = checkpointed(seeds.select("seed_id", F.explode(words_of(F.col("seed"))).alias("word")).join(wanted, "word", "left_semi"))
    frequency = said.groupBy("word").agg(F.count("*").alias("df"))
    # a phrase with a word that no seed holds stands in none
    rated = phrases.select("id", "phrase", "words", F.explode("words").alias("word")).join(frequency, "word").groupBy("id", "phrase", "words").agg(F.min(F.struct("df", "word")).alias("rarest"), F.count("*").alias("held"))
    rarest = rated.filter(F.col("held") == F.size("words")).select("id", "phrase", "rarest.word")
    near = said.join(rarest, "word").groupBy("seed_id").agg(F.collect_list(F.struct("id", "phrase")).alias("near"))
    text = F.lower("seed")
    found = seeds.select("seed_id", "seed").join(near, "seed_id").select("seed_id", F.explode(F.filter("near", lambda p: phrase_in(p["phrase"], text))).alias("p"))
    wordless = phrases.filter(F.size("words") == 0).select(F.struct("id", "phrase").alias("p"))
    if not wordless.isEmpty():
        found = found.unionByName(seeds.select("seed_id", text.alias("text")).join(wordless, F.contains("text", F.lower("p.phrase"))).filter(phrase_in(F.col("p.phrase"), F.col("text"))).select("seed_id", "p"))
    best = found.groupBy("seed_id", F.col("p.id").alias("id")).agg(F.max(F.length("p.phrase")).alias("matched"))
    order = Window.partitionBy("seed_id").orderBy(F.desc("matched"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def appended(hits: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """hits, and of `more` the rows whose key isn't among them."""
    return hits.unionByName(more.join(hits.select(key), key, "left_anti"), allowMissingColumns=True)


def first_chunk(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.min_by("text", "chunk_index").alias("chunk_text"))


def positions(hits: DataFrame, order: list) -> DataFrame:
    """A candidate id `key:position`, positions from 0 in the given order. For a result of a search, which is small."""
    return hits.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
