"""Which documents want metadata from outside, what is taken of it, and the texts that stand in for missing descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import optional, strip

# Types whose documents are enriched.
ENRICHED_TYPES = ["book", "audiobook", "storygraph_entry", "kindle_book"]


def eligible(documents: DataFrame, types: list[str], force: bool = False) -> DataFrame:
    """Documents of these types that weren't enriched or have no description; with force all of these types."""
    wanted = documents.filter(F.col("content_type").isin(types))
    return wanted if force else wanted.filter(F.col("enriched_at").isNull() | F.col("description").isNull())


def counts_by_type(rows: DataFrame, types: list[str], column: str = "content_type") -> DataFrame:
    """How many rows each of the types has, none among them."""
    domain = rows.sparkSession.createDataFrame([(t,) for t in types], f"{column} string")
    return domain.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def year_fits(parsed: Column, date: Column) -> Column:
    """Whether a result's date (text, year first) is within a year of the parsed one; what isn't known fits."""
    year = F.substring(date, 1, 4).try_cast("int")
    return F.coalesce(F.abs(year - parsed) <= 1, F.lit(True))


def repaired(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """documents with the plan's titles and authors where it has some. plan: id, title, author; the smallest values count
    where it names an id twice."""
    one = plan.groupBy("id").agg(F.min("title").alias("_title"), F.min("author").alias("_author"))
    return documents.join(one, "id", "left").withColumn("title", F.coalesce("_title", "title")).withColumn("author", F.coalesce("_author", "author")).drop("_title", "_author")


def book_text(title: Column, author: Column, narrator: Column, subjects: Column, content_type: Column) -> Column:
    """What is embedded for a book without a description; null without a title. subjects: a JSON array."""
    listed = F.filter(F.transform(F.from_json(subjects, "array<string>"), lambda s: strip(s)), lambda s: s != "")
    parts = [optional(title), F.concat(F.lit("by "), optional(author)), F.concat(F.lit("narrated by "), optional(narrator)), F.concat(F.lit("Subjects: "), F.nullif(F.array_join(listed, ", "), F.lit(""))), F.concat(F.lit("("), optional(content_type), F.lit(")"))]
    return F.when(optional(title).isNotNull(), F.array_join(F.array_compact(F.array(*parts)), ". "))


def video_text(title: Column, is_series: Column, year: Column, director: Column, genres: Column, seasons: Column) -> Column:
    """What is embedded for a film or series without a plot. genres: a JSON array."""
    some = lambda c: F.nullif(c, F.lit(""))
    count = F.nullif(seasons, F.lit(0))
    listed = F.nullif(F.array_join(F.from_json(genres, "array<string>"), ", "), F.lit(""))
    parts = [
        F.concat(F.coalesce(some(title), F.lit("(untitled)")), F.lit(" — "), F.when(is_series, "TV show").otherwise("film"), F.lit(".")),
        F.concat(F.lit("Released "), F.nullif(year, F.lit(0)).cast("string"), F.lit(".")),
        F.concat(F.lit("Directed by "), some(director), F.lit(".")),
        F.concat(F.lit("Genres: "), listed, F.lit(".")),
        F.concat(count.cast("string"), F.lit(" season"), F.when(count != 1, "s").otherwise(""), F.lit(".")),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def cache_key(title: Column, author: Column) -> Column:
    lines = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(author, F.lit("")))
    return F.substring(F.sha2(strip(F.lower(lines)), 256), 1, 32)
