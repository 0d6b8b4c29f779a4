"""Readers of tables, CSV exports, file trees, seeds and inboxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import rating, read_date
from ..functions.text import AUDIO_SUFFIXES, content_hash, optional

# Column names of reading-log exports, the first that a file has counts.
READING_LOG = {"title": ["Title"], "author": ["Authors"], "rating": ["Star Rating"], "status": ["Read Status"], "read_date": ["Last Date Read", "Dates Read"], "source_id": ["StoryGraph ID", "ID"]}
BOOK_SUFFIXES = ["epub", "pdf", "mobi", "azw3"]
VIDEO_SUFFIXES = ["mkv", "mp4", "avi", "m4v", "mov", "wmv", "mpg", "mpeg", "ts"]


def table(spark: SparkSession, folder: str, name: str, view: bool = False) -> DataFrame:
    """A Parquet table; view: also under its name in SQL."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if view:
        df.createOrReplaceTempView(name)
    return df


def picked(df: DataFrame, names: list[str]) -> Column:
    """The first of the names that the frame has as a column, blank as null; null if it has none."""
    return next((optional(F.col(f"`{n}`")) for n in names if n in df.columns), F.lit(None).cast("string"))


def missing_columns(df: DataFrame, groups: dict[str, list[str]]) -> list[str]:
    return [g for g, names in groups.items() if not set(names) & set(df.columns)]


def reading_log(spark: SparkSession, path: str) -> DataFrame:
    """Books of a reading-log export that have been read and have a title."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    rows = raw.select(*[picked(raw, names).alias(c) for c, names in READING_LOG.items()])
    done = rows.filter(F.lower("status").isin("read", "finished") & F.col("title").isNotNull())
    return done.select("title", "author", rating(F.col("rating")).alias("rating"), read_date(F.col("read_date")).alias("read_date"), "source_id", content_hash(F.col("title"), F.coalesce("author", F.lit(""))).alias("content_hash"))


def files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """Files below a folder by suffix: path, length, modified, name, suffix. Contents aren't read unless asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    listed = found.withColumnRenamed("modificationTime", "modified").withColumn("name", name).withColumn("suffix", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
    return listed.filter(F.col("suffix").isin(suffixes) & ~F.col("name").startswith("._") & (F.col("name") != ".DS_Store"))


def new_files(found: DataFrame, stored: DataFrame, since: Column | None = None) -> DataFrame:
    """Files not stored with the same path, size and time; then, of those, the ones whose content isn't stored either."""
    recent = found if since is None else found.filter(F.col("modified") > since)
    unknown = recent.join(stored.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
    hashed = unknown.withColumn("content_hash", F.sha2("content", 256))
    return hashed.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def audiobooks(found: DataFrame, root_depth: int) -> DataFrame:
    """A book is an audio file at the top, or a folder at depth one or two that holds audio files: book path, files."""
    parts = F.split("path", "/")
    depth = F.size(parts) - root_depth
    audio = found.filter(F.col("suffix").isin(AUDIO_SUFFIXES)).withColumn("depth", depth).filter("depth between 1 and 3")
    book = F.when(F.col("depth") == 1, F.col("path")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    return audio.groupBy(book.alias("book")).agg(F.count("*").alias("files"), F.min("depth").alias("depth"))


def seed_frame(spark: SparkSession, entries: list[dict], schema: str, rules: dict[str, Callable[[], Column]]) -> DataFrame:
    """Entries of a seed file (parsed by the caller) with the names of all rules that each one breaks, not only the first."""
    df = spark.createDataFrame([tuple(e.get(c.split()[0]) for c in schema.split(", ")) for e in entries], schema)
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule(), F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("errors", broken)


def inbox(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Captured records; as a stream or all at once."""
    schema = "source string, kind string, content string, metadata map<string, string>"
    return (spark.readStream if stream else spark.read).schema(schema).json(path)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes by name: timestamp (its line, else the file's time) and text without front matter."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    text = F.decode("content", "UTF-8")
    stamp = F.nullif(F.regexp_extract(text, r"(?m)^timestamp:\s*(\S+)", 1), F.lit(""))
    return found.select("path", F.coalesce(stamp, F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), F.trim(F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")).alias("text"))


def since(posts: DataFrame, stamp: str, cursor: Column) -> DataFrame:
    """Posts after the cursor that aren't reposts."""
    return posts.filter((F.col(stamp) > cursor) & ~F.coalesce(F.col("is_repost"), F.lit(False)))


def image_bytes(df: DataFrame) -> Column:
    """Base64 text as bytes; text that is none gives null."""
    return F.try_to_binary(df["data"], F.lit("base64"))
