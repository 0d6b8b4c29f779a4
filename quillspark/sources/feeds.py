"""A feed of posts, newest first and page by page, as a table and as a stream.

The feed itself is a seam: an object that is pickled to where it is read, with `newest()`, the time of the newest post in
microseconds (None for an empty feed), and `page(before)`, the posts older than a time, newest first, some at a time: dicts
with uri, author, text, at (microseconds), repost. The stream's offsets are times, kept with the query's checkpoint: a batch
is the posts of a range of time, cut into windows that are paged through by tasks of their own, and the same posts however
often it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

POSTS = "uri string, author string, text string, at bigint, repost boolean"
#: Microseconds that one task pages through, and tasks of one batch at most.
WINDOW, MOST_TASKS = 30 * 24 * 3600 * 1_000_000, 200


class _Span(ds.InputPartition):
    """Posts with after < at <= until."""

    def __init__(self, after: int, until: int):
        super().__init__((after, until))


def spans(after: int, until: int) -> list[_Span]:
    step = max(WINDOW, -(-(until - after) // MOST_TASKS))
    return [_Span(at, min(until, at + step)) for at in range(after, until, step)]


def posts_between(feed, after: int, until: int) -> Iterator[tuple]:
    """The posts of a span, paged through from its end; reposts too."""
    before = until + 1
    while page := feed.page(before):
        for p in page:
            if p["at"] <= after:
                return
            yield p.get("uri"), p.get("author"), p.get("text"), p["at"], bool(p.get("repost"))
        before = min(p["at"] for p in page)


class _Batch(ds.DataSourceReader):
    def __init__(self, feed, after: int):
        self.feed, self.after = feed, after

    def partitions(self) -> list[ds.InputPartition]:
        newest = self.feed.newest()
        return spans(self.after, newest) if newest is not None and newest > self.after else [_Span(0, 0)]

    def read(self, partition: ds.InputPartition) -> Iterator[tuple]:
        after, until = partition.value
        return posts_between(self.feed, after, until) if until > after else iter(())


class _Stream(ds.DataSourceStreamReader):
    def __init__(self, feed, after: int):
        self.feed, self.after = feed, after

    def initialOffset(self) -> dict:
        return {"at": self.after}

    def latestOffset(self) -> dict:
        return {"at": max(self.after, self.feed.newest() or 0)}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        return spans(start["at"], end["at"]) or [_Span(0, 0)]

    def read(self, partition: ds.InputPartition) -> Iterator[tuple]:
        after, until = partition.value
        return posts_between(self.feed, after, until) if until > after else iter(())

    def commit(self, end: dict) -> None:
        pass


def _registered(spark: SparkSession, feed, name: str) -> str:
    class Feed(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return POSTS

        def reader(self, schema) -> ds.DataSourceReader:
            return _Batch(feed, int(self.options.get("after", 0)))

        def streamReader(self, schema) -> ds.DataSourceStreamReader:
            return _Stream(feed, int(self.options.get("after", 0)))

    spark.dataSource.register(Feed)
    return name


def feed_table(spark: SparkSession, feed, after: int = 0, name: str = "post_feed") -> DataFrame:
    """The posts newer than a time (a delta), or all (a backfill)."""
    return spark.read.format(_registered(spark, feed, name)).option("after", str(after)).load()


def feed_stream(spark: SparkSession, feed, after: int = 0, name: str = "post_feed") -> DataFrame:
    """The same as a stream, which goes on from its checkpoint."""
    return spark.readStream.format(_registered(spark, feed, name)).option("after", str(after)).load()
