"""Threads and links: reply trees in order, and crawls by frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import yaml_scalar
from ..session import checkpointed


def flattened(posts: DataFrame) -> DataFrame:
    """Each post's place in its thread, depth first: root, path (positions from the root), depth. posts: uri, parent (null at
    the root), position among its siblings. One join a level; replies whose parent is missing are left out."""
    level = checkpointed(posts.filter("parent is null").select(F.col("uri").alias("root"), "uri", F.array(F.col("position").cast("int")).alias("path")))
    every = level
    while not level.isEmpty():
        up = level.select("root", F.col("uri").alias("parent"), "path")
        level = checkpointed(posts.join(up, "parent").select("root", "uri", F.concat("path", F.array(F.col("position").cast("int"))).alias("path")))
        every = every.union(level)
    return every.withColumn("depth", F.size("path") - 1)


def rendered(turns: DataFrame, key: str, order: str, heading: Column, body: Column, front: list[tuple[str, Column]]) -> DataFrame:
    """A text per thread: front matter, then every turn in order under its heading. A thread fits a task."""
    pieces = F.sort_array(F.collect_list(F.struct(order, F.concat(F.lit("### "), heading, F.lit("\n\n"), body).alias("piece"))))
    head = F.concat(F.lit("---\n"), *[F.concat(F.lit(f"{name}: "), yaml_scalar(value.cast("string")), F.lit("\n")) for name, value in front], F.lit("---\n\n"))
    return turns.groupBy(key).agg(F.concat(head, F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n\n"), F.lit("\n")).alias("markdown"))


def reached(start: DataFrame, links: DataFrame, in_scope: Column, most_rounds: int | None = None) -> DataFrame:
    """Breadth first from start (url) over links (url, target): url and the round in which it was first reached. Each round
    joins the frontier with the links and keeps what wasn't seen before."""
    seen = frontier = checkpointed(start.select("url").distinct().withColumn("round", F.lit(0)))
    n = 0
    edges = links.filter(in_scope).select("url", "target").distinct()
    while not frontier.isEmpty() and (most_rounds is None or n < most_rounds):
        n += 1
        step = frontier.join(edges, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = checkpointed(step.withColumn("round", F.lit(n)))
        seen = seen.union(frontier)  # of tables, each written once
    return seen


def long_enough(posts: DataFrame, least: int = 30) -> DataFrame:
    """The thread's root (parent null), and replies that aren't short."""
    return posts.filter(F.col("parent").isNull() | (F.length("text") >= least))
