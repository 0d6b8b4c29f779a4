"""Versions of tables: each step changes a frame's columns, and the steps that a table has had are kept beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def with_column(name: str, kind: str, default: Column | None = None) -> Step:
    """A step that adds a column, unless it is there."""
    return lambda df: df if name in df.columns else df.withColumn(name, (F.lit(None) if default is None else default).cast(kind))


def version(applied: DataFrame) -> int:
    """The newest version among the applied ones; 0 without any."""
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version")).first()["version"]


def upgraded(df: DataFrame, steps: dict[int, Step], applied: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """df after the steps that it hasn't had, in the order of their versions, and the versions it has then had (version,
    applied_at). A version is listed once, so that the list is small."""
    had = {r["version"] for r in applied.select("version").distinct().collect()}
    due = sorted(set(steps) - had)
    for v in due:
        df = steps[v](df)
    if not due:
        return df, applied
    new = df.sparkSession.createDataFrame([(v,) for v in due], "version int").withColumn("applied_at", now)
    return df, applied.unionByName(new)
