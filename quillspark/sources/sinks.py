"""Sinks: new snapshots beside the old, text files, appended events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import yaml_scalar


def snapshot(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A whole new snapshot under a path of its own; readers move to it when it is complete."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def markdown(front: list[tuple[str, Column]], body: Column) -> Column:
    """Front matter in the given order, values that are null left out, then the body."""
    lines = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), yaml_scalar(v.cast("string")))) for k, v in front]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body, F.lit("\n"))


def capture_name(stamp: Column, payload: Column) -> Column:
    """`{stamp}_{first 8 of sha1}.json`; the payload's keys are sorted by the caller."""
    return F.concat(stamp, F.lit("_"), F.substring(F.sha1(payload), 1, 8), F.lit(".json"))
