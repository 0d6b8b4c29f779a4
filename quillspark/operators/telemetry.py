"""What a search shows a judge, and what is kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .enrichment import counts_by_type

KEPT = ["id", "source_type", "source_title", "source_uri", "similarity_score", "last_engaged_days_ago"]
LITURGICAL = ["category", "genre", "feast_name", "tradition"]
#: Characters of a candidate's text that the judge sees.
SHOWN = 500


def candidate(fields: list[str], of: Column | None = None) -> Column:
    """The kept fields of a candidate and, where it is a liturgical one, those of its rite, as one struct. of: the struct
    that holds them, if they aren't columns."""
    at = lambda c: F.col(c) if of is None else of[c]
    return F.struct(*[at(c).alias(c) for c in [*KEPT, *[c for c in LITURGICAL if c in fields]]])


def accepted(fields: list[str]) -> Column:
    """A candidate with the judge's reason."""
    return F.struct(*[F.col(c) for c in [*KEPT, *[c for c in LITURGICAL if c in fields], "reason"]])


def triangulation(group: Column, fields: list[str]) -> Column:
    """A group of items with its reason: their ids, and each as a candidate."""
    return F.struct(group["reason"].alias("reason"), F.transform(group["items"], lambda i: i["id"]).alias("ids"), F.transform(group["items"], lambda i: candidate(fields, i)).alias("items"))


def judge_input(candidates: DataFrame, key: str, order: str, seed: Column, mode: Column, directives: Column) -> DataFrame:
    """By search (key) the judge's question as JSON: seed, mode, candidates in order (their texts cut), directives. A search
    returns a page of candidates."""
    shown = F.struct(F.col(order), F.struct("id", "source_type", "source_title", F.substring("text", 1, SHOWN).alias("text")).alias("c"))
    listed = F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["c"])
    told = candidates.groupBy(key).agg(F.any_value(seed).alias("seed"), F.any_value(mode).alias("mode"), listed.alias("candidates"), F.any_value(directives).alias("accumulated_directives"))
    return told.select(key, F.to_json(F.struct("seed", "mode", "candidates", "accumulated_directives")).alias("input"))


def as_records(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls among its fields."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def invocation(seed: Column, mode: Column, types: Column, limit: Column, floor: Column, now: Column) -> Column:
    """The row that is kept before a search begins."""
    return F.struct(seed.alias("seed"), mode.alias("mode"), F.to_json(types).alias("types"), limit.alias("limit"), floor.alias("similarity_floor"), now.alias("started_at"))


def plan_summary(plan: DataFrame, types: list[str]) -> DataFrame:
    """How many repairs of a plan each type has."""
    return counts_by_type(plan, types)
